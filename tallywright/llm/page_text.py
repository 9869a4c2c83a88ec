"""Main text of web pages by a site style tree.

Each page becomes a list of text blocks with the path of elements they stand in
(names with their class and id). The pages of a host are merged: nodes with one
path are one node of the host's tree, and the ways in which its children follow
each other on the pages are its presentations.

A node that holds texts has a content importance: the entropy of its texts over the
host's pages, relative to the largest possible one; texts that return on page after
page tell nothing. It is carried to every branch above the node. A branch's
importance joins it with the entropy of the branch's own presentations: a branch
tells nothing if neither what it holds nor how it is arranged changes from page to
page. Element names and classes are a prior: a marked article counts most, what
stands beside one least, and parts marked as navigation, adverts and the like
count nothing unless the mark holds the whole page. The product decides: branches
of low importance are removed from each page, then single nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import by_size, let, stored, table

#: Fixed values of HTML: elements by how they shape text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins ends an open one of these, up to the fence.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
}
#: Presentation importance 0: elements, and words of class, id or role.
NO_CONTENT = frozenset(
    "script style head title noscript template nav footer aside button select option textarea input label "
    "iframe svg canvas object audio video menu dialog noframes noembed xmp search datalist map".split()
)
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notices pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary search".split()
)
#: Those that a longer name (``notice-board``) may hold without meaning such a part.
LOOSE_WORDS = frozenset(
    "ad ads banner header modal notice notices popup promo promoted related search social subscription toolbar "
    "widget".split()
)
#: Beginnings, ends and parts of names that tell of a layout and not of a part.
MODIFIERS = frozenset("has with without no not is".split())
DENIALS = frozenset("free less off none".split())
LAYOUT_WORDS = frozenset("wrap wrapper container layout main article content".split())
#: Presentation importance 1.
MAIN = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article articlebody".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
WORD_OF_MARK = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"[ \t\n\r\f]+")

#: Prior of a path; text of silent ones, inline parts without content, is not even a
#: block. Below a doubtful mark (a form, a loose word in a name) are the last two, plain
#: and in an article, until the whole page is known.
NOISE, PLAIN, INSIDE, SILENT, DOUBTFUL, DOUBTFUL_INSIDE = range(6)

#: Importance under which the texts of a node are the site's, and the number of
#: pages a host's node must be on before its entropy says anything.
THRESHOLD, PAGES = 0.35, 4
#: Weight of the prior: in a marked article, beside one, and on pages without.
IN_ARTICLE, BESIDE, UNMARKED = 2.0, 0.5, 1.0
#: Importance of nodes whose entropy says nothing.
UNKNOWN = 0.5
#: Hashes are kept as signed longs.
OFFSET = 1 << 63
#: Elements that hold a page or its article, and are no branches to be removed.
WHOLE = frozenset("html body article main".split())
#: Elements inside each other as deep as browsers nest them; deeper ones count as their parent.
DEPTH = 512


def _says_no_content(marks: list[tuple[str, str]]) -> int:
    """What class, id and role say of an element: NOISE names a part without content,
    DOUBTFUL a longer name with a loose word for one, PLAIN nothing. Names that only
    tell of a layout (``has-sidebar``, ``ad-free``, ``content-sidebar-wrap``) do not count."""
    says = PLAIN
    for _, value in marks:
        for token in value.split():
            parts = [w.lower() for w in WORD_OF_MARK.findall(CAMEL.sub(" ", token))]
            if not parts or parts[0] in MODIFIERS or parts[-1] in DENIALS:
                continue
            found = NO_CONTENT_WORDS.intersection(parts)
            if parts[0] in found or found and LAYOUT_WORDS.isdisjoint(parts):
                if len(parts) == 1 or not found <= LOOSE_WORDS:
                    return NOISE
                says = DOUBTFUL
    return says


def _label(name: str, tag: str) -> tuple[str, int]:
    """Element with its marks, and its prior."""
    marks = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in MARK.finditer(tag)] if "=" in tag else []
    label = name + "".join(f"[{k}={v}]" for k, v in marks)
    if name in NO_CONTENT or len(tag) > len(name) + 2 and HIDDEN.search(tag):
        return label, NOISE
    if name not in HEADINGS and name not in ("html", "body", "p"):
        says = _says_no_content(marks)
        if says != PLAIN or name == "form":
            return label, says if says == NOISE else DOUBTFUL
    words = {w.lower() for _, v in marks for w in WORD_OF_MARK.findall(v)}
    if name in MAIN or name in ("div", "section") and not MAIN_WORDS.isdisjoint(words):
        return label, INSIDE
    return label, PLAIN


def _below(above: int, kind: int, block: bool) -> int:
    """Prior of an element of a kind below one of a prior."""
    if above in (NOISE, SILENT):
        return above
    if kind == NOISE or kind == DOUBTFUL and not block:
        return NOISE if block else SILENT
    if kind == DOUBTFUL and above in (INSIDE, DOUBTFUL_INSIDE):
        return NOISE  # the article stands around it
    if above == DOUBTFUL and kind == INSIDE:
        return DOUBTFUL_INSIDE
    return above if kind == PLAIN or above in (DOUBTFUL, DOUBTFUL_INSIDE) else kind


class Outline(NamedTuple):
    """A page for the tree; paths are hashes, each of a label and the path above."""

    #: ``(path, prior, text)`` of each block with text, in page order.
    blocks: list[tuple[int, int, str]]
    #: ``(path, presentation)``, the hash of its children's labels, once for each.
    nodes: list[tuple[int, int]]
    #: ``(path, branches)``: the branches around the blocks of each path.
    chains: list[tuple[int, list[int]]]


class _Open(NamedTuple):
    """An open element."""

    name: str
    path: int
    prior: int
    children: list[str]


def blocks(page: str) -> list[tuple[int, int, str]]:
    """``(path, prior, text)`` of each block with text, in page order."""
    return outline(page).blocks


def outline(page: str) -> Outline:
    """Blocks, presentations and branches of a page."""
    out: list[tuple[int, int, str]] = []
    nodes: dict[tuple[int, int], None] = {}
    chains: dict[int, list[int]] = {}
    stack: list[_Open] = []
    parts: list[str] = []
    articles = 0  # outside all doubtful parts

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            text = " ".join(text.split())
            if text:
                at = next((s for s in reversed(stack) if s.name in BLOCK), _Open("", 0, PLAIN, []))
                out.append((at.path, at.prior, text))
                if at.path not in chains and at.prior != NOISE:
                    chains[at.path] = [s.path for s in stack if s.name in BLOCK and s.name not in WHOLE and s.path != at.path]
            parts.clear()

    def close(to: int) -> None:
        if any(s.name in BLOCK and s.prior != SILENT for s in stack[to:]):
            flush()
        for s in stack[to:]:
            if s.children and s.name in BLOCK and s.name not in WHOLE and s.prior not in (NOISE, SILENT):
                nodes[s.path, xxhash.xxh64_intdigest("\n".join(s.children)) - OFFSET] = None
        del stack[to:]

    def opened(names: frozenset, fence: frozenset = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in fence:
                return -1
        return -1

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        token = m[0]
        at = m.end()
        if token[0] != "<" or token == "<":
            if not stack or stack[-1].prior != SILENT:
                parts.append(token)
            continue
        found = NAME.match(token)
        if not found:
            continue  # a comment or a declaration
        if token[-1] != ">":
            continue  # cut off at the end of the page
        name = found[1].lower()
        if token[1] == "/":
            if name == "br":
                parts.append(" ")
            elif name == "p" and opened(frozenset(["p"])) < 0:
                flush()
            elif name in HEADINGS:
                if (i := opened(HEADINGS)) >= 0:
                    close(i)
            elif (i := opened(frozenset([name]), frozenset() if name in BLOCK else frozenset(["td", "th"]))) >= 0:
                if name in BLOCK or name in NO_CONTENT or all(s.name not in BLOCK for s in stack[i:]):
                    close(i)
            continue
        if name in VOID:
            if name in ("br", "wbr", "img", "input"):
                parts.append(" " if name == "br" else "")
            elif name == "hr":
                flush()
            continue
        if name in CLOSES_P:
            if (i := opened(frozenset(["p"]), frozenset("button td th caption table".split()))) >= 0:
                close(i)
        if name in ENDS and (i := opened(*ENDS[name])) >= 0:
            close(i)
        label, kind = _label(name, token)
        _, path, above, siblings = stack[-1] if stack else _Open("", 0, PLAIN, [])
        if name in HEADINGS or name == "header" and above in (INSIDE, DOUBTFUL_INSIDE):
            kind = PLAIN if kind != NOISE or name == "header" else kind
        elif name == "header":
            kind = NOISE
        prior = _below(above, kind, name in BLOCK)
        articles += kind == INSIDE and prior == INSIDE
        if name in BLOCK and prior != SILENT:
            flush()
        if name in RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
            if stop:
                at = page.find(">", stop.start()) + 1 or end
            continue
        if not (token.endswith("/>") and name in ("svg", "path", "rect", "circle", "use", "g")):
            siblings.append(label)
            if len(stack) < DEPTH:
                path = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), seed=path + OFFSET) - OFFSET
            stack.append(_Open(name, path, prior, []))
    flush()
    close(0)
    return Outline(_settled(out, articles), list(nodes), list(chains.items()))


def _settled(found: list[tuple[int, int, str]], articles: int) -> list[tuple[int, int, str]]:
    """Blocks with the doubtful ones decided: a mark around the page's only article, or
    around all that the page has without one, marks no part of it."""
    priors = {b[1] for b in found}
    if DOUBTFUL not in priors and DOUBTFUL_INSIDE not in priors:
        return found
    holds = not articles and (DOUBTFUL_INSIDE in priors or PLAIN not in priors)
    of = {DOUBTFUL: PLAIN if holds else NOISE, DOUBTFUL_INSIDE: INSIDE if holds else NOISE}
    return [(path, of.get(prior, prior), text) for path, prior, text in found]


_OUTLINE = T.StructType([
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("path", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType())]))),
    T.StructField("nodes", T.ArrayType(T.StructType([
        T.StructField("path", T.LongType()), T.StructField("shown", T.LongType())]))),
    T.StructField("chains", T.ArrayType(T.StructType([
        T.StructField("path", T.LongType()), T.StructField("up", T.ArrayType(T.LongType()))]))),
])


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key, url, host`` and the page's outline: ``blocks, nodes, chains``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))
        node = pa.list_(pa.struct([("path", pa.int64()), ("shown", pa.int64())]))
        chain = pa.list_(pa.struct([("path", pa.int64()), ("up", pa.list_(pa.int64()))]))
        for batch in by_size(batches, 2, rows=128):
            found = [outline(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([[{"path": p, "kind": k, "text": t} for p, k, t in f.blocks] for f in found], block),
                pa.array([[{"path": p, "shown": n} for p, n in f.nodes] for f in found], node),
                pa.array([[{"path": p, "up": up} for p, up in f.chains] for f in found], chain),
            ], names=["key", "url", "blocks", "nodes", "chains"])

    out = T.StructType([
        T.StructField("key", pages.schema[key].dataType), T.StructField("url", T.StringType()), *_OUTLINE.fields])
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, out)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    return rows.select("key", "url", host.alias("host"), *_OUTLINE.names)


def _is(b: F.Column, *kinds: int) -> F.Column:
    return b["kind"].isin(*kinds)


def _entropy(n: str, nlogn: str) -> F.Column:
    """Entropy as a share of the largest possible, of counts given by the sums of n and
    n log n; 1 for a single case. Rounded, as sums come in any order."""
    n, nlogn = F.col(n), F.col(nlogn)
    return F.when(n > 1, F.round((F.log(n) - nlogn / n) / F.log(n), 9)).otherwise(1.0)


def _counted(cases: DataFrame, case: str) -> DataFrame:
    """``host, path, n, most, nlogn`` of the cases of each node, which has a case once for
    each page. Equal cases are added up before anything is shuffled by node."""
    return cases.distinct().groupBy("host", "path", case).agg(F.count("*").alias("c")) \
        .groupBy("host", "path").agg(
            F.sum("c").alias("n"), F.max("c").alias("most"), F.sum(F.col("c") * F.log("c")).alias("nlogn"))


def leaf_importance(rows: DataFrame) -> DataFrame:
    """``host, path, n, most, content`` of the nodes that hold texts.

    A node has a text once for each different page (by the hash of its blocks) that
    shows it there: neither copies of a page nor repeats on one page are a template.
    """
    texts = rows.select("host", F.xxhash64("blocks").alias("page"),
                        F.explode(F.filter("blocks", lambda b: _is(b, PLAIN, INSIDE))).alias("b")) \
        .select("host", "b.path", F.xxhash64("b.text").alias("text"), "page")
    return _counted(texts, "text").select("host", "path", "n", "most", _entropy("n", "nlogn").alias("content"))


def branch_importance(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``host, path, most, importance`` of the elements above the nodes that hold texts.

    ``1 - (1 - shown)(1 - inside)``: the entropy of the branch's presentations, and the
    mean content importance of all nodes below, by their number of texts. The nodes of
    the merged tree carry their sums up, not the pages; a path tells its branches.
    """
    shown = _counted(
        rows.select("host", F.xxhash64("blocks").alias("page"), F.explode("nodes").alias("e"))
        .select("host", "e.path", "e.shown", "page"), "shown") \
        .select("host", "path", _entropy("n", "nlogn").alias("shown"))
    above = rows.select("host", F.explode("chains").alias("c")).where(F.size("c.up") > 0) \
        .groupBy("host", "c.path").agg(F.first("c.up").alias("up"))
    inside = leaves.join(above, ["host", "path"]).select("host", F.explode("up").alias("path"), "n", "most", "content") \
        .groupBy("host", "path").agg(
            (F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("inside"), F.max("most").alias("most"))
    return inside.join(shown, ["host", "path"]).select(
        "host", "path", "most", F.round(1 - (1 - F.col("shown")) * (1 - F.col("inside")), 9).alias("importance"))


def style_tree(rows: DataFrame, pages: int = PAGES) -> DataFrame:
    """``host, known, branches``: per host the nodes (``path, content``) and branches
    (``path, importance``) whose entropy says something and changes what the prior alone
    would decide.

    Entropy speaks against a node or branch if one text in it is on so many pages, and
    for a node beside an article if the node is. A host with a third of all pages is as
    many rows as it has different texts, and the result grows with the hosts' templates,
    not with their pages.
    """
    marked = F.exists("blocks", lambda b: _is(b, INSIDE))
    leaves = stored(leaf_importance(rows), "html-leaves")
    beside = rows.where(marked).select("host", F.xxhash64("blocks").alias("page"),
                                       F.explode(F.filter("blocks", lambda b: _is(b, PLAIN))).alias("b")) \
        .select("host", "b.path", "page").distinct() \
        .groupBy("host", "path").agg(F.count("*").alias("beside")).where(F.col("beside") >= pages)
    nodes = leaves.join(beside, ["host", "path"], "left") \
        .where(F.col("beside").isNotNull() | (F.col("most") >= pages) & (F.col("content") < UNKNOWN)) \
        .select("host", F.struct("path", "content").alias("node"), F.lit(None).alias("branch"))
    branches = branch_importance(rows, leaves) \
        .where((F.col("most") >= pages) & (F.col("importance") < UNKNOWN)) \
        .select("host", F.lit(None).alias("node"), F.struct("path", "importance").alias("branch"))
    return nodes.unionByName(branches).groupBy("host").agg(
        F.collect_list("node").alias("known"), F.collect_list("branch").alias("branches"))


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
    min_pages: int = PAGES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, url, text``: the main text, blocks joined by an empty line.

    Removed are blocks whose weight by the prior times the importance of a branch
    around them, or of their own node, is under the threshold. The weight is 0 for
    what elements or classes mark as no content (navigation, header, footer, sidebar,
    notices, adverts, forms, scripts, styles, comments), unless a form or a longer name
    with such a word (``notice-board``) stands around a page's only article or all of
    its text. Texts that return on page after page go, sooner beside a marked article
    than elsewhere and latest inside one, and with them whole branches of such texts,
    if they are arranged alike on the host's pages. Beside an article only nodes whose
    texts differ from page to page stay. A node decides as a whole: sentences that many
    articles share, among others that differ, are text. Branches decide nothing on a
    page of which they would leave nothing.

    Null and empty pages, and pages without text, give an empty text. A null url is
    a host of its own, the empty one. Cut-off pages count as far as they go, elements
    nested deeper than 512 as the element above. Repeated rows stay repeated; an empty
    table gives an empty one; other columns are not read.
    """
    rows = stored(parsed(pages, key, url, html), "html-blocks")
    known = stored(style_tree(rows, min_pages), "html-tree")
    marked = F.exists("blocks", lambda b: _is(b, INSIDE))

    def weight(b, marked):
        return F.when(_is(b, INSIDE), IN_ARTICLE).when(~_is(b, PLAIN), 0.0).when(marked, BESIDE).otherwise(UNMARKED)

    def important(marked):
        return F.filter("blocks", lambda b: weight(b, marked) * F.coalesce(
            F.element_at("of_path", b["path"]), F.lit(UNKNOWN)) >= threshold)

    def in_branches(kept):
        # the least importance around each path of the page, where it says something
        of_chain = F.filter(F.transform("chains", lambda c: F.struct(c["path"].alias("path"), F.array_min(
            F.transform(c["up"], lambda u: F.element_at("of_branch", u))).alias("least"))), lambda c: c["least"].isNotNull())

        def stays(b, marked, around):
            return F.coalesce(weight(b, marked) * F.element_at(around, b["path"]) >= threshold, F.lit(True))

        left = let(F.map_from_entries(of_chain), lambda around: let(
            marked, lambda m: F.filter(kept, lambda b: stays(b, m, around))))
        return F.when(F.col("of_branch").isNull(), kept).otherwise(
            let(left, lambda rest: F.when(F.size(rest) > 0, rest).otherwise(kept)))

    known = known.select(
        "host", F.map_from_entries("known").alias("of_path"),
        F.when(F.size("branches") > 0, F.map_from_entries("branches")).alias("of_branch"))
    return rows.join(known, "host", "left").select(
        F.col("key").alias(key), F.col("url").alias(url),
        F.array_join(F.transform(let(let(marked, important), in_branches), lambda b: b["text"]), "\n\n").alias("text"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
