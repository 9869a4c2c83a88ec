"""Pages, urls, vectors and the pipeline."""

import hashlib
import html as entities
import re

import brute
import numpy as np
import pytest

import corpus_pipeline
from tallywright.llm import exact_search, langid, page_text, tree_search, urls
from tallywright.llm.queries import LLM_QUERIES, LLM_SQL

PAGES = "page_id long, url string, html string, key int, path int, host int, blocks int, rule int, verdict int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, 2, 3, 4, 5, 6) for i, u, h in rows], PAGES)


# -- page text --------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ("<article><h1>A&amp;B</h1><p>one\n  two<p>three<br>four</article>", "A&B\n\none two\n\nthree four"),
    ("<nav>n</nav><main><p>x<script>var a='</p>'</script>y</p><form>f</form></main><footer>z</footer>", "xy"),
    ("<article><p>a</p><div class='comments'><p>c</p></div><aside>s</aside></article>", "a"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a hre", "cut"),
    ("<article><header><h1>T</h1></header><p>b</p></article><div id=cookie-notice>ok</div>", "T\n\nb"),
    ("<p>a<!-- <p>no -->b</p><p>c < d &lt; &#101;</p>", "ab\n\nc < d < e"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "1\n\n2\n\nx\n\ny"),
    ("<div class='content-sidebar-wrap has-comments'><article class='post no-sidebar'>a</article></div>", "a"),
    ("<article>a</article><article class='comment'>b</article><div id='footerWrap'>c</div>", "a"),
    ("<article><p>a <span class='ad'>x</span>b <button>go</button></p></article>", "a b"),
    ("<ARTICLE><P STYLE='display: none'>h</P><p>v</p></ARTICLE>", "v"),
    (None, ""), ("", ""), ("<style>p{}</style>", ""), ("<", "<"), ("<article><p>" + "w " * 50_000, ("w " * 50_000).strip()),
])
def test_blocks(page, text):
    found = page_text.blocks(page or "")
    inside = [b for b in found if b[1] == page_text.INSIDE]
    assert "\n\n".join(b[2] for b in inside or [b for b in found if b[1] == page_text.PLAIN]) == text


def test_style_tree_removes_what_returns(spark):
    """Pages without a marked article: blocks that return on a host's pages go."""
    rows = [(i, "https://a.example/x", f"<div><span>Menu of the site</span></div><section><p>Story {i}</p></section>") for i in range(9)]
    rows += [(100, "https://b.example/", "<div><span>Menu of the site</span></div><section><p>Alone</p></section>")]
    got = {r.page_id: r.text for r in page_text.extract(pages_of(spark, rows)).collect()}
    assert got == {**{i: f"Story {i}" for i in range(9)}, 100: "Menu of the site\n\nAlone"}


def test_page_text_of_awkward_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>t</p>"), (3, None, "<p>t</p>"), (None, "http://h/", "<p>u</p>")]
    out = page_text.extract(pages_of(spark, rows))
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in out.collect()) == [
        (0, "http://h/", "u"), (1, "", ""), (2, "x", ""), (3, "", "t"), (3, "", "t")]
    assert page_text.extract(pages_of(spark, [])).count() == 0


def test_op3(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = page_text.op3_html(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        begin, end = page.find("<article>") + 9, page.find("</article>")
        body = page[begin:end if end >= 0 else len(page)].replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text)


# -- urls -------------------------------------------------------------------------


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://example.net", "example.net", "", None, None),
    ("x://sub.example.com/de/a://b", "sub.example.com", "/de/a://b", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("http://h?q=/en/", "h", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
])
def test_rules(spark, url, host, path, rule, verdict):
    said, name = urls.rule_columns()
    row = urls.with_parts(pages_of(spark, [(1, url, "")]).select("page_id", "url")) \
        .select("host", "path", said.alias("r"), name.alias("v")).first()
    assert tuple(row) == (host, path, rule, verdict)


def test_regression_learns(spark):
    words = ["shop", "cart", "deal"], ["news", "wiki", "paper"]
    rows = [(k * 500 + i, f"http://{words[k][i % 3]}{i}.test/{words[k][(i + 1) % 3]}/{i}", "") for k in range(2) for i in range(200)]
    pages = pages_of(spark, rows)
    labelled = urls.with_parts(pages.where("page_id % 2 = 0").select("page_id", "url")) \
        .selectExpr("host", "path", "if(page_id < 500, 'block', 'allow') AS verdict")
    out = urls.judge(pages, labelled=labelled).collect()
    right = [r.verdict == ("block" if r.page_id < 500 else "allow") for r in out if r.page_id % 2]
    assert sum(right) >= 0.95 * len(right)


def test_urls_of_awkward_rows(spark):
    rows = pages_of(spark, [(1, None, ""), (1, None, ""), (None, "http://x.net/a", ""), (2, "http://y/" + "ab" * 50_000, "")])
    out = urls.judge(rows)  # labels of one verdict only
    assert sorted((r.page_id or 0, r.verdict) for r in out.collect()) == [(0, "block"), (1, "block"), (1, "block"), (2, "block")]
    assert urls.judge(pages_of(spark, [(1, None, "")])).first().verdict == "allow"
    assert urls.judge(pages_of(spark, [])).count() == 0


def test_op5_reruns_agree(spark, folder):
    once, again = (LLM_QUERIES["op5_url_filter"](spark, folder) for _ in range(2))
    assert once.count() == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert once.exceptAll(again).count() == 0
    assert "Python" not in once._jdf.queryExecution().toString()


# -- vectors ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, key int, vector int, score int"


def table_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items()}


@pytest.fixture(scope="module")
def awkward_folder(spark, tmp_path_factory):
    """Ties, equal vectors, nulls, non-finite components, zeros, repeated ids."""
    inf, nan = float("inf"), float("nan")
    rows = [(i, [0.25 * (i % 3), -0.5, 0.125 * (i % 2)]) for i in range(60)]
    rows += [(100, None), (120, [0.1, None, 0.2]), (140, [inf, 0.0, 0.0]), (160, [nan, 0.0, 0.0]),
             (180, [0.0, 0.0, 0.0]), (61, [0.5, 0.5, 0.5]), (61, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0])]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{path}/none/embeddings.parquet")
    return path, [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]


def test_exact_search_of_awkward_rows(spark, awkward_folder):
    path, rows = awkward_folder
    ids, vectors = [i for i, _ in rows], brute.integer_vectors([v for _, v in rows])
    got = table_of(exact_search.op1_exact_topk(spark, path))
    assert set(got) == {0, 20, 40, 180}
    for q in got:
        assert got[q] == brute.nearest(ids, vectors, ids.index(q), 20)
    assert exact_search.op1_exact_topk(spark, f"{path}/none").count() == 0


def test_tree_search_of_awkward_rows(spark, awkward_folder):
    path, rows = awkward_folder
    rows = [(i, v) for i, v in rows if any(v)]
    ids, vectors = [i for i, _ in rows], np.array([v for _, v in rows])
    got = table_of(tree_search.op7_tree_search(spark, path))
    assert set(got) == {0, 20, 40}
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        of = dict(zip(ids, vectors))
        assert all(s == (of[i] * of[q]).sum() for i, s in got[q])
    assert tree_search.op7_tree_search(spark, f"{path}/none").count() == 0


def test_lists_are_full(spark):
    """Few rows, small clusters, and rows that repeat a query's key."""
    random = np.random.default_rng(4)
    few = [(i, random.normal(size=6).tolist()) for i in range(45)]
    centres = random.normal(size=(40, 6)) * 20
    clustered = [(i, (centres[i % 40] + random.normal(size=6) * 0.01).tolist()) for i in range(600)]
    for rows in (few, clustered, clustered + [(0, clustered[0][1])] * 30):
        frame = spark.createDataFrame(rows, "key long, vector array<double>")
        got = table_of(tree_search.search(frame, frame.where("key % 20 = 0"), recall=0.5))
        others = lambda q: sum(k != q for k, _ in rows)
        assert {q: len(found) for q, found in got.items()} == {q: min(20, others(q)) for q, _ in rows if q % 20 == 0}


def test_searches_of_a_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    whole = brute.integer_vectors(vectors)
    exact, near = (table_of(LLM_QUERIES[n](spark, folder)) for n in ("op1_exact_topk", "op7_tree_search"))
    hits = total = 0
    for at, q in enumerate(ids):
        if q % 20 == 0:
            assert exact[q] == brute.nearest(ids, whole, at, 20)
            true = {i for i, _ in brute.nearest(ids, vectors, at, 20)}
            hits, total = hits + len(true & {i for i, _ in near[q]}), total + len(true)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_queries_equal_their_sql(spark, folder, name):
    import compare

    assert compare.differences(LLM_QUERIES[name](spark, folder), compare.connect(folder), LLM_SQL[name]) == ""


def test_blocks_of_rows_and_queries(spark):
    """Several blocks on both sides give what one block gives."""
    rows = spark.range(300).selectExpr("id AS key", "array(0, 1, int(2 + id % 3)) AS terms", "array(id % 7, -(id % 5), 3L) AS weights")
    asked = rows.where("key % 20 = 0")
    assert table_of(exact_search.search(rows, asked, row_block=40, query_block=4)) == table_of(exact_search.search(rows, asked))


# -- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, folder, documents):
    """Each stage against plain loops over its own input."""
    import public_tokenizers
    import tiktoken

    texts = lambda frame: {r.doc_id: r.text for r in frame.collect()}
    stages = dict(corpus_pipeline.STAGES)
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "123 !!", "en", "src0", 6), (10**6 + 2, "xqzv kjwq zxcv", None, "src0", 14),
           (10**6 + 3, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", None, "src0", 10)]
    docs = spark.createDataFrame([*documents.orderBy("doc_id").take(120), *odd], documents.schema)
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    assert set(texts(known)) == set(texts(docs)) - {r[0] for r in odd}  # the learned languages stay, all of them
    known = spark.createDataFrame(known.collect(), docs.schema)
    lined = stages["line_dedup"](spark, known, folder)
    want = {k: t for (k, _), (t, _) in brute.without_chunks(list(texts(known).items())).items() if t}
    assert texts(lined) == want and {r.n_chars for r in lined.collect()} == {len(t) for t in want.values()}
    lined = spark.createDataFrame(lined.collect(), docs.schema)
    single = stages["simhash_near_dedup"](spark, lined, folder)
    roots = brute.near_components({k: brute.fingerprint(t) for k, t in want.items()})
    assert texts(single) == {k: want[k] for k in want if roots[k] == k}
    single = spark.createDataFrame(single.collect(), docs.schema)
    mixed = stages["mixing"](spark, single, folder).collect()
    sizes, of = {}, {r.doc_id: r for r in single.collect()}
    for r in of.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text))
    rate = {s: t / sizes[s] for s, t in brute.targets(sizes).items()}
    times = {k: 0 for k in of}
    for r in mixed:
        assert r == of[r.doc_id]
        times[r.doc_id] += 1
    assert all(np.floor(rate[of[k].source] + 1e-9) <= n <= np.ceil(rate[of[k].source] - 1e-9) for k, n in times.items())
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    from tallywright.llm.bpe import read_ranks
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    for r in stages["byte_bpe"](spark, single, folder).collect():
        assert r.ids == tokenizer.encode_ordinary(of[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(of[r.doc_id].text.encode()).hexdigest()


def test_pipeline_of_nothing(spark, nothing, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
    assert langid.learn(nothing)[0] == []
