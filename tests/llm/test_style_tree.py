"""The style tree against plain loops over the pages of each host, and what a mark
decides that stands around a whole page."""

import math
import random
from collections import Counter, defaultdict

import pytest
from test_other_operators import pages_of

from tallywright.llm import page_text
from tallywright.llm.page_text import BESIDE, IN_ARTICLE, INSIDE, PAGES, PLAIN, THRESHOLD, UNKNOWN, UNMARKED, outline


def texts(spark, pages, url="https://a.example/x"):
    rows = [(i, url, page) for i, page in enumerate(pages)]
    return [r.text for r in page_text.extract(pages_of(spark, rows)).orderBy("page_id").collect()]


def entropy(counts):
    n = sum(counts)
    return 1.0 if n < 2 else round(-sum(c / n * math.log(c / n) for c in counts) / math.log(n), 9)


def brute(pages):
    """Main texts of the pages of one host."""
    found = [outline(page) for page in pages]
    marked = [any(b[1] == INSIDE for b in f.blocks) for f in found]
    ids = [repr(f.blocks) for f in found]
    seen, shown, beside, up = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for f, page, m in zip(found, ids, marked):
        for path, prior, text in f.blocks:
            if prior in (PLAIN, INSIDE):
                seen[path].add((text, page))
            if m and prior == PLAIN:
                beside[path].add(page)
        for path, presentation in f.nodes:
            shown[path].add((presentation, page))
        up.update(dict(f.chains))
    counts = {path: list(Counter(t for t, _ in s).values()) for path, s in seen.items()}
    content = {path: entropy(c) for path, c in counts.items()}
    below = defaultdict(list)
    for path in counts:
        for branch in up[path]:
            below[branch].append(path)
    known = {p: content[p] for p, c in counts.items()
             if len(beside[p]) >= PAGES or max(c) >= PAGES and content[p] < UNKNOWN}
    branches = {}
    for branch, leaves in below.items():
        inside = sum(sum(counts[p]) * content[p] for p in leaves) / sum(sum(counts[p]) for p in leaves)
        own = entropy(list(Counter(s for s, _ in shown[branch]).values()))
        importance = 1 - (1 - own) * (1 - inside)
        if max(max(counts[p]) for p in leaves) >= PAGES and importance < UNKNOWN:
            branches[branch] = importance
    out = []
    for f, m in zip(found, marked):
        weight = {INSIDE: IN_ARTICLE, PLAIN: BESIDE if m else UNMARKED}
        kept = [b for b in f.blocks if weight.get(b[1], 0) * known.get(b[0], UNKNOWN) >= THRESHOLD]
        left = [b for b in kept if all(weight[b[1]] * branches.get(u, 9) >= THRESHOLD for u in up[b[0]])]
        out.append("\n\n".join(b[2] for b in left or kept))
    return out, known, branches


def site(rng, n):
    """Pages of one host from a few templates, with parts that return and parts that do not."""
    def words(k):
        return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(k))

    links = [words(2) for _ in range(5)]
    fixed = rng.random() < 0.5
    wrapper = rng.choice(["main", "article", "div", "section"])
    pages = []
    for i in range(n):
        menu = "".join(f"<li><b>{t}</b>" for t in (links if fixed else rng.sample(links, rng.randrange(1, 6))))
        extra = f"<p>{words(3)}</p>" if rng.random() < 0.3 else ""
        story = "".join(f"<p>{words(rng.randrange(2, 9))}</p>" for _ in range(rng.randrange(4)))
        side = f"<div class=x><h4>{links[0]}</h4><div><span>{links[1]}</span></div><p>{links[2]}</p>{extra}</div>"
        form = f"<form><p>{words(2)}</p></form>" if rng.random() < 0.2 else ""
        pages.append(f"<body><div id=top><ul>{menu}</ul></div><{wrapper}><h1>{words(2)}</h1>{story}"
                     f"<div><div><i>{links[3]}</i></div><ul><li>{links[4]}<li>{links[0]}</ul></div></{wrapper}>{side}{form}")
    return pages + rng.sample(pages, n // 4)


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    sites = {f"https://s{i}.example/": site(rng, rng.choice([3, 5, 30, 80])) for i in range(6)}
    rows, want, decided = [], {}, 0
    for url, pages in sites.items():
        found, known, branches = brute(pages)
        decided += len(known) * len(branches)
        for page, text in zip(pages, found):
            want[len(rows)] = text
            rows.append((len(rows), url, page))
    assert decided
    got = {r.page_id: r.text for r in page_text.extract(pages_of(spark, rows)).collect()}
    assert got == want


def test_a_branch_goes_as_a_whole(spark):
    def page(i, side):
        return f"<section><h1>Title {i}</h1><p>Story {i}</p></section><div class=x>{side}</div>"

    side = "".join(f"<h{k}>Fixed {k}</h{k}>" for k in range(1, 7)) + "<div><ul><li>Fixed too</ul></div>"
    own = [page(i, f"{side}<blockquote>Only here {i}</blockquote>") for i in range(30)]
    assert texts(spark, own) == [f"Title {i}\n\nStory {i}" for i in range(30)]
    # arranged in another way on each page it is no template, and what differs in it stays
    kinds = ["b", "i", "u", "s", "em"]
    varied = [page(i, f"{side}<blockquote>Only here {i}</blockquote>" + "".join(f"<{k}></{k}>" for j, k in enumerate(kinds) if i >> j & 1))
              for i in range(30)]
    assert texts(spark, varied) == [f"Title {i}\n\nStory {i}\n\nOnly here {i}" for i in range(30)]


def test_boilerplate_without_a_telling_class_goes(spark):
    pages = [f"<div class=q1><div><div>Tea shop</div><div>Open daily</div></div></div><div class=q2><p>Story {i}</p></div>"
             f"<div class=q3><p>Made by us</p></div>" for i in range(12)]
    assert texts(spark, pages) == [f"Story {i}" for i in range(12)]


def test_a_branch_that_is_the_whole_page_stays(spark):
    pages = [f"<div class=x><div>{'<p>So they say</p>' * 3}<h2>Fixed</h2><h3>Fixed too</h3><h1>Day {i}</h1></div></div>" for i in range(40)]
    assert texts(spark, pages) == [f"Day {i}" for i in range(40)]


@pytest.mark.parametrize("page, text", [
    ("<body><form id=aspnet><nav>Menu</nav><h1>Title</h1><p>Text</p><button>Send</button><footer>Us</footer></form>", "Title\n\nText"),
    ("<form><div>Skip</div><article><p>Text</p><form><p>Your comment</p></form></article></form>", "Text"),
    ("<p>Skip</p><div class='notice-board'><article><p>Text</p></article><div class=ad>Buy</div></div>", "Text"),
    ("<div class='ad-free'><p>Text</p></div><div class='ad-box'><p>Buy</p></div>", "Text"),
    ("<div class='widget-area'><p>Text</p></div>", "Text"),
    ("<article><p>Text</p></article><div class='notice-board'><article><p>Notice</p></article></div>", "Text"),
    ("<article></article><form><p>Your name</p></form><div class='ad-box'><p>Buy</p></div>", ""),
    ("<p>Text</p><form><p>Your name</p></form>", "Text"),
    ("<div class=notice><p>Closed</p></div><div class=ad>Buy</div>", ""),
    ("<ol class='comment-list'><li><article><p>First!</p></article></ol>", ""),
    ("<nav><a>Menu</a></nav><footer>Us</footer>", ""),
    ("<div>" * 700 + "<p>Deep</p>" + "</div>" * 700, "Deep"),
])
def test_marks_around_a_whole_page(page, text):
    found = page_text.blocks(page)
    inside = [b for b in found if b[1] == INSIDE]
    assert "\n\n".join(b[2] for b in inside or [b for b in found if b[1] == PLAIN]) == text
