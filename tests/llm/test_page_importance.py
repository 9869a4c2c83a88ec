"""What the style tree decides on copies, with and without a marked article."""

from test_other_operators import pages_of

from tallywright.llm import page_text


def texts(spark, pages, url="https://a.example/x"):
    rows = [(i, url, page) for i, page in enumerate(pages)]
    return [r.text for r in page_text.extract(pages_of(spark, rows)).orderBy("page_id").collect()]


def test_copies_of_a_page_are_no_template(spark):
    page = "<h1>Title</h1><section><p>One</p><p>Two</p></section><ul><li>so<li>so<li>so<li>so</ul>"
    whole = "Title\n\nOne\n\nTwo\n\nso\n\nso\n\nso\n\nso"
    assert texts(spark, [page] * 30, None) == [whole] * 30
    assert texts(spark, [page]) == [whole]
    others = [f"<div><span>Menu</span></div><section><p>Story {i}</p></section>" for i in range(9)]
    assert texts(spark, [page] * 30 + others) == [whole] * 30 + [f"Story {i}" for i in range(9)]


def test_boilerplate_inside_main_goes(spark):
    for name in ("main", "article"):
        pages = [f"<{name}><div><span>Follow us</span></div><p>Story {i}</p><p>So they say.</p></{name}>" for i in range(9)]
        assert texts(spark, pages) == [f"Story {i}\n\nSo they say." for i in range(9)]
        assert texts(spark, pages[:2])[0] == "Follow us\n\nStory 0\n\nSo they say."


def test_main_text_beside_the_article_stays(spark):
    pages = [
        f"<div><span>Menu</span></div><section><h1>Heading {i}</h1><p>Lead {i}</p></section>"
        f"<article><p>Story {i}</p></article><div><b>Made by us</b></div>" for i in range(9)]
    assert texts(spark, pages) == [f"Heading {i}\n\nLead {i}\n\nStory {i}" for i in range(9)]
    assert texts(spark, pages[:1] * 9) == ["Story 0"] * 9


def test_pages_without_an_article_beside_pages_with_one(spark):
    pages = [f"<div><b>Made by us</b></div><section><p>Part {i}</p></section>" for i in range(6)]
    pages += [f"<div><b>Made by us</b></div><article><p>Story {i}</p></article>" for i in range(6)]
    assert texts(spark, pages) == [f"Part {i}" for i in range(6)] + [f"Story {i}" for i in range(6)]
