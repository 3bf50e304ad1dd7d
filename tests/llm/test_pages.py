import random

import pytest

from tessella.llm import pages
from tessella.llm.pages import blocks, common_lines, extract

HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>No & title</title><style>p{}</style><script>var t="</p>";</script></head><body>'


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id bigint, url string, html string, text string, id int")
    return {r.page_id: r.text for r in extract(df).collect()}


def test_marked_article(spark):
    page = HEAD + '<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy</div><article><h1>Ti&amp;tle  &eacute;&#33;</h1><p><b>One\n two.<br><p>Three</p><aside>side</aside><p class="notice">note</p><div id="comments"><p>I like</p></div><p>Four</p><form><p>mail</p></form></article><footer>&copy; host</footer></body></html>'
    assert run(spark, [(1, "http://h.example/a/1", page)]) == {1: "Ti&tle é!\nOne two.\nThree\nFour"}


def test_odd_markup():
    text = lambda page: [t for t, _ in blocks(page)]
    assert text("plain & text") == ["plain & text"]
    assert text('<div class="ad">never closed<article><p>story</article>after') == ["story"]
    assert text("<p a='>'>x</p><!-- never closed <p>y") == ["x"]
    assert text("<script>never closed <p>y") == []
    assert text("a < b <p>c") == ["a < b", "c"]
    assert text('<ul><li class="ad">no<li>yes</ul>') == ["yes"]
    assert text('<section class="comments"><article><p>no</p></article></section><main><header><h1>t</h1></header>b</main>') == ["t", "b"]
    assert text("<p>x&nbsp;y&am</p>") == ["x y&am"]
    assert text("<" * 5000) == ["<" * 5000] and len(text("<p>w</p>" * 20000)) == 20000


def test_names_that_are_no_furniture():
    text = lambda page: [t for t, _ in blocks(page)]
    assert text('<div class="wrapper has-sidebar"><p>Story text</p></div>') == ["Story text"]
    assert text('<article><div class="content-with-sidebar"><p>Story</p></div></article>') == ["Story"]
    assert text('<main><section id="social-history"><p>History</p></section></main>') == ["History"]
    assert text('<article class="post has-comments"><p>A</p><div class="comment-list"><p>c</p></div></article>') == ["A"]
    assert text('<div class="entry-header"><h1>Title</h1></div><div id="site-header">Name</div><p>x</p>') == ["Title", "x"]
    assert text('<div class="ad-box">a</div><div class="cookie_notice">b</div><ul id="share-buttons-2"><li>c</ul><p style="display: none">d</p><p>x</p>') == ["x"]


def test_forms_around_the_text():
    text = lambda page: [t for t, _ in blocks(page)]
    assert text("<body><form id=aspnet><h1>T</h1><p>Story</p><input><button>Go</button></form><form><p>Your mail</p></form></body>") == ["T", "Story"]


def test_menu_lines_of_short_pages_go(spark):
    menu = "".join(f"<div>Menu line {i} of the site</div>" for i in range(10))
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}<div>Item {i}</div></body></html>") for i in range(6)]
    assert run(spark, rows) == {i: f"Item {i}" for i in range(6)}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "<p>down here</p>" + "</div>" * 20_000
    long = "<main>" + "".join(f"<p>Line {i}</p>" for i in range(30_000)) + "</main>"
    got = run(spark, [(1, "http://a.example/1", deep), (2, "http://a.example/2", long), (3, "http://b.example/2", long), (None, None, "<p>no id</p>"), (None, None, "<p>no id</p>")])
    assert got[1] == "down here" and got[2] == got[3] == "\n".join(f"Line {i}" for i in range(30_000)) and got[None] == "no id"


def test_differencing(spark):
    page = lambda body: f"<html><body><div>Site name</div><div>Top stories</div>{body}<div>Contact us</div></body></html>"
    rows = [(i, f"http://h.example/news/{i}", page(f"<div>Story {i} is a longer text of its own, all {i * 7919} words.</div>")) for i in range(10, 40)]
    rows += [(50, "http://other.example/z", page("<div>alone</div>")), (60, None, None), (61, "", ""), (62, "http://c.example/1", page("<p>the very same page</p>")), (63, "http://c.example/2", page("<p>the very same page</p>"))]
    got = run(spark, rows)
    assert all(got[i] == f"Story {i} is a longer text of its own, all {i * 7919} words." for i in range(10, 40))
    assert got[50] == "Site name\nTop stories\nalone\nContact us" and got[60] == got[61] == ""
    assert got[62] == got[63] == "Site name\nTop stories\nthe very same page\nContact us"


def test_marked_pages_are_differenced(spark):
    page = lambda body: f"<html><body><article><h1>Head {body[:9]}</h1><div class='zq'>Tell a friend</div>{body}</article></body></html>"
    shared = "<p>a quotation that two of the articles have in common</p>"
    rows = [(i, f"http://h.example/n/{i}", page(f"{i} own words {i * 7919} of a story {i * 31}" + (shared if i in (12, 13) else ""))) for i in range(10, 22)]
    got = run(spark, rows)
    assert not any("Tell a friend" in x for x in got.values())
    assert all("a quotation that two" in got[i] for i in (12, 13)) and all(f"{i} own words" in got[i] for i in range(10, 22))
    copies = [(i, f"http://c.example/{i}", page("<p>the same long story on every page</p>" + f"<p>{i}</p>")) for i in range(6)]
    assert all("the same long story" in x for x in run(spark, copies).values())


def test_differencing_looks_past_copies(spark):
    heavy = "".join(f"<div>Furniture line number {i} of the site</div>" for i in range(20))
    rows = [(i, f"http://h.example/n/{i}", f"<html><body>{heavy}<p>Story {i if i < 20 else 20}</p></body></html>") for i in range(10, 60)]
    got = run(spark, rows)
    assert all(got[i] == f"Story {min(i, 20)}" for i in range(10, 60))


@pytest.mark.parametrize("cells", [pages.CELLS, 20])
def test_common_lines_is_longest(cells, monkeypatch):
    monkeypatch.setattr(pages, "CELLS", cells)
    rng = random.Random(1)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = common_lines(a, b)
        it = iter(b)
        assert got == sorted(set(got)) and len(got) == longest(a, b) and all(any(a[i] == x for x in it) for i in got)


def test_empty_table(spark):
    assert run(spark, []) == {}
