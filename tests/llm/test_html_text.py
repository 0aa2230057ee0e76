import hashlib
import itertools
import time

import pytest

from geoseries.llm import dom, html_text

SHELL = (
    "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
    "<header><h1>Site</h1></header><nav><ul><li><a href=/x>Home</a></ul></nav><div class=ad>Buy</div><div id='cookie-notice'>OK?</div>{}"
    "<aside>More</aside><form><p>Mail</p></form><section class='comments'><p>First!</p></section><footer>&copy; x</footer></body></html>"
)
CASES = {
    "": "",
    "<article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</b> &lt;x&gt;</article>": "A & B\n\none two\n\nthree four <x>",
    "<ARTICLE><P CLASS='x>y'>a<!-- no > --> b</P><ul><li>c<li>d</ul><blockquote>e</blockquote></ARTICLE>": "a b\n\nc\n\nd\n\ne",
    "<main><p>a &nbsp; b&amp c &am; &#233;</p><div class='share'>Tweet</div><p></p></main>": "a b& c &am; é",
    "<article><p>x 1 < 2 and 3 > 2</p><p>cut <b": "x 1 < 2 and 3 > 2\n\ncut",
    "<div><div class=post><p>" + "long text " * 20 + "</p><p>end</p></div></div><p>note</p>": ("long text " * 20).strip() + "\n\nend",
    "plain words": "plain words",
    "<article><header><h1>Title</h1></header><p>t</p><script>x</article>": "Title\n\nt",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text(html):
    assert html_text.text_of(html) == CASES[html]
    if html.startswith("<") and "<script>x" not in html and not html.endswith("<b"):
        assert html_text.text_of(SHELL.replace("{}", html)) == CASES[html]


def plain_matching(a, b):
    """Best order-keeping matching by trying every choice of children pairs."""
    if a.tag != b.tag:
        return 0
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for xs in itertools.combinations(a.kids, n):
            for ys in itertools.combinations(b.kids, n):
                weights = [plain_matching(x, y) for x, y in zip(xs, ys)]
                best = max(best, sum(weights))
    return best + 1


def test_matching_by_brute_force():
    pages = ["<div><p>a<p>b<ul><li>c<li>d</ul></div>", "<div><ul><li>x</ul><p>y</div><p>z", "<ul><li>1<li>2</ul><div><p>q<div><p>r</div></div>", "t", ""]
    for a, b in itertools.product(map(dom.parse, pages), repeat=2):
        pairs = dom.align(a, b)
        assert len(pairs) == plain_matching(a, b)
        assert all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_attributes_of_any_length():
    """A quoted value ends at its quote, however long it is and whatever it holds; one without a partner costs no square."""
    long = "x > y < z " * 5000
    page = f"<article><p title=\"{long}\" data-x='<b>{long}</b>'>one</p><p {'a=1 ' * 1000}>two</p></article>"
    assert html_text.text_of(page) == "one\n\ntwo"
    assert html_text.text_of("<article><p>a</p>" + "<p title='>b</p>" * 20_001) is not None
    assert html_text.text_of("<article><p>a</p><p title='x>b</p></article>") == "a\n\nb"


def test_deep_trees_are_matched_whole():
    """Differences below any depth are aligned, and equal neighbours of wide elements cost no table."""
    start = time.perf_counter()
    deep = ["<div>" * 400 + f"<p>{t}</p><ul><li>x</ul>" * n + "</div>" * 400 for t, n in (("a", 2), ("b", 3))]
    a, b = map(dom.parse, deep)
    assert len(dom.align(a, b)) == dom.matched(a, b) == a.size
    wide = ["<div>" + "<section><p>t</p></section>" * 3000 + extra + "<aside>u</aside>" * 3000 + "</div>" for extra in ("", "<ul><li>v</ul>")]
    a, b = map(dom.parse, wide)
    assert len(dom.align(a, b)) == a.size and time.perf_counter() - start < 20


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)


def test_template_is_learned_per_host(pages):
    note = "<article><h1>Story {0}</h1><p>This site uses no trackers.</p><p>Words of story {0}.</p></article>"
    rows = [(i, f"http://one.example/{i}", note.format(i)) for i in range(8)] + [(20 + i, f"http://two.example/{i}", note.format(i)) for i in range(2)]
    rows += [(40 + i, "http://copies.example/a", note.format(0)) for i in range(9)]  # copies of one page are no template
    got = {r.page_id: r for r in html_text.extract(pages(rows)).collect()}
    for i in range(8):
        assert got[i].text == f"Story {i}\n\nWords of story {i}."
    for i in range(2):
        assert got[20 + i].text == f"Story {i}\n\nThis site uses no trackers.\n\nWords of story {i}."
    assert got[48].text == "Story 0\n\nThis site uses no trackers.\n\nWords of story 0."
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_rows(pages):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "no url", ""), (2, "no url", ""), (None, "http://h/", "<p>x</p>"), (3, "http://h/", deep), (4, "http://h/", "<" * 50_000), (5, "http://h/", "<p a='" * 20_000), (6, "HTTP://H/", "word " * 200_000)]
    got = html_text.extract(pages(rows)).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[1, None] == texts[2, "no url"] == "" and texts[None, "http://h/"] == "x" and texts[3, "http://h/"] == "deep"
    assert texts[6, "HTTP://H/"] == ("word " * 200_000).strip()
    assert html_text.extract(pages([])).collect() == []


def _words(name, i, n):
    return " ".join(f"{name}{i}x{k}" for k in range(n))


def test_node_statistics_choose_the_main_node(pages):
    # no listed tag or class; link lists and notices differ from page to page, and two layouts order them differently
    def page(i):
        links = "<div class=q1><div>" + "".join(f"<a href=/{i}{k}>{_words('l', i * 9 + k, 2)}</a> " for k in range(5)) + "</div></div>"
        story = f"<div class=q2><h1>{_words('t', i, 3)}</h1><div class=q3>{{}}<p>{_words('s', i, 4 if i % 5 == 0 else 90)}</p></div></div>"
        inner = f"<div class=q4><a href=/r>{_words('r', i, 4)}</a></div>"
        notice = f"<div class=q5><p>{_words('n', i, 20)}</p></div>"
        parts = [links, notice, story.format(inner)] if i % 3 else ["<section>" + story.format(inner) + "</section>", links, notice]
        return "<html><body>" + "".join(parts) + "</body></html>"

    rows = [(i, f"http://plain.example/{i}", page(i)) for i in range(24)]
    for r in html_text.extract(pages(rows)).collect():
        i = r.page_id
        assert r.text == f"{_words('t', i, 3)}\n\n{_words('s', i, 4 if i % 5 == 0 else 90)}"


def test_template_does_not_hang_on_one_page(pages):
    # the page with the smallest digest is an error page; the note is on 7 of 11 pages
    note = "<p>Send letters to the editor.</p>"
    bodies = [f"<div><div><p>Words of story {i}.</p>{note if i < 7 else ''}</div></div>" for i in range(10)]
    least = min(hashlib.md5(b.encode()).hexdigest() for b in bodies)
    bodies.append(next(b for b in (f"<p>Error {k}</p>" for k in range(10_000)) if hashlib.md5(b.encode()).hexdigest() < least))
    got = {r.page_id: r.text for r in html_text.extract(pages([(i, "http://e.example/", b) for i, b in enumerate(bodies)])).collect()}
    assert [got[i] for i in range(10)] == [f"Words of story {i}." for i in range(10)] and got[10].startswith("Error")
