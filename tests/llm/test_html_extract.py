import html
import re

import pytest
from tremor.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div>
<div id="body-text"><h1>Head &amp; line</h1><p>One<br>two  <b>three</b>
four<p>5 &lt; 6 &#233; <!-- no --><div class="ad">Buy</div><ul><li>a<li>b</ul><form>Name<input></form></div>
<section class="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Head & line\n\nOne two three four\n\n5 < 6 é\n\na\n\nb"


def plain(page):
    """The pages' own form, by regular expressions."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h\d)>", body.replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_pages_against_plain_form(spark, sf):
    got = {r.page_id: r for r in H.op10_html_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r.page_id].text == plain(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def run(spark, pages, **options):
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(pages)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), **options)
    return {r.page_id: r.text for r in got.collect()}


def test_slot_without_article(spark):
    pages = [PAGE.replace("four", f"four{i}").replace("Head", f"Head{i}").replace("a<li>b", f"a{i}<li>b{i}").replace("5 &lt;", f"5{i} &lt;") for i in range(6)]
    want = {i: TEXT.replace("four", f"four{i}").replace("Head", f"Head{i}").replace("a\n\nb", f"a{i}\n\nb{i}").replace("5 <", f"5{i} <") for i in range(6)}
    assert run(spark, pages) == want
    assert run(spark, pages, broadcast_bytes=0) == want


ANONYMOUS = (
    "<html><body><div><span>Site</span><div>Home</div><div>About us</div></div><div><div><h2>Title {0}</h2><p>Text of page {0}, one. "
    "<div>Print this</div><p>Text of page {0}, two, which is a good deal longer than the first one was.<p>Rated by readers</div></div><div>Latest: {1}</div><div>All rights reserved</div></body></html>"
)


def anonymous(k):
    return ANONYMOUS.format(k, "abc"[k % 3])


def test_template_alone_tells_the_slot_and_its_constants(spark):
    """No article, no telling tag or name: without the template all text of the body comes."""
    got = run(spark, [anonymous(k) for k in range(9)])
    # a paragraph inside the slot is never a constant of the template, a container with the same text on each page is
    assert got == {k: f"Title {k}\n\nText of page {k}, one.\n\nText of page {k}, two, which is a good deal longer than the first one was.\n\nRated by readers" for k in range(9)}
    assert "Home" in H.extract(anonymous(1), None) and "Print this" in H.extract(anonymous(1), None)


def test_two_layouts_of_a_host(spark):
    other = "<html><body><section>Shop</section><section><div>Goods {0} of the best sort, cheap</div></section><section>Basket</section></body></html>"
    got = run(spark, [anonymous(k) for k in range(6)] + [other.format(k) for k in range(6)])
    assert all(got[k] == f"Title {k}\n\nText of page {k}, one.\n\nText of page {k}, two, which is a good deal longer than the first one was.\n\nRated by readers" for k in range(6))
    assert all(got[6 + k] == f"Goods {k} of the best sort, cheap" for k in range(6))


def test_copies_of_a_page_are_no_template(spark):
    assert set(run(spark, [anonymous(1)] * 5).values()) == {H.extract(anonymous(1), None)}
    got = run(spark, [anonymous(1)] * 20 + [anonymous(k) for k in range(2, 8)])
    assert got[3] == "Title 1\n\nText of page 1, one.\n\nText of page 1, two, which is a good deal longer than the first one was.\n\nRated by readers"


def test_names_leave_the_authors_text():
    kept = '<body><div class="has-sidebar"><article><div class="search-method"><p>Binary search explained.</p></div><header class="x">Top</header><div class="share"><p>Share of votes</p></div><div class="ad">Buy</div></article></div></body>'
    assert H.extract(kept, None) == "Binary search explained.\n\nShare of votes"
    assert H.extract('<body class="menu"><div class="comments"><article>Text</article></div></body>', None) == "Text"
    assert H.extract('<body><div class="sidebar"><p>Nearly all of the text of this page</div><p>x</body>', None) == "Nearly all of the text of this page\n\nx"


def test_attributes_of_any_length_and_kind():
    for value in (f'"{"a" * 5000}>leak"', f"'{'a' * 5000}>leak\"'", "it's", "a>", ""):
        assert H.extract(f"<p data-x={value}>hello</p>", None) in ("hello", ">hello")
    assert H.extract('<p data-x="' + "a" * 5000 + '>leak">hello</p>', None) == "hello"
    assert H.extract('<p data-class="ad" title="class=ad">kept <b hidden>no</b><i data-hidden>yes</i>', None) == "kept yes"


def test_inline_script_is_no_block():
    assert H.extract("<p>one <script>x</script>two <svg><g>y</g></svg>three", None) == "one two three"


@pytest.mark.parametrize("page", ["", "no tags", "a < b", "<", "</p>", "<p", "<p>x", "<a href='", '<a b="', "<script>x", "<!--", "<div><p>a</div>b"])
def test_odd_markup(page):
    assert isinstance(H.extract(page, None), str)


def test_edges(spark):
    big = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, None, None, "x"), (None, "http://a/b", "", "y"), (2, "http://a/c", big, "z"), (2, "http://a/c", big, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in H.extract_text(pages).collect())
    assert got == [(0, 0), (1, 0), (2, 6 * 30_000 - 2), (2, 6 * 30_000 - 2)]
    assert H.extract_text(pages.where("false")).collect() == []


def test_odd_and_empty_pages_leave_the_layout(spark):
    """One listing, one empty, one null and one truncated page must not switch the template of the host off."""
    plain_div = '<html><body><div id="text"><h1>T{0}</h1><p>' + "Long words of page {0}. " * 20 + '</p></div><div class="teasers"><p>More</p></div></body></html>'
    article = plain_div.replace('<div id="text">', "<article>").replace("</p></div><div", "</p></article><div")
    for n, page in enumerate((plain_div, article)):
        odd = ["<html><body><ul><li>One<li>Two</ul></body></html>", "", None, "<html><body>"]
        rows = [(i, f"http://h{n}.example/{i}", x) for i, x in enumerate([page.format(k) for k in range(8)] + odd)]
        got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert all(got[k] == f"T{k}\n\n" + " ".join([f"Long words of page {k}."] * 20) for k in range(8))
        assert got[8] == "One\n\nTwo" and not got[9] and not got[10] and not got[11]


@pytest.mark.parametrize("element", ["article", "div id=text"])
def test_slots_deeper_than_the_named_path(spark, element):
    deep = "<html><body>" + "<div>" * 20
    page = deep + f"<{element}><h2>T{{0}}</h2><p>" + "Long words. " * 20 + f"<p>End</{element.split()[0]}><div class=w-1/2><p>Beside</div>" + "</div>" * 20 + "</body></html>"
    pages = spark.createDataFrame([(i, "http://h.example/", page.format(i)) for i in range(4)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert got == {i: f"T{i}\n\n" + " ".join(["Long words."] * 20) + "\n\nEnd" for i in range(4)}


RECIPE = (
    "<html><body><nav>Menu</nav><div class=top>Kitchen</div>{0}<h1>Dish {2}</h1><h2>Ingredients</h2><ul><li>Salt<li>{2} spoons of thing {2}</ul><h2>Method</h2><p>Stir thing {2} for {2} minutes, "
    "then let it rest on the table.</p><p>Serve warm.</p>{1}<div class=end>All recipes</div></body></html>"
)


@pytest.mark.parametrize("slot", [("<article>", "</article>"), ("<div id=recipe>", "</div>")])
def test_headings_that_pages_share_are_text(spark, slot):
    got = run(spark, [RECIPE.format(*slot, k) for k in range(12)])
    want = "Dish {0}\n\nIngredients\n\nSalt\n\n{0} spoons of thing {0}\n\nMethod\n\nStir thing {0} for {0} minutes, then let it rest on the table.\n\nServe warm."
    assert got == {k: want.format(k) for k in range(12)}


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p title="a hidden gem">One</p>', "One"), ('<p style="overflow: hidden !important">One</p>', "One"), ('<article class="hidden md:block"><p>One</article>', "One"), ("<p hidden>No<p hidden=''>No<p HIDDEN=hidden>No<p>One", "One"),
        ('<p data-x=hidden>One</p>', "One"), ('<p title=\'class="ad"\'>One</p>', "One"), ('<p title="it\'s hidden">One</p>', "One"),
        ('<form id="aspnetForm"><article><p>One</p><input><button>Go</button></article></form>', "One"), ('<form><div><p>One is long enough</p></div></form><div>x</div>', "One is long enough\n\nx"), ("<p>One of some length</p><form><p>Name</p></form>", "One of some length"),
        ("<form><label>Name</label></form>", ""), ("<article><p>One</article><article><p>Two</article>", "One\n\nTwo"), ("<main><article><p>One<article><p>Reply</article></article><article><p>Other</article></main>", "One\n\nReply\n\nOther"),
        ("<article><p>" + "Long text. " * 20 + "</article><article>Teaser</article>", " ".join(["Long text."] * 20)), ("<p>One<!-->Two<!--->Three<!-- x --!>Four<!-- --></p>", "OneTwoThreeFour"), ("a<!-- open", "a"),
    ],
)
def test_what_is_left_out_and_what_is_not(page, text):
    assert H.extract(page, None) == text
