import html
import itertools
import random
import re

from pyspark.sql import functions as F

from skygauge.llm import html_extract as extract
from skygauge.llm.queries import op2

TABLES = "/root/testdata/sf0.001"


def cost(label, odds, edges):
    wrong = sum(abs(o) for o, l in zip(odds, label) if o and l != (o > 0))
    return wrong + sum(w for i, j, w in edges if label[i] != label[j])


def test_cuts_cost_least():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(7)) for _ in range(rng.randrange(2 * n))]
        found = extract.minimum_cut(odds, edges)
        costs = {l: cost(l, odds, edges) for l in itertools.product((False, True), repeat=n)}
        assert cost(found, odds, edges) == min(costs.values())


def test_long_pages_take_little_time():
    page = "<body><div>" + "<p>Some words here, and more of them.</p><li><a href=x>go</a></li>" * 30000 + "<" * 1000 + "<a b='" * 20000
    assert extract.main_text(page).count("\n") > 1000
    assert extract.main_text("<div>" * 50000 + "<article>deep" + "</div>" * 50000) == "deep"


def test_parts_of_a_page():
    page = """<!DOCTYPE html><html class="sidebar"><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <script>var a = "</p><article>no</article>";</script><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav><!-- <article>no</article> -->
    <div class="cookie-notice">We use cookies, do you agree?</div>
    <main><article><header><h1>The &amp;  title</h1></header><p>First <b>para&shy;graph</b>,<br>with a  line.<p>Second &lt;p&gt; &#8212; &eacute;
    <div class="share-buttons">Share this now.</div><form><input value="x">Your mail, please.</form>
    <blockquote>Quoted<span> text</span>.</blockquote><ul><li>One</li><li>Two</li></ul><p style="display: none">Hidden.</p>
    <table><tr><td>Cell 1<td>Cell 2</table></article><section id="comments"><p>A reader says a long thing, with commas.</p></section></main>
    <aside>Most read stories of the week.</aside><div id="ad-3"><p>Buy these fine things today, only here.</p></div>
    <footer>&copy; Us. All rights.</footer></body></html>"""
    assert extract.main_text(page).split("\n") == [
        "The & title", "First para­graph, with a line.", "Second <p> — é", "Quoted text.", "One", "Two", "Cell 1", "Cell 2"]


def test_pages_without_customary_names():
    page = ("<div><a href=1>Start</a> <a href=2>About us</a></div><div><h2>A heading</h2><p>This is a paragraph of some length, with "
            "several words in it.</p><p>Short one.</p><p>And another paragraph that goes on for a while, as such do.</p></div>"
            "<div><a href=3>Imprint</a> | <a href=4>Terms</a></div>")
    assert extract.main_text(page).split("\n") == [
        "A heading", "This is a paragraph of some length, with several words in it.", "Short one.",
        "And another paragraph that goes on for a while, as such do."]


def test_odd_pages():
    for page in ("", " ", "<", "<>", "</>", "<a", "<!--", "<script>", "&", "<p", "</p></div>", "<![CDATA[x", "<a b=\"c>"):
        assert extract.main_text(page) in ("", "x", "<", "<>", "&")


def plain(page):
    """The tables' pages have one article element with headings and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_query_over_the_tables_pages(spark):
    pages = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    rows = op2(spark, TABLES).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id, r.url]) and r.n_chars == len(r.text)


def test_training_and_odd_tables(spark):
    frame = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "<p>x", 1), (3, "", 2)], "page_id long, html string, text int")
    assert extract.train(frame) == extract.PRIOR
    assert sorted(str(r.id) for r in extract.extract_text(frame).collect()) == ["1", "1", "3", "None"]
    assert extract.extract_text(frame.where(F.lit(False))).count() == 0
    fitted = extract.train(spark.read.parquet(f"{TABLES}/pages.parquet"))
    assert len(fitted) == len(extract.PRIOR) and fitted != extract.PRIOR and fitted[2] < 0


LONG = [f"This is paragraph {i} of a long story, which goes on for a good many words, as a story in a paper commonly does, "
        "until it has said what there is to say about the matter. Then it goes on, for the matter has more sides than one, and whoever "
        "reads that far may want to know of all of them, or at least of those that count." for i in range(4)]


def test_misleading_wrapper_names_do_not_take_the_article():
    story = "".join(f"<p>{t}</p>" for t in LONG)
    nav = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
    for page in (
        f"{nav}<article class='post category-social'><h1>A title</h1>{story}</article>",
        f"{nav}<div class='content-sidebar-right'><article><h1>A title</h1>{story}</article></div>",
        f"{nav}<div class='layout-sidebar'><main><h1>A title</h1>{story}</main></div>",
    ):
        assert extract.main_text(page).split("\n") == ["A title", *LONG]
    assert extract.main_text(f"{nav}<div class='layout-sidebar'><div>{story}</div></div>").split("\n") == LONG
    assert extract.main_text(f"<div hidden><article>{story}</article></div>") == ""
    assert extract.main_text(f"<main>{story}<section id='comments'><article class='comment'><p>I like it.</p></article></section></main>").split("\n") == LONG


def test_unnamed_boilerplate_inside_main_goes():
    links = "<div><a href=1>Start</a> <a href=2>About us</a> <a href=3>Contact</a></div>"
    page = f"<main>{links}<h1>A title</h1>" + "".join(f"<p>{t}</p>" for t in LONG) + f"{links}</main>"
    assert extract.main_text(page).split("\n") == ["A title", *LONG]


def test_self_closed_and_nested_icons_leave_the_text():
    for icon in ("<svg class='i'/>", "<svg width=1 />", "<math/>", "<svg><svg><title>a</title></svg><svg/><text>b</text></svg>"):
        page = f"<article><p>{LONG[0]} {icon}</p><p>{LONG[1]}</p><p>{LONG[2]} <svg><text>c</text></svg></p><p>{LONG[3]}</p></article>"
        assert extract.main_text(page).split("\n") == LONG


ASIDE = ("A reader of this page may well want to know that there are many more words in this box than one would think of "
         "in such a place, for it goes on, line after line, in whole sentences, as any article would, and then it ends.")


def test_long_prose_in_containers_beside_the_article_goes():
    story = "".join(f"<p>{t}</p>" for t in LONG)
    for tag in ("div class='comments'", "div id=comments", "div class='ad'", "div class='cookie-notice'", "div class='sidebar'",
                "article class='comment'", "article class='comment-body'", "section class='post-comments'", "aside", "footer", "form",
                "div class='related'", "div class='site-notice'", "div role='banner'", "nav", "div class='newsletter'"):
        name = tag.split()[0]
        box = f"<{tag}><p>{ASIDE}</p><p>{ASIDE}</p></{name}>"
        for page in (
            f"<article><h1>A title</h1>{story}</article>{box}", f"{box}<main><h1>A title</h1>{story}</main>",
            f"<main><h1>A title</h1>{story}{box}</main>", f"<main><h1>A title</h1><p>{LONG[0]}</p>{box}{story[7 + len(LONG[0]):]}</main>",
            f"<div><h1>A title</h1>{story}</div>{box}", f"{box * 20}<article><h1>A title</h1>{story}</article>",
        ):
            assert extract.main_text(page).split("\n") == ["A title", *LONG], (tag, page[:80])


def test_wrappers_of_the_page_mean_nothing_by_their_name():
    story = "".join(f"<p>{t}</p>" for t in LONG[:3])
    nav, box = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", f"<div class='comments'><p>{ASIDE}</p></div>"
    for page in (
        f"<form id=f>{nav}<div>{story}</div>{box}</form>", f"<form>{nav}<main>{story}</main>{box}</form>",
        f"<form><div class='page-sidebar'>{story}</div>{box}</form>", f"<div class='ads'><main>{story}</main>{box}</div>",
        f"<p>Site.</p><form><form><article class='post comments-open'>{story}</article></form>{box}</form>",
    ):
        assert extract.main_text(page).split("\n")[-3:] == LONG[:3]
        assert ASIDE not in extract.main_text(page) and "Home" not in extract.main_text(page)
    assert extract.main_text("<form><label>Name</label><input><label>Password</label><input></form>") == ""
    assert extract.main_text(f"<div class='comments'><p>{ASIDE}</p><p>{ASIDE}</p></div>") == ""
    assert extract.main_text("<div class=sidebar>" * 3000 + f"<p>{LONG[0]}</p>" + "</div>" * 3000) == ""


def test_edges_of_the_cut_decide(monkeypatch):
    page = f"<div><p>{LONG[0]}</p><p>So it is</p><p>{LONG[1]}</p></div><div><a href=1>Start</a> <a href=2>About</a></div>"
    assert extract.main_text(page).split("\n") == [LONG[0], "So it is", LONG[1]]
    monkeypatch.setattr(extract, "ADJACENT", 0.0)
    monkeypatch.setattr(extract, "PROXIMITY", 0.0)
    weights = (-2.0, 0.5, -4.0, 1.0, 0.2, 1.2, -0.8, -0.3)
    assert extract.main_text(page, weights).split("\n") == LONG[:2]
    monkeypatch.undo()
    assert extract.main_text(page, weights).split("\n") == [LONG[0], "So it is", LONG[1]]
