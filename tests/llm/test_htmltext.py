import math
import random
import resource
import statistics
import time

import pytest

from quern.llm.htmltext import clustered, extract, main_text, smoothed_ratios

LONG = "A paragraph that is long enough to count as the content of a page, with several words."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a &lt;b&gt;&amp;&#233; c\n  d<br>e</p><p>f</p>", "a <b>&é c d e\nf"),
        (f"<nav><a>Menu</a></nav><article><h1>T</h1><p><b>{LONG}<p>Short.</article><footer>F</footer>", f"T\n{LONG}\nShort."),
        (f"<article><p>{LONG}<script>var a='</p>';</script></p><div class='ad'>Buy</div><p>x</p><section id='comments'><p>{LONG} says a reader</p></section></article>", f"{LONG}\nx"),
        (f"<div id=page><div class='sidebar'><p>{LONG} aside</p></div><div class='post'><p>{LONG}</p><ul><li>One<li>Two</ul></div></div>", f"{LONG}\nOne\nTwo"),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p><form><label>Name</label></form><div class='cookie-notice'>Cookies</div></main>", LONG),
        (f"<body><p>{LONG}</p><p>Unclosed <div>more", f"{LONG}\nUnclosed\nmore"),
        ("<article><p>Only this</article>", "Only this"),
        (f"<article class='article-header-less readable'><p>{LONG}</p></article>", LONG),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


def test_names_are_whole_words():
    assert main_text(f"<div class='address upload thread'><p>{LONG}</p></div>") == LONG


def test_long_lines_stand_out():
    lines = [("a", 3, 0)] * 5 + [("b" * 200, 1, 0)] + [("c", 3, 0)] * 5
    smooth = smoothed_ratios(lines)
    assert smooth.argmax() == 5 and len(smooth) == len(lines)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}", 1), (1, "u", f"<p>{LONG}", 1), (None, None, None, 2), (3, "v", "<b>" * 3000 + "x", 3)], "page_id long, url string, html string, text int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(pages).collect())
    assert got == [("1", LONG, len(LONG)), ("1", LONG, len(LONG)), ("3", "x", 1), ("None", "", 0)]
    assert extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", ["post comments-open", "content has-sidebar", "layout no-sidebar", "entry-header", "sidebar", "main-nav"])
def test_no_name_drops_an_article(name):
    assert main_text(f"<article class='{name}'><p>{LONG}</p></article>") == LONG
    assert main_text(f"<div><div class='{name}'><main><p>{LONG}</p></main></div><p>x</p></div>") == LONG


@pytest.mark.parametrize("name", ["comments-open", "has-sidebar", "no-sidebar", "entry-header"])
def test_a_part_of_a_name_is_no_name(name):
    assert main_text(f"<div><div class='{name}'><p>{LONG}</p></div></div>") == LONG


@pytest.mark.parametrize("name", ["ad", "main-nav", "site_footer", "cookie-notice", "sign-up", "comment-list", "x sidebar", "side-bar", "login-form"])
def test_names_of_junk(name):
    assert main_text(f"<div><p>{LONG} one</p><div class='{name}'><p>{LONG}</p></div><p>a <b class='{name}'>b</b> c</p></div>") == f"{LONG} one\na c"


def test_comments_that_are_articles():
    comment = f"<section id='comments'><article class='comment'><p>{LONG} says a reader</p></article></section>"
    assert main_text(f"<article><p>{LONG}</p>{comment}</article>") == LONG
    assert main_text(f"<article><p>{LONG}</p></article>{comment}") == LONG
    assert main_text(comment) == f"{LONG} says a reader"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div id=content><div class=intro><p>{LONG}</p></div><div class=body>{f'<p>{LONG}</p>' * 6}</div></div>", [LONG] * 7),
        *((f"<div><h2>Head</h2><p>Intro.</p>{open_}{f'<p>{LONG}</p>' * 6}{close}<p>End.</p></div>", ["Head", "Intro.", *[LONG] * 6, "End."]) for open_, close in (("<section>", "</section>"), ("<blockquote>", "</blockquote>"), ("<table><tr><td>", "</table>"))),
        (f"<div><article>{f'<p>{LONG}</p>' * 6}</article><ul><li>x<li>y<li>z</ul><article><p>Short.</p></article></div>", [LONG] * 6 + ["Short."]),
    ],
)
def test_the_region_holds_the_whole_text(html, want):
    assert main_text(html) == "\n".join(want)


def test_smoothing_and_threshold_equal_sums_by_hand():
    r = random.Random(3)
    for n in (1, 2, 3, 6, 7, 40):
        lines = [("x" * r.choice((1, 5, 80, 400)), r.randint(0, 6), 0) for _ in range(n)]
        ratio = [len(t) / max(1, tags) for t, tags, _ in lines]
        weights = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
        smooth = [sum(w / sum(weights) * ratio[i + d] for d, w in zip(range(-3, 4), weights, strict=True) if 0 <= i + d < n) for i in range(n)]
        assert smoothed_ratios(lines) == pytest.approx(smooth)
        threshold = min(statistics.pstdev(smooth), max(smooth))
        chosen = [i for i, x in enumerate(smooth) if x >= threshold - 1e-12]
        assert clustered(lines).tolist() == [i for i in chosen if ratio[i] >= sum(ratio[j] for j in chosen) / len(chosen) / 10]


def test_clusters_decide_without_an_article():
    links = "<a>Home</a><a>News</a><a>Sport</a>"
    page = f"<div><div>{links}</div><div>{links}</div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>{links}</div></div>"
    assert main_text(page) == f"Head\n{LONG}\nShort.\n{LONG}"


def test_clusters_overrule_names():
    text = f"<p>{LONG}</p>" * 4
    assert main_text(f"<div><div class='sidebar'>{text}</div><div><a>x</a></div></div>") == "\n".join([LONG] * 4)
    assert main_text(f"<div><div class='sidebar'><p>{LONG}</p></div><div>{text}</div></div>") == "\n".join([LONG] * 4)
    assert main_text(f"<div><div class='comments'>{text}</div><p>{LONG} alone</p></div>") == f"{LONG} alone"
    assert main_text(f"<div class='comments'>{text}</div>") == "\n".join([LONG] * 4)
    assert main_text(f"<div class='ad'>{text}</div><article><p>Short.</p></article>") == "Short."


@pytest.mark.parametrize(
    "html",
    ["<div>a " * 170_000, "<b>" * 150_000 + "<p>x</p>" * 70_000, "<b>" * 150_000 + "</div>" * 100_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<li>a " * 170_000, "<a href=x " * 100_000, "&" * 1_000_000, "<p>" + "word " * 200_000, "<div class='ad'>" * 60_000 + "x"],
    ids=["div", "inline", "ends", "crossed", "items", "open", "references", "long", "named"],
)
def test_megabyte_pages_take_seconds(html):
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    main_text(html)
    assert time.process_time() - began < 5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_a_tag_cut_off_by_the_end_is_no_text():
    assert main_text(f"<p>{LONG} 1 < 2<a href='x") == f"{LONG} 1 < 2"


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}", "t", 5, "h")], "page_id long, url string, html string, text string, n_chars int, `element` string")
    assert [tuple(r) for r in extract(pages).collect()] == [(1, "u", LONG, len(LONG))]
