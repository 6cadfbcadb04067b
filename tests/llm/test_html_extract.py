import random
import time

import pytest

from kgforge.llm.html_extract import main_text, op1, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><aside>Side</aside><div class="cookie-notice">We use cookies</div>
<article><h1>Title&amp;More</h1><p>First&nbsp;line
 with   space.</p><p>Ti.</p><ul><li>one</li><li>two <b>bold</b></li></ul><form><input value="x">Send</form><p>Last &lt;tag&gt;.</p></article>
<section id="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Title&More\n\nFirst line with space.\n\nTi.\n\none\n\ntwo bold\n\nLast <tag>."


def test_article():
    assert main_text(PAGE) == TEXT


def test_without_article_element():
    body = "".join(f"<p>Sentence number {k} of the story, which goes on for a while.</p>" for k in range(6))
    page = f"<body><div class='menu'><a href='/'>Home</a></div><div>{body}</div><div class=\"sidebar\"><p>Other</p></div><p>x</p><footer>end</footer></body>"
    assert main_text(page).count("Sentence") == 6 and "Home" not in main_text(page) and "Other" not in main_text(page)


@pytest.mark.parametrize(("html", "out"), [(None, ""), ("", ""), ("<p></p>", ""), ("<script>x", ""), ("<article><p>a<p>b", "a\n\nb"), ("plain &eacute;", "plain é"), ("<article>a<br>b<!-- c --></article>", "a b"), ("<main><p>x</p></main>", "x"), ("<article><p>1 &lt; 2 &#38; &am</p>", "1 < 2 & &am")])
def test_cases(html, out):
    assert main_text(html) == out


def by_hand(lengths, window, surge):
    """Brute force: every run of lines, taken if it can't be longer, doesn't dive and reaches the surge."""
    n = len(lengths)
    around = [sum(x for k, x in enumerate(lengths) if -(window // 2) <= k - i < window - window // 2) for i in range(n)]
    rise = min(surge, max(around, default=0) / 2)
    stays = [x > 0 and x >= rise / 8 for x in around]
    return [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(stays[a:b]) and (a == 0 or not stays[a - 1]) and (b == n or not stays[b]) and max(around[a:b]) >= rise]


def test_surge_and_dive_points():
    assert regions([], 3) == [] and regions([0, 0], 3) == []
    assert regions([0, 0, 90, 0, 40, 0, 0, 0, 3, 0, 0, 100], 3) == [(1, 6), (10, 12)]
    rng = random.Random(1)
    for _ in range(400):
        lengths = [rng.choice([0, 0, 0, 2, 9, 30, 200]) for _ in range(rng.randrange(25))]
        for window in (1, 3, 5):
            assert regions(lengths, window, 80) == by_hand(lengths, window, 80)


STORY = "".join(f"<p>Sentence number {k} of the story, which goes on for a while, as stories do.</p>" for k in range(6))
STORY_TEXT = "\n\n".join(f"Sentence number {k} of the story, which goes on for a while, as stories do." for k in range(6))


@pytest.mark.parametrize("wrap", ["<div class='content no-sidebar'>{}</div>", "<div class='layout-with-sidebar'>{}</div>", "<section id='related-work'>{}</section>", "<form id='page'>{}</form>", "<div class='layout-with-sidebar'><article>{}</article></div>", "<article><div class='content no-sidebar'>{}</div></article>", "<article class='post no-sidebar'>{}</article>", "<main><div class='widget-page'><article>{}</article></div></main>"])
def test_a_hint_at_what_holds_most_of_the_text_is_not_believed(wrap):
    assert main_text(f"<body><nav>Menu</nav>{wrap.format(STORY)}<div class='sidebar'>Aside of some words</div><footer>end</footer></body>") == STORY_TEXT


def test_unmarked_menus_and_adverts_go_by_the_distribution():
    menu = "".join(f"<div><a href='/{k}'>Item number {k}</a></div>" for k in range(8))
    assert main_text(f"<body>{menu}<div>Buy our stuff</div><div>{STORY}</div><div>Buy our stuff</div>{menu}</body>") == STORY_TEXT
    assert main_text(f"<body><div>Buy our stuff</div>{STORY}{menu}<div>Contact us</div></body>") == STORY_TEXT


def test_parts_of_an_article_beyond_a_box_stay():
    box = "<div class='newsletter'><p>Get our letter</p><p>Every week</p><p>Free of charge</p><p>Sign up</p></div>"
    assert main_text(f"<body><div><p>A short start of it.</p>{box}{STORY}{box}<p>The end.</p></div></body>") == f"A short start of it.\n\n{STORY_TEXT}\n\nThe end."


def test_inline_marks_links_formulas_and_comments():
    page = "<article><header><h1>Title</h1></header><p>Of <math><mi>x</mi></math> see <a href='/'>this link</a>, not <span class='ad'>buy</span> that.</p><section class='comments'><article><p>A reader</p></article></section></article>"
    assert main_text(page) == "Title\n\nOf x see this link, not that."
    assert main_text("<body><main><p>Hello there.</p></main><div class='comments'>" + STORY + "</div></body>") == "Hello there."


def test_long_pages_take_linear_time():
    for unit in ("<b>x</i>", "<div>x", "<a \"<a ", "</p>", "<p <", "<i><p>x</i>"):
        began = time.perf_counter()
        main_text("<body>" + unit * (600_000 // len(unit)))
        assert time.perf_counter() - began < 8, unit


def test_query(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x"), (3, "v", "<article><p>" + "word " * 100_000 + "</p></article>", "z")]
    got = op1(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 499_999)]
    assert op1(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
