import html
import re

from conftest_odd import ODD

from quern.llm.tagpaths import blocks, extract_pages, main_text, op1_tag_paths, path_scores

PARA = "The council met on Tuesday, and after a long debate it agreed on the plan, which had been under review for months."
PAGE = f"""<!doctype html><html><head><title>T</title><script>if (a<b) x("</p>")</script><style>p{{}}</style></head><body class="home header-on">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News, sport, weather.</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, and by staying here you agree to all of it, as set out in our policy.</p></div>
<!-- c <p>no</p> -->
<div class="col"><article><header><h2>The head&shy;line</h2><p>By Somebody, today</p></header>
<p>{PARA}<p>Short.<p class=lead title="a > b">{PARA} <b>Bold</b> &amp; <a href=x>link</a><br>after
   break.</p><ul><li>First point, said the mayor.</ul><div class="ad"><p>{PARA}</p></div>
<form><p>{PARA}</p><input name=q></form><aside><p>{PARA}</p></aside></article>
<section class="comments"><p>{PARA}</p><p>{PARA}</p></section></div><footer><p>{PARA} &copy;</p></footer></body></html>"""


def test_article_without_what_is_around_it():
    assert main_text(PAGE).split("\n") == ["The head­line", PARA, "Short.", f"{PARA} Bold & link after break.", "First point, said the mayor."]


def test_without_article_element():
    page = f"<body><div class=menu><a href=1>A</a> <a href=2>B</a></div><div class=x><h1>Head</h1><p>{PARA}</p><p>{PARA}</p></div><div><a href=3>More</a></div></body>"
    assert main_text(page).split("\n") == ["Head", PARA, PARA]


def test_wrappers_named_after_what_is_around_the_text():
    text = f"<h1>Head</h1><p>{PARA}</p><p>{PARA}</p>"
    for wrapper in ('id="content" class="has-sidebar"', 'class="post no-comments"', 'class="main with-nav"', 'class="layout-with-sidebar"'):
        for body in (text, f"<article>{text}</article>"):
            page = f'<body><nav><a href=1>A</a></nav><div {wrapper}>{body}<div class="ad"><p>{PARA}</p></div></div><div class="sidebar"><p>{PARA}</p></div></body>'
            if "layout" in wrapper and body is text:
                page = page.replace(f'<div class="sidebar"><p>{PARA}</p></div>', "")
            assert main_text(page).split("\n") == ["Head", PARA, PARA], wrapper
    for around in ('class="comments"', 'id="comments-section"', 'class="comment-body"'):
        thread = f"<div {around}>" + f"<p>{PARA}</p>" * 4 + "</div>"
        assert main_text(f"<body><div class=x>{text}</div>{thread}</body>").split("\n") == ["Head", PARA, PARA], around


def test_path_scores_prefer_long_punctuated_paths():
    found = blocks(f"<div><p>{PARA}</p><p>{PARA}</p></div><div class=y><span>tiny</span></div>")
    score = path_scores(found)
    assert score[("#", "div", "p")] > 3 * score[("#", "div.y")]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<!-- open") == main_text("<script>x") == ""
    assert main_text("just text") == "just text"
    for page in ODD[1:]:
        assert "\n\n" not in main_text(page)
    deep = "<div>" * 3000 + PARA + "</div>" * 3000
    assert main_text(deep) == PARA
    assert main_text("<p>" + "a<b " * 20000).startswith("a")
    assert PARA in main_text(f"<p title='x>{PARA}</p><p>{PARA}</p>")


def test_query_on_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op1_tag_paths(spark, small).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("<p>|</p>|</?h1>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", PAGE), (2, "u", ""), (2, "u", "")], "page_id bigint, url string, html string").selectExpr("*", "1 as text")
    rows = extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in rows) == [(0, True), (1, False), (2, False), (2, False)]
    assert extract_pages(df.limit(0)).count() == 0
