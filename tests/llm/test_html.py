from corpuscle.llm import op6_html as html

LONG = "One sentence of the article that goes on for a while, so that it is long. " * 3


def page(inner):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><p>Site header with some words in it</p></header><nav><ul><li><a href=/>Menu</a><li><a>More</a></ul></nav>{inner}
    <footer>&copy; foot</footer></body></html>"""


def test_article_whole_and_nothing_else():
    p = page(f"""<div class="ad">Buy this now</div><div class="cookie-notice"><p>{LONG}</p></div><article><h1>A &amp; B</h1><p><b>{LONG}
    <br><p>Short.</p><aside>{LONG}</aside><ul><li>item one</li><li>item two</li></ul><p>{LONG}</p>
    <section class="comments"><p>{LONG}</p></section></article><div id="sidebar"><p>{LONG}</p></div><form><p>{LONG}</p><label>x</label></form><!-- no -->""")
    one = " ".join(LONG.split())
    assert html.extract(p) == "\n".join(["A & B", one, "Short.", "item one", "item two", one])


def test_without_article_element():
    p = page(f"<div><p>{LONG}</p><p>in between</p><p>{LONG}</p></div>")
    one = " ".join(LONG.split())
    assert html.extract(p) == "\n".join([one, "in between", one])


def test_layout_words_name_no_part():
    p = page(f'<div class="wrap has-sidebar no-comments"><article><p>{LONG}</p><div class="related-posts"><p>x</p></div></article></div>')
    assert html.extract(p) == " ".join(LONG.split())


def test_edges(spark):
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain &eacute; text"), (5, "u", "<![bad <!-- <p>x"), (None, "u", "<p>" * 5000 + "deep"), (7, "u", "<p>w " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in odd], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert len(got) == len(odd) and got[1].text == got[2].text == got[3].text == "" and got[4].text == "plain é text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[None].text == "deep" and got[7].n_chars == 2 * 20000 - 1
    assert html.extract_pages(df.limit(0)).count() == 0


def test_text_after_broken_declarations_stays():
    for token in ("<![LOG[ x ]]>", "<![ x>", "<![>", "<![endif]-->", "<![if x>", "<![cdata[ x>"):
        got = html.extract(f"<article><p>{LONG}</p>{token}<p>two</p><p>{LONG}</p></article>")
        assert got.startswith(LONG.strip()) and got.endswith(LONG.strip()) and "two" in got, token
    assert html.extract("<p>one</p><![LOG[ x ]]><p>two</p>") == "one\ntwo"
    assert html.extract("<p>one</p><![ never closed").startswith("one")


def test_short_articles_and_deep_containers():
    one = " ".join(LONG.split())
    assert html.extract(page(f"<article><p>{LONG * 4}</p></article><article><p>{LONG}</p></article>")).endswith("\n" + one)
    deep = "<div>" * 3000 + f"<p>{LONG}</p><p>tail</p>" + "</div>" * 3000
    assert html.extract(page(deep)) == one + "\ntail"


def test_only_white_space_is_white_space():
    assert html.extract("<article><p>a\u200bb \u00a0 c\ufeff d</p></article>") == "a\u200bb c\ufeff d"


def test_ties():
    """Lines of one ratio make no clusters: all are content."""
    assert html.extract("<div><p>same</p><p>size</p><p>text</p></div>") == "same\nsize\ntext"


def test_markup_that_the_end_cuts_off():
    for tail in ("<!x", "<!-- x", "<a href='x", "<?php x", "</p", "<![CDATA[ x"):
        assert html.extract(f"<p>one</p><p>two{tail}") == "one\ntwo", tail
    assert html.extract("<p>one</p>a < b") == "one\na < b"


def test_deep_pages_in_linear_time():
    import time

    began = time.perf_counter()
    assert html.extract("<div>" * 100_000 + "deep" + "</div></i>" * 100_000) == "deep"
    assert html.extract("<ul><li>" + "<div>" * 20_000 + "<p>x<dt>" * 2_000 + "</b>" * 20_000).count("x") == 2_000
    assert time.perf_counter() - began < 20
