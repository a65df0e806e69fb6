import html
import re

import pandas as pd
from indicata.llm import site_style_tree as S
from indicata.llm.common import table


def gold(page):
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<(b|br)>", " ", article))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_pages(spark):
    got = S.extract(table(spark, "/root/testdata/sf0.01", "pages")).toPandas().set_index("page_id")
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").set_index("page_id")
    assert sorted(got.index) == sorted(pages.index)
    assert all(got.text[i] == gold(pages.html[i]) for i in pages.index)
    assert (got.n_chars == got.text.str.len()).all() and (got.url == pages.url.loc[got.index]).all()


def test_declared_noise_goes():
    page = """<html><head><title>t</title></head><body><header><h2>Site</h2></header><div id="cookie-notice">ok?</div>
    <div class="side-bar sidebar">links</div><form>q<input></form><main><h1>A &amp; B</h1><p>one
    two<br>three<p>four &lt;5&gt;<script>x("</p>")</script><aside>no</aside><div class="comments"><p>first!</div>
    <ul><li>x<li>y</ul></main><footer>f</footer></body></html>"""
    assert S.main_text(page) == "A & B\none two three\nfour <5>\nx\ny"


def test_tree_drops_what_repeats_on_a_host(spark):
    def page(i):
        return (f"<body><div class='x1'>Read our other stories {'now ' * 5}</div><div class='x2'><p>Story {i} about {i * i}.</p>"
                f"<p>More on {i * 7}.</p></div><div class='x3'>All rights reserved</div></body>")
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(8)] + [(9, "http://other.org/", page(9))]
    # identical pages count once, so they do not make an article look repeated
    rows += [(20 + i, "http://same.org/", page(3)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Story 2 about 4.\nMore on 14."
    assert got[9].startswith("Read our") and got[9].endswith("reserved")
    assert "Story 3" in got[20]
    tree = {r["path"]: r for r in S.style_tree(
        spark.createDataFrame([("h", page(i)) for i in range(8)], "host string, html string")).collect()}
    assert tree["/body/div.x1"]["importance"] == 0 and tree["/body/div.x2"]["importance"] > 0.85
    assert tree["/body/div.x1"]["pages"] == 8


def test_an_article_that_a_host_repeats_stays(spark):
    def page(i, story):
        return (f"<nav>menu {i}</nav><article><h1>Page {i}</h1><p>{story}</p><p class='n'>Sign up.</p></article>"
                f"<div>rest {i}</div>")
    same = "The same long story, told on nearly every page of this host. " * 3
    rows = [(i, f"http://copies.org/{i}", page(i, same)) for i in range(12)] + [(12, "http://copies.org/12", page(12, "Other."))]
    rows += [(20 + i, f"http://mixed.org/{i}", page(i, f"Story {i}, " * 20)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(same.strip() in got[i] for i in range(12))
    assert all("Sign up" not in got[20 + i] and f"Story {i}," in got[20 + i] for i in range(12))


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None, "u"), (2, "x", "", "u"), (3, "http://a.b", "plain &amp; text", "u"), (4, "http://a.b", "<p>a<p>b</article>c", None),
            (4, "http://a.b", "<p>a<p>b</article>c", None), (None, "http://a.b", "<article><p>cut off", "u"), (6, "http://c.d", deep, "u"),
            (7, "http://c.d", "<p>" + "word " * 200_000, "u")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = {r["page_id"]: r["text"] for r in S.extract(df).collect()}
    assert (got[1], got[2], got[3], got[None], got[6]) == ("", "", "plain & text", "cut off", "deep")
    assert got[4] == "a\nbc" and len(got[7]) == 999_999
    assert S.extract(df).count() == len(rows)
    assert S.extract(df.where("false")).count() == 0


def test_a_unique_page_of_a_host_that_repeats_a_story_stays(spark):
    def page(i, story, open_, close):
        return f"<div class='top'>menu {i % 5}</div>{open_}<h1>Page</h1><p>{story}</p>{close}<div class='by'>by author {i}</div>"
    same = "The same long story, told on nearly every page of this host. " * 3
    rows = []
    for h, (open_, close) in enumerate((("<article>", "</article>"), ("<div class='x'>", "</div>"))):
        rows += [(100 * h + i, f"http://copies{h}.org/{i}", page(i, same if i < 40 else f"Own story {i}. " * 9, open_, close))
                 for i in range(43)]
    got = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Own story {i}." in got[100 * h + i] for h in (0, 1) for i in (40, 41, 42)), got
    assert all(same.strip() in got[i] for i in range(40))


def test_a_wrapper_is_no_noise_for_a_word_in_its_class():
    for name in ("class='content no-sidebar'", "class='site has-sidebar'", "class='post with-comments'", "class='menu-open'",
                 "id='search-results'", "class='page comments'"):
        for story in ("<article><p>The story.</p></article>", "<p>The story is long enough.</p>"):
            page = f"<body><div {name}>{story}</div><div class='side sidebar'>links</div><div id='cookie-notice'>ok?</div></body>"
            assert S.main_text(page) == story.replace("<article>", "").replace("</article>", "")[3:-4], (name, story)
