"""Operator 13: the pages' articles cut out by hand, and pages of other forms."""

import html
import re
from collections import Counter

import pytest

from proofline.llm import html_text
from proofline.llm.html_text import main_text
from proofline.llm.queries import queries

P = "A long paragraph of the article, with many words, which goes on and on, and on again until it ends."


def article(page):
    """What stands between the article's tags, cut at its paragraphs and headings."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts) if x)


@pytest.mark.parametrize("data", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf, data):
    path = sf.replace("sf0.001", data)
    got = queries()["op13_html_text"](spark, path).collect()
    want = [(r.page_id, r.url, article(r.html), len(article(r.html))) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", f"<p>{P}", 3), (1, "u", f"<p>{P}", 3), (2, None, "x " * 300_000, 4)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, n_chars int").selectExpr("*", "'mine' as text")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    long = " ".join(["x"] * 300_000)
    assert Counter(map(tuple, got.collect())) == Counter([(None, None, "", 0), (1, "u", "", 0), (1, "u", P, len(P)), (1, "u", P, len(P)), (2, None, long, len(long))])
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div id="header"><a href=/>Site</a></div><div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div id="content"><h1>Title</h1><div class="entry"><p>{P}<p>Short.<p>{P}</div></div><div class="sidebar"><p>{P}</p></div><div id="footer">(c) 2020</div>', f"Title\n{P}\nShort.\n{P}"),
        (f'<article><header><h1>T &amp; U</h1><p>By me</p></header><p>{P}</p><aside>side</aside><p>{P} <span class="ad">buy</span> on</p><section id="comments"><article class="comment"><p>{P}</p></article></section></article>', f"T & U\n{P}\n{P} on"),
        (f'<form id="aspnet"><div><p>{P}</p><p>{P}</p><input value=x></div></form>', f"{P}\n{P}"),
        (f'<form><nav>menu</nav><article><p>{P}</p><form><label>Mail</label><input></form></article></form>', P),
        (f'<div class="cookie-notice"><p>{P}</p></div><main><p>{P}</p><p>Yes.</p></main><div role="contentinfo">{P}</div>', f"{P}\nYes."),
        (f'<ul><li><a href=1>Home page</a></li><li><a href=2>News page</a></li></ul><h1>Head</h1><p>{P}</p><p>{P}</p><p>x</p>', f"Head\n{P}\n{P}\nx"),
        (f'<article><p hidden>no</p><p style="display: none">no</p><p>{P}</p><script>if (a<b) "</p>"</script><!-- no --><noscript>no</noscript></article>', P),
        (f'<body class="has-sidebar"><div class="content-with-sidebar"><article class="post-header-image"><p>{P}</p></article></div></body>', P),
        (f"<main><article><p>{P}</p><p>{P}</p></article><article><p>teaser</p></article></main>", f"{P}\n{P}"),
        (f"<nav>x<article><p>{P}</article>", P),
        ("<table><tr><td>a<td>b<tr><td>c&nbsp;<td>d</table>", "a b\nc d"),
        ("<p>a<b>b</b>c <i>d</i><br>e<br><br>f", "abc d e\nf"),
        ("just   text &lt;b&gt; &amp so\n on", "just text <b> & so on"),
        ("<nav>a</nav><footer>b</footer>", ""),
        ("<![odd <p>x</p><!-- never closed <p>y", "x"),
    ],
)
def test_forms_of_pages(page, want):
    assert main_text(page) == want


def test_pieces_do_not_matter(monkeypatch, spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(12).collect()]
    whole = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "CHUNK", 7)
    assert [main_text(p) for p in pages] == whole


def test_unclosed_parts_take_linear_time():
    for page in ("<!--" * 50_000, "<a " * 50_000, "<div>" * 50_000 + "x", "<b>x" * 50_000, "<div>x" * 20_000 + "</span>" * 20_000, "<![CDATA[" * 20_000, "<script>" + "<" * 100_000):
        main_text(page)


def test_threshold_and_smoothing():
    assert 1 < html_text.threshold([1, 1, 1, 9, 9]) < 9
    assert html_text.threshold([]) == 0 and html_text.threshold([4, 4]) == 4
    flat = html_text.smoothed([0, 0, 9, 0, 0])
    assert flat[2] == max(flat) and flat[1] == pytest.approx(flat[3]) and 0 < flat[1] < 9
