import pytest
from pyspark.sql import functions as F

from foliograph.operators import sanitize as sz

CASES = [
    ("<p>Hi <b>you</b></p>", "<p>Hi <b>you</b></p>"), ("a<script>var t='</p><form>';</script>b", "ab"), ("a<form><p>x<input></p></form>b", "ab"), ("a<svg><svg></svg>x</svg>b", "ab"), ("a</form>b<form>c", "ab"),
    ('<a href="java\tscript:x" onclick="y" title="t">z</a>', '<a title="t">z</a>'), ('<a href="&#106;avascript&colon;x">z</a>', "<a>z</a>"), ('<a href="mailto:a@b">m</a><img src="mailto:x">', '<a href="mailto:a@b">m</a><img />'),
    ("<div class=big style='x' data-a=1 hidden>{x}</div>", '<div className="big" data-a="1" hidden>&#123;x&#125;</div>'), ("<!-- a <b> -->x<!-- open", "x"), ("<br><BR/></br>", "<br /><br />"),
    ('<iframe src="https://www.youtube.com/embed/x" srcdoc="<p>" allow="x" width="3"></iframe>', '<iframe src="https://www.youtube.com/embed/x" width="3"></iframe>'), ('a<iframe src="https://evil.example/">x</iframe>b', "ab"), ("a<iframe>b", "a"),
    ('<iframe src="//x"></iframe><iframe src="https://a.youtube.com/"></iframe>', '<iframe src="https://a.youtube.com/"></iframe>'), ('<p id="1x" id2="y">t</p>', '<p id2="y">t</p>'), ('<a title="a > b" href="/x?a:b">q</a>', '<a title="a > b" href="/x?a:b">q</a>'),
    ("<style>p{}</style>t<textarea><b>", "t"), ("1 < 2 {a}", "1 < 2 &#123;a&#125;"), ("", ""), (None, None), ("<button/>x", "x"), ('<a href=" HTTPS://X ">q</a>', '<a href=" HTTPS://X ">q</a>'), ('<a href="data:text/html,x">q</a><a href="a&amp;b:c">r</a>', '<a>q</a><a>r</a>'),
]


def test_each_case(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "id int, html string")
    got = {r["id"]: r["html"] for r in sz.sanitized(rows, "id", "html").collect()}
    for i, (given, want) in enumerate(CASES):
        assert got[i] == want, given
    assert sz.sanitized(rows.limit(0), "id", "html").count() == 0


@pytest.mark.parametrize("html", ["<a " + 'x="1" ' * 100_000 + ">t</a>", "<form>" * 100_000 + "t", "<" * 500_000, "<p>" + "x" * 1_000_000 + "</p>", "<!--" * 100_000])
def test_very_long_pages(spark, html):
    rows = spark.createDataFrame([(1, html)], "id int, html string")
    assert sz.sanitized(rows, "id", "html").select(F.length("html")).first()[0] is not None


def test_style_sheets(spark):
    sheets = [(1, "p { color: red }"), (2, "@IMPORT 'x'; p { position : sticky; z-index: 10 }"), (3, "a { background: url( 'https://x') ; behavior: url(x) }"), (4, None)]
    got = sorted(map(tuple, sz.style_problems(spark.createDataFrame(sheets, "id int, css string"), "id", "css").collect()))
    assert got == [(2, "fixed position"), (2, "import"), (2, "z-index above 9"), (3, "external address"), (3, "script-like")]
