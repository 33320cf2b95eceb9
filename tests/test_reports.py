from pyspark.sql import functions as F

from foliograph.functions import urls
from foliograph.operators import reports, sites


def test_shortfalls_and_gaps(spark):
    s = spark.createDataFrame([("lost", i) for i in (5, 3, 9, 1)] + [("held", 2)], "reason string, page long")
    assert sorted(tuple(r) for r in reports.shortfalls(s, "reason", "page").collect()) == [("held", 1, "2"), ("lost", 4, "1,3,5")]
    d = spark.createDataFrame([(1, "T1", "a", True, None), (1, "T1", "a", True, "r"), (2, "T1", "a", False, None)], "page_id long, tier string, rule string, needs_review boolean, reviewer string")
    assert [tuple(r) for r in reports.gaps(d).collect()] == [("T1", "a", 3, 2)] and reports.unreviewed(d).count() == 1


def test_reruns_and_canary(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "page_id long, output string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "page_id long, output string")
    assert sorted(tuple(r) for r in reports.rerun_differences(a, b).collect()) == [(2, "changed"), (3, "added")]
    pages = spark.createDataFrame([(1, "some text")], "page_id long, text string")
    s = spark.createDataFrame([(1, 1, "text"), (2, 9, "no")], "search_id long, page_id long, phrase string")
    assert tuple(reports.canary(s, pages).first()) == (2, 1, False) and tuple(reports.canary(s.limit(0), pages).first()) == (0, 0, False)
    assert tuple(reports.canary(s, pages, 1).first()) == (1, 0, True)


def test_more_urls(spark):
    f = spark.createDataFrame([("https://h/sitemap-en-v2-guides-3.xml.gz",), ("https://h/sitemap.xml",)], "u string")
    got = [r["x"] for r in f.select(urls.sitemap_hint(F.col("u")).alias("x")).collect()]
    assert tuple(got[0]) == ("en", "v2", ["guides"]) and tuple(got[1]) == (None, None, [])
    l = spark.createDataFrame([("doc:start#x",), ("ref:get-user",), ("https://x",)], "u string")
    assert [r[0] for r in l.select(urls.platform_link(F.col("u"))).collect()] == ["/docs/start#x", "/reference/get-user", None]
    p = spark.createDataFrame([("en", "2.0"), ("de", "1.0"), (None, "current"), ("de", None)], "l string, v string")
    assert [r[0] for r in p.select(urls.route_prefix(F.col("l"), F.col("v"), "en", "2.0")).collect()] == ["", "/de/1.0", "/next", "/de"]


def test_branding(spark):
    html = '<meta name="theme-color" content="#fff"><link rel="icon" href="/f.ico"><img class="site-logo" src="/l.svg">'
    p = spark.createDataFrame([("h", html), ("h", html.replace("#fff", "#000")), ("h", html), ("i", "")], "host string, html string")
    assert sorted(tuple(r) for r in sites.branding(p).collect()) == [("h", "#fff", "/f.ico", "/l.svg"), ("i", None, None, None)]
