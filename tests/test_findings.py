import re

from foliograph.operators import assets, findings, links
from foliograph.plans import gate_queries

PAGES = "page_id long, html string"
NAV = '<nav><a href="/a">Ax</a><a href="/b">By</a></nav>'


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chrome_lines_repeat_and_keep_their_places(spark):
    source = spark.createDataFrame([(1, NAV + "<p>Ax</p>"), (2, NAV + "<p>text</p>"), (3, "<p>Ax</p>"), (4, None)], PAGES)
    copy = spark.createDataFrame([(1, "<p>Ax</p><p>By</p>"), (2, "<p>Ax | By</p><p>text</p><p>By</p><p>Ax | By</p><p>»</p><p>Axe</p>"), (3, "<p>Ax</p>"), (4, "<p>Ax</p>")], PAGES)
    assert rows(findings.chrome_lines(copy, source), "page_id", "line_no", "line") == [(1, 1, "By"), (2, 0, "Ax | By"), (2, 2, "By"), (2, 3, "Ax | By"), (2, 4, "»")]


def test_no_line_takes_its_page_along(spark, tmp_path):
    spark.createDataFrame([(1, NAV)], PAGES).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    exploded = [x for x in plan(findings.chrome_lines(pages, pages)).split("\n") if "Generate " in x]
    assert len(exploded) == 1 and re.search(r", \[page_id#\d+L\], false, ", exploded[0])


def test_references_read_pages_once(spark, tmp_path):
    spark.createDataFrame([(1, '<img src="a&amp;b"><video src=" v " poster="p"><img srcset="x 1x,  y 2x" src="data:z">'), (2, None)], PAGES).write.parquet(str(tmp_path / "pages"))
    got = assets.references(spark.read.parquet(str(tmp_path / "pages")))
    assert rows(got) == [(1, "image", "a&b"), (1, "poster", "p"), (1, "srcset", "x"), (1, "srcset", "y"), (1, "video", "v")]
    assert plan(got).count("FileScan") == 1


def test_gates_find_references_and_links_once(spark):
    for damaged in (False, True):
        found = gate_queries._findings(spark, "/root/testdata/sf0.001", damaged)
        for name in ("assets-ready", "internal-links"):
            assert "html#" not in plan(found[name])
        assert "html#" in plan(found["fragments-resolve"])


def test_gates_read_pages_once_for_their_parts(spark):
    for damaged in (False, True):
        found = gate_queries._findings(spark, "/root/testdata/sf0.001", damaged)
        assert [name for name, df in found.items() if "html#" in plan(df)] == ["chrome-absent", "fragments-resolve"]
        assert plan(found["chrome-absent"]).count("FileScan") == 2
        assert len([x for x in plan(found["fragments-resolve"]).split("\n") if "FileScan" in x and "html#" in x]) == 1


def test_parts_stand_for_pages(spark, tmp_path):
    odd = [
        "<IMG a='x' SRC=\"a&amp;b\"><Video src=\" v \" POSTER=\"p\"><source src=\"s\"><AUDIO src=\"w\"><iframe src=\"f\"><img SrcSet=\"x 1x,  y 2x\" src=\"data:z\">",
        '<META property="OG:image" content="o"><meta NAME="Description" content="d &lt;"><meta name="robots" content=""><LINK rel="Canonical" href="/c"><meta property="og:title" content="t">',
        '<H2 id="k">A <b>b</b></h2><h3>A b</h3><h2\n>C&amp;\nd</H6><h1>open <h4 title=">">x</h4><h9>no</h9><a HREF=x>1</a><a href=\'y\'>2</a><a data-x href="z">3</a>',
        "<pre><code>a &lt; b</code></pre><PRE>\nc\n</PRE>[[held:x]][[held:]] \u212alink \u0130mg <\u0130mg src=\"q\">",
        "",
        None,
    ]
    spark.createDataFrame([(i, f"https://h.example/p/{i}", html) for i, html in enumerate(odd)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    parts = findings.parts(pages)
    assert "html" not in parts.columns
    for look in (links.links, links.headings, assets.references, assets.seo, findings.code_of, findings.placeholders):
        assert rows(look(parts.select("page_id", "url", *[c for c in parts.columns if c.startswith("found")]))) == rows(look(pages))
    assert rows(assets.references(pages)) == [(0, "audio", "w"), (0, "frame", "f"), (0, "image", "a&b"), (0, "poster", "p"), (0, "source", "s"), (0, "srcset", "x"), (0, "srcset", "y"), (0, "video", "v"), (1, "social", "o")]
    assert [tuple(r) for r in assets.seo(pages).orderBy("page_id").collect()][1] == (1, "https://h.example/c", "d <", None, "t")
    assert rows(links.headings(pages)) == [(2, 0, 2, "A b"), (2, 1, 3, "A b"), (2, 2, 2, "C& d"), (2, 3, 1, 'open ">x')]
    assert set(re.findall(r"regexp_extract_all\(html#\d+, \S+, (\d)\)", plan(links.headings(pages)))) == {"0"}
    assert rows(links.anchors(pages)) == rows(links.anchors(pages, links.headings(parts)))
