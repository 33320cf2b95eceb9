from pyspark.sql import functions as F

from foliograph.operators import reconcile
from foliograph.sources import blocks, files, indexes
from foliograph.streaming import ledger_stream


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_scan_freeze_and_drift(spark, tmp_path):
    (tmp_path / "docs/node_modules").mkdir(parents=True)
    (tmp_path / "docs/sub").mkdir()
    for name, body in (("docs/a.md", "one"), ("docs/sub/b.mdx", "two"), ("docs/c.png", "x"), ("docs/node_modules/d.md", "no")):
        (tmp_path / name).write_text(body)
    f = files.scan(spark, str(tmp_path / "docs"))
    assert rows(f, "path", "bytes") == [("a.md", 3), ("sub/b.mdx", 3)]
    before = spark.createDataFrame(files.frozen(f).collect())
    (tmp_path / "docs/a.md").write_text("changed")
    (tmp_path / "docs/sub/b.mdx").unlink()
    now = files.frozen(files.scan(spark, str(tmp_path / "docs")))
    assert rows(reconcile.drift(before, now, "path", "sha256")) == [("a.md", "changed"), ("sub/b.mdx", "missing")]
    (tmp_path / "docs/server.pem").write_text("K=1")  # Spark itself passes over hidden files
    everything = files.scan(spark, str(tmp_path / "docs"), None)
    assert rows(files.freeze_problems(everything)) == [("credentials", "server.pem")]
    assert ("too many files", "") in rows(files.freeze_problems(everything, {**files.LIMITS, "files": 1}))


def test_frontmatter_and_definitions(spark):
    f = spark.createDataFrame([("a", "---\ntitle: \"Hi there\"\norder: 3\norder: 4\nnested:\n  x: 1\n---\n# Body\n"), ("b", "no head"), ("c", "---\nunclosed")], "path string, text string")
    got = {r["path"]: r for r in files.with_frontmatter(f).collect()}
    assert got["a"]["data"] == {"title": "Hi there", "order": "4", "nested": ""} and got["a"]["body"] == "# Body\n"
    assert got["b"]["data"] == {} and got["b"]["body"] == "no head" and got["c"]["body"] == "---\nunclosed"
    code = spark.createDataFrame([("snippets/x.jsx", bytearray(b"export const Card = () => 1\nexport function Note() {}")), ("docs/y.jsx", bytearray(b"export const No = 1"))], "path string, content binary")
    assert [r["name"] for r in files.component_definitions(code).orderBy("name").collect()] == ["Card", "Note"]
    listed = spark.createDataFrame([("a",), ("z",)], "path string")
    assert rows(files.missing_and_unlisted(listed, f)) == [("b", "unlisted"), ("c", "unlisted"), ("z", "missing")]
    assert rows(files.tokens_used(spark.createDataFrame([("{{a.b}} {{ a.b }} {{c}}",)], "text string"))) == [("a.b", 2), ("c", 1)]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nSitemap: https://h.org/s.xml\n\nUser-agent: Bot\nUser-agent: Other\nDisallow: /bot # note\nDisallow:\n"
    f = spark.createDataFrame([("h.org", body), ("i.org", "User-agent: Bot\nDisallow: /\n")], "host string, body string")
    assert rows(indexes.robots_rules(f, "other")) == [("h.org", "/bot")]
    assert rows(indexes.robots_rules(f, "unknown")) == [("h.org", "/private")]
    pages = spark.createDataFrame([("https://h.org/privately",), ("https://h.org/ok",), ("https://j.org/private",)], "url string")
    assert rows(indexes.allowed(pages, indexes.robots_rules(f, "x"))) == [("https://h.org/ok",), ("https://j.org/private",)]
    assert rows(indexes.robots_sitemaps(f)) == [("h.org", "https://h.org/s.xml")]


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>b.xml</loc></sitemap><sitemap><loc> a.xml </loc></sitemap></sitemapindex>"
    urls_ = '<urlset><url><loc>https://h/1?a=1&amp;b=2</loc><priority>0.5</priority><xhtml:link rel="alternate" hreflang="de" href="https://h/de/1"/></url><url><loc>https://h/1?a=1&amp;b=2</loc></url><url><loc>https://h/2</loc><priority>high</priority></url></urlset>'
    f = spark.createDataFrame([("root.xml", index), ("a.xml", urls_), ("b.xml", index.replace("b.xml", "root.xml"))], "file string, body string")
    assert rows(indexes.sitemap_entries(f), "loc", "priority") == [("https://h/1?a=1&b=2", 0.5), ("https://h/2", None)]
    assert rows(indexes.sitemap_tree(f, spark.createDataFrame([("root.xml",)], "file string"))) == [("a.xml", 1), ("b.xml", 1), ("root.xml", 0)]


def test_llms_and_summary(spark):
    f = spark.createDataFrame([("llms.txt", "# Site\n\n## Guides\n- [One](https://h/one.md): First\n- [Two](/two.md)\n\ntext\n- [Uno](https://h/one.md)")], "file string, body string")
    e = indexes.llms_entries(f)
    assert rows(e, "section", "title", "description")[:2] == [("Guides", "One", "First"), ("Guides", "Two", None)]
    assert [r["path"] for r in indexes.llms_conflicts(e).collect()] == ["/one"]
    s = spark.createDataFrame([("SUMMARY.md", "# Summary\n\n* [A](a.md)\n  * [B](b.md#x)\n  * [Out](https://x.org)\n## Part\n* [C](c.md)\n")], "file string, body string")
    assert [tuple(r) for r in indexes.summary_nodes(s).orderBy("line_no").select("title", "target", "parent", "section").collect()] == [("A", "a.md", None, ""), ("B", "b.md", 2, ""), ("Out", None, 2, ""), ("C", "c.md", None, "Part")]


def test_discovery_order(spark):
    f = spark.createDataFrame([("/c", "crawl", None), ("/s", "sitemap", None), ("/a", "sidebar", 2), ("/b", "sidebar", 1), ("/a", "crawl", None)], "url string, reason string, hint long")
    assert [r["url"] for r in indexes.discovery_order(f).orderBy("place").collect()] == ["/b", "/a", "/s", "/c"]


def test_html_blocks():
    got = [(r["kind"], r["level"], r["text"]) for r in blocks.html_rows("<title>T</title><script>var x='<p>';</script><h2 id=a>H <b>b</h2><p>one<p>two<br>x<ul><li>a<li>b</ul><pre>\n c\n</pre><img src=u alt=z><hr>tail<svg><p>no</p></svg>")]
    assert got == [("title", None, "T"), ("heading", 2, "H b"), ("paragraph", None, "one"), ("paragraph", None, "two x"), ("listItem", None, "a"), ("listItem", None, "b"), ("code", None, " c"), ("image", None, "z"), ("thematicBreak", None, ""), ("paragraph", None, "tail")]
    assert blocks.html_rows("") == [] and blocks.html_rows("<p></p>") == []


def test_html_references_cut_off_stay_as_written():
    """A reference without its semicolon is text, in headings as in the SQL of block_titles; whole ones are decoded once."""
    got = [r["text"] for r in blocks.html_rows("<h1>a&amp;&amp;&amp</h1><p>x &lt y &copy=1 &#60 &amp;lt; &#62; R&D &</p>")]
    assert got == ["a&&&amp", "x &lt y &copy=1 &#60 &lt; > R&D &"]
    assert blocks.html_rows('<img src="/a?b=1&amp=2&amp;c">')[0]["url"] == "/a?b=1&amp=2&c"


def test_markdown_blocks():
    got = [(r["kind"], r["depth"], r["text"]) for r in blocks.markdown_rows("# A #\n\ntext\nmore\n\n> q\n> r\n\n<Card title=\"x\" n={3}>\n\nin\n\n</Card>\n\n~~~\n# no\n~~~\n***\n![alt](u.png)\n\n1. a\n   b\n2. c\n\n<br/>\nimport x from 'y'\n")]
    assert got == [("heading", 0, "A"), ("paragraph", 0, "text\nmore"), ("blockquote", 0, "q\nr"), ("component", 0, ""), ("paragraph", 1, "in"), ("code", 0, "# no"), ("thematicBreak", 0, ""), ("image", 0, "alt"), ("list", 0, ""), ("listItem", 1, "a\nb"), ("listItem", 1, "c"), ("component", 0, ""), ("esm", 0, "import x from 'y'")]
    assert blocks.markdown_rows("```\nnever closed")[0]["text"] == "never closed" and blocks.markdown_rows("") == []


def test_blocks_of_null_bodies(spark):
    f = spark.createDataFrame([("1", None), ("2", "x")], "page_id string, body string")
    assert rows(blocks.markdown_blocks(f), "page_id", "kind") == [("2", "paragraph")]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:00:00", "ab"[i % 2], 1.0) for i in range(12)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(f"{tmp_path}/events.parquet")
    s = ledger_stream.read(spark, f"{tmp_path}/events.parquet")
    got = ledger_stream.run_once(ledger_stream.windowed_counts(s), "complete")
    assert got.count() == 6 and got.agg(F.sum("n_events")).first()[0] == 12
    once = ledger_stream.run_once(ledger_stream.first_seen(ledger_stream.read(spark, f"{tmp_path}/events.parquet"), ["event_type"], late="1 day"))
    assert sorted(r["event_type"] for r in once.collect()) == ["a", "b"]
