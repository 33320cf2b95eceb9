from pyspark.sql import functions as F

from foliograph import workspace
from foliograph.operators import assets, navigation, redirects, specs
from foliograph.plans import structure_queries


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_assets(spark):
    html = '<img src="/a.png" alt="x"><img alt="" src="/b.png"><video src="v.mp4" poster="/a.png"></video><img srcset="/a.png 1x, /c.png 2x" src="data:image/png;base64,xx" alt="d"><meta property="og:image" content="/o.png?a=1&amp;b=2">'
    pages = spark.createDataFrame([(1, "https://h.org/p", html), (2, "https://h.org/q", '<img src="/a.png">'), (3, "https://h.org/r", None)], "page_id long, url string, html string")
    refs = assets.references(pages)
    assert rows(refs.filter("page_id = 1"), "kind", "url") == [("image", "/a.png"), ("image", "/b.png"), ("poster", "/a.png"), ("social", "/o.png?a=1&b=2"), ("srcset", "/a.png"), ("srcset", "/c.png"), ("video", "v.mp4")]
    assert rows(assets.missing_alt(pages)) == [(1, 3, 1), (2, 1, 1)]
    fetched = spark.createDataFrame([("/a.png", bytearray(b"x")), ("/b.png", bytearray(b"x")), ("/z", bytearray(b"yy"))], "url string, content binary")
    assert rows(assets.manifest(fetched, refs), "bytes", "n_urls", "n_pages", "first_url") == [(1, 2, 2, "/a.png"), (2, 1, 0, "/z")]
    out = assets.rewritten(refs.filter("page_id = 1 AND kind = 'image'"), spark.createDataFrame([("/a.png", "https://cdn/a")], "url string, final_url string"), spark.createDataFrame([("/b.png",)], "url string"))
    assert rows(out, "url", "final_url", "status") == [("/a.png", "https://cdn/a", "hosted"), ("/b.png", None, "excluded")]
    assert dict(rows(assets.tally(refs)))["image"] == 3


def test_seo(spark):
    head = '<link rel="canonical" href="{}"><meta name="description" content="About &amp; more"><meta name="robots" content="noindex">'
    pages = spark.createDataFrame([(1, "https://h.org/p.html", head.format("https://h.org/p")), (2, "https://h.org/q", head.format("/other"))], "page_id long, url string, html string")
    s = assets.seo(pages)
    assert rows(s, "page_id", "canonical", "description") == [(1, None, "About & more"), (2, "https://h.org/other", "About & more")]
    later = s.filter("page_id = 1").withColumn("robots", F.lit(None).cast("string"))
    assert ("robots", "noindex", None) in rows(assets.metadata_changes(s, later), "field", "was", "now")


def test_specs(spark):
    one = '{"paths": {"/a": {"get": {"operationId": "x", "r": {"$ref": "./parts/b.json#/d"}}, "post": {"operationId": "x"}, "parameters": []}}}'
    docs = spark.createDataFrame([("api/one.json", one), ("api/parts/b.json", '{"$ref": "../c.yaml", "o": {"$ref": "#/d"}}'), ("api/c.yaml", "$ref: 'gone.json#/x'"), ("bad.json", "{")], "document string, body string")
    refs = specs.references(docs)
    assert rows(refs, "document", "target") == [("api/c.yaml", "api/gone.json"), ("api/one.json", "api/parts/b.json"), ("api/parts/b.json", "api/c.yaml"), ("api/parts/b.json", "api/parts/b.json")]
    roots = docs.filter("document = 'api/one.json'").select("document")
    assert rows(specs.closure(refs, roots)) == [("api/c.yaml", 2), ("api/gone.json", 3), ("api/one.json", 0), ("api/parts/b.json", 1)]
    assert rows(specs.unresolved(refs, docs), "target") == [("api/gone.json",)]
    ops = specs.operations(docs)
    assert rows(ops, "path", "method", "operation_id") == [("/a", "get", "x"), ("/a", "post", "x")]
    assert rows(specs.duplicate_ids(ops)) == [("api/one.json", "x", 2)]
    pages = spark.createDataFrame([(1, "api/one.json", "GET", "/a"), (2, "api/one.json", "PUT", "/a"), (3, "none", "GET", "/a")], "page_id long, document string, method string, path string")
    assert rows(specs.unbound(pages, ops), "page_id", "reason") == [(2, "no such operation"), (3, "no such description")]
    links = spark.createDataFrame([(1, "param-id"), (1, "param-zz"), (1, "other")], "page_id long, fragment string")
    have = spark.createDataFrame([(1, "query-id"), (1, "header-id")], "page_id long, anchor string")
    assert rows(specs.parameter_anchors(links, have)) == [(1, "param-id", "query-id"), (1, "param-zz", None)]
    parts = spark.createDataFrame([("s", "/b", "get", "k", "2"), ("s", "/a", "post", "k", "1")], "spec string, path string, method string, key string, value string")
    assert rows(specs.merged_fragments(parts)) == [("s", "k", "1")]


def test_navigation(spark):
    pages = spark.createDataFrame([("1", "One", ["G", "H"], 2), ("2", "Two", ["G"], 1), ("3", "Top", [], 9)], "page_id string, title string, groups array<string>, ord long")
    nodes = navigation.from_groups(pages)
    assert rows(nodes, "node_id", "parent_id", "ord") == [("g:G", None, 1), ("g:G/H", "g:G", 2), ("p:1", "g:G/H", 2), ("p:2", "g:G", 1), ("p:3", None, 9)]
    side = navigation.sidebar(nodes)
    assert [(r["path"], r["page_id"]) for r in side.orderBy("place").collect()] == [("G/Two", "2"), ("G/H/One", "1"), ("Top", "3")]
    hidden = nodes.withColumn("h", F.col("node_id") == "g:G/H")
    assert rows(navigation.sidebar(hidden, "h"), "page_id") == [("2",), ("3",)]
    assert rows(navigation.problems(nodes, pages.filter("page_id <> '3'"))) == [("p:3", "page without a file")]
    odd = spark.createDataFrame([("t", None, "tab", None), ("x", "t", "group", None), ("y", "t", "page", None), ("z", "gone", "page", None), ("w", "x", "tab", None)], "node_id string, parent_id string, kind string, page_id string")
    assert rows(navigation.problems(odd, pages)) == [("gone", "missing parent"), ("t", "mixed children"), ("x", "child not allowed")]
    assert rows(navigation.unserved(spark.createDataFrame([("1",), ("8",), ("9",)], "page_id string"), nodes, "9")) == [("8",)]
    assert navigation.differences(nodes.withColumn("path", F.col("node_id")), nodes.filter("node_id <> 'p:1'").withColumn("path", F.col("node_id"))).select("side", "path").collect() == [("first", "p:1")]


def test_small_rules(spark):
    s = spark.createDataFrame([("/b", "B", 1), ("/", "Home", 5), ("/b", "Other", 3)], "path string, label string, ord long")
    assert [(r["label"]) for r in navigation.section_tabs(s).orderBy("place").collect()] == ["Home", "B"]
    assert navigation.section_tabs(s.filter("path = '/b'")).count() == 0
    want = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    shown = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b")], "surface string, label string")
    assert rows(navigation.label_shortfalls(want, shown)) == [("a", 1)]
    c = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, ["x", "y"]), (4, None)], "id long, tags array<string>")
    assert rows(navigation.condition_filter(c, "tags", ["x"], ["y"]), "id", "kept") == [(1, "kept"), (2, "dropped"), (3, "ambiguous"), (4, "kept")]
    p = spark.createDataFrame([(1, "a", None, "C"), (2, "b", "a", "C"), (3, "c", "zz", "D"), (4, "d", "d", "D")], "page_id long, slug string, parent_slug string, category string")
    assert rows(navigation.parents_by_slug(p), "page_id", "parent") == [(1, "category:C"), (2, "page:1"), (3, "category:D"), (4, "category:D")]


def test_reference_closure_follows_every_document(spark, tmp_path):
    orders = [(k, k * 7919 % 127) for k in range(1, 900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    depth = {k: 0 for k, _ in orders if k % 400 == 0}
    level, by, n = set(depth), dict(orders), 0
    while level:
        n += 1
        level = {t for k in level & by.keys() for t in (k + 3 * by[k], abs(k - 2 * by[k]))} - depth.keys()
        depth |= dict.fromkeys(level, n)
    assert rows(structure_queries.reference_closure_whole(spark, str(tmp_path))) == sorted(depth.items(), key=str)
    # most are reached only through documents that the filter of reference_closure leaves out
    cut = structure_queries._references(spark, str(tmp_path)).filter("document % 3 = 0")
    roots = spark.createDataFrame([(k,) for k, d in depth.items() if d == 0], "document long")
    assert len(depth) > specs.closure(cut, roots).count()


def test_nodes_beneath_themselves(spark):
    """A node under two parents, one of them beneath it, has its places and no more."""
    from foliograph.operators import navigation, sites

    nodes = spark.createDataFrame([("a", None, "A", 1, "1"), ("b", "a", "B", 1, "2"), ("a", "b", "A", 1, "1"), ("c", "b", "C", 2, "3"), ("x", "y", "X", 1, "9"), ("y", "x", "Y", 1, None)], "node_id string, parent_id string, label string, ord int, page_id string")
    assert sorted(map(tuple, sites.nav_paths(nodes).collect()), key=str) == [("a", "A", 0), ("b", "A/B", 1), ("c", "A/B/C", 2), ("x", None, None), ("y", None, None)]
    assert sorted((r["path"] or "", r["page_id"], r["place"]) for r in navigation.sidebar(nodes).collect()) == [("", "9", 3), ("A", "1", 0), ("A/B", "2", 1), ("A/B/C", "3", 2)]


def test_cycles_of_aliases_end_in_their_smallest_name(spark):
    from foliograph.operators import redirects

    for extra in (0, 40):  # whatever else the table holds
        rows = [("b", "c"), ("c", "d"), ("d", "b"), ("in", "c"), ("one", "two"), ("two", "end")] + [(f"e{k}", f"e{k + 1}") for k in range(extra)]
        got = {r["alias"]: r["canonical"] for r in redirects.aliases_closed(spark.createDataFrame(rows, "alias string, target string")).collect()}
        assert {k: got[k] for k in ("b", "c", "d", "in", "one", "two")} == {"b": "b", "c": "b", "d": "b", "in": "b", "one": "end", "two": "end"}


def test_an_alias_of_many_is_followed_in_all_tasks(spark, monkeypatch):
    """Rows that share a target don't meet in one task, whatever may be broadcast for its size."""
    largest = []

    def written(df, *more, **how):
        out = workspace.written(df.withColumn("part", F.spark_partition_id()), *more, **how)
        sizes = [r["count"] for r in out.groupBy("part").count().collect()]
        largest.append(max(sizes, default=0))
        return out.drop("part")

    monkeypatch.setattr(redirects, "written", written)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        a = spark.range(1, 8_001).selectExpr("id AS alias", "if(id < 3, id - 1, 2) AS target")
        got = redirects.aliases_closed(a).groupBy("canonical").count()
        assert rows(got) == [(0, 8_000)] and max(largest) <= 4_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_loops_leave_behind_what_leads_into_them(spark, monkeypatch):
    """Sources that nothing leads to, and those whose paths end, aren't carried through the rounds."""
    n, sizes = 2_000, []

    def written(df, *more, **how):
        out = workspace.written(df, *more, **how)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(redirects, "written", written)
    step = {i: (i * i + 7 * i + 3) % n for i in range(n) if i % 97}
    got = redirects.loops(spark.createDataFrame([(str(a), str(b)) for a, b in step.items()], "source string, destination string"))

    def circular(at):
        to = step.get(at)
        for _ in range(n):
            if to is None or to == at:
                return to == at
            to = step.get(to)

    assert rows(got) == rows(spark.createDataFrame([(str(i),) for i in step if circular(i)], "source string"))
    assert sum(sizes) < 2 * len(step)
