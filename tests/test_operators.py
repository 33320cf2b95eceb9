from pyspark.sql import functions as F

from foliograph.operators import headings, ledger, links, order, passages, reconcile, redirects, rules, sites, trees
from foliograph.plans import gates


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def rule_table(spark, pairs):
    return spark.createDataFrame(pairs, "source string, destination string")


def test_redirect_problems(spark):
    r = rule_table(spark, [("/a", "/b"), ("/b", "/c"), ("/x", "/y"), ("/y", "/z"), ("/z", "/x"), ("/q?x", "/t"), ("/Case", "/t"), ("/case", "/t"), ("/dup", "/1"), ("/dup", "/2"), ("/out", "https://e.org"), ("/gone", "/nowhere")])
    assert ("/a", "/b", "/c") in rows(redirects.chains(r))
    assert rows(redirects.loops(r)) == [("/x",), ("/y",), ("/z",)]
    assert rows(redirects.conflicts(r)) == [("/dup", 2)]
    assert rows(redirects.case_collisions(r)) == [("/case", 2)]
    assert rows(redirects.lost_queries(r)) == [("/q?x", "/t")]
    routes = spark.createDataFrame([("c",), ("t",), ("1/index",), ("2",)], "route string")
    assert rows(redirects.missing_targets(r, routes)) == [("/gone", "/nowhere")]
    assert redirects.loops(rule_table(spark, [])).count() == 0


def test_wildcards_and_shadows(spark):
    r = rule_table(spark, [(f"/old/{k}", f"/new/{k}") for k in "abcd"] + [(f"/p/{k}", f"/q/{k}") for k in "abc"] + [("/p/sub/x", "/elsewhere/x"), ("/m/a", "/n/b"), ("/m/c", "/n/c"), ("/m/d", "/n/d")])
    assert rows(redirects.wildcards(r)) == [("/old/*", "/new/:splat", 4)]
    w = rule_table(spark, [("/p/*", "/q/:splat")])
    assert rows(redirects.shadowed(r, w)) == [("/p/sub/x", "/p/*")]
    plan = spark.createDataFrame([("a/", "b"), ("same", "/same/"), (None, "c")], "old_path string, new_path string")
    assert rows(redirects.exact(plan)) == [("/a", "/b", 308)]


def test_alias_closure(spark):
    a = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("p", "q")], "alias string, target string")
    got = dict(rows(redirects.aliases_closed(a)))
    assert all(got[f"n{i}"] == "n20" for i in range(20)) and got["p"] == "q"


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://h.org/a/one.html", '<a href="two.html#x">t</a><a href="/a/three?q=1">t</a><a href="https://h.org/a/gone">t</a><a href="mailto:a@b">m</a><h2>Top Bit</h2><h2>Top Bit</h2>'), (2, "https://h.org/a/two", '<p id="y"></p>'), (3, "https://h.org/a/three", None)], "page_id long, url string, html string")
    got = links.resolved(links.links(pages), pages)
    assert rows(got, "pos", "route", "fragment") [:3] == [(0, "/a/two", "x"), (1, "/a/three", ""), (2, "/a/gone", "")]
    routes = links.routes(pages)
    assert rows(links.broken(got, routes.filter("page_id <> 2"), routes), "route", "status") == [("/a/gone", "inherited"), ("/a/two", "broken")]
    assert rows(links.anchors(pages)) == [(1, "top-bit"), (1, "top-bit-1"), (2, "y")]
    assert rows(links.lost_fragments(got, routes, links.anchors(pages)), "target_id", "fragment") == [(2, "x")]


def test_subsequence_and_outline(spark):
    f = spark.createDataFrame([(["a", "b"], ["a", "x", "b"]), (["b", "a"], ["a", "b"]), ([], ["a"]), (["a", "a"], ["a"])], "w array<string>, s array<string>")
    assert [r[0] for r in f.select(headings.in_order(F.col("w"), F.col("s"))).collect()] == [True, False, True, False]


def test_ledger(spark):
    rows_ = [(1, 1, 1, "identical", None), (2, 1, 1, "excluded", "r"), (3, 1, 2, "excluded", None), (4, 2, 1, "quarantined", None)]
    led = spark.createDataFrame(rows_, "seq long, page_id long, node_id long, kind string, reviewer string")
    nodes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9)], "page_id long, node_id long")
    assert tuple(ledger.coverage(nodes, led).first()) == (4, 0, 0, 2, 1, 1, 1)
    assert rows(ledger.missing(nodes, led)) == [(2, 9)] and rows(ledger.unattributed_exclusions(led)) == [(1, 2, 3)]
    blocks = spark.createDataFrame([(1, 1, [0]), (1, 2, [0, 1]), (1, 3, [1]), (2, 1, [0])], "page_id long, node_id long, path array<int>")
    out = spark.createDataFrame([(1, 1), (3, 3)], "page_id long, node_id long")
    assert rows(ledger.without_subtrees(blocks, out), "page_id", "node_id") == [(1, 3), (2, 1)]
    assert rows(ledger.unmatched_exclusions(blocks, out)) == [(3, 3)]


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "w"), (3, None), (5, "n")], "k long, v string")
    assert rows(reconcile.drift(a, b, "k", "v")) == [(1, "same"), (2, "changed"), (3, "same"), (4, "missing"), (5, "added")]
    m = spark.createDataFrame([(x,) for x in ["p", "p", "p", "q", None]], "v string")
    s = spark.createDataFrame([("p",), (None,)], "v string")
    assert rows(reconcile.multiset_except(m, s)) == [("p", 2), ("q", 1)]
    c = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (4, "a-2", True), (5, "b", False)], "id long, c string, s boolean")
    assert rows(reconcile.numbered(c, "c", "s", ["id"]), "id", "route") == [(1, "a"), (2, "a-3"), (3, "a-4"), (4, "a-2"), (5, "b")]
    f = spark.createDataFrame([("g", "/r", "image lost"), ("g", "/s", "image lost")], "gate string, route string, detail string")
    w = spark.createDataFrame([("g", "/r", "image")], "gate string, route string, detail string")
    assert rows(reconcile.waived(f, w)) == [("g", "/s", "image lost")]
    h = spark.createDataFrame([("s", f"f{i}", str(i)) for i in range(50)], "s string, p string, h string")
    assert rows(reconcile.merkle_hash(h, "s", "p", "h")) == rows(reconcile.merkle_hash(h.orderBy(F.rand()), "s", "p", "h"))


def test_order(spark):
    n = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert rows(order.placed(n, "v")) == [(i, i) for i in range(1000)]
    assert [r[0] for r in rows(order.even_sample(n, 5, "v"), "v")] == [0, 250, 500, 749, 999] and order.even_sample(n.limit(3), 5, "v").count() == 3
    r = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")] + [(2, 0, "a")], "g long, o long, k string")
    assert rows(order.runs(r, ["g"], ["o"], ["k"]), "g", "o", "run") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 0, 0)]
    text = "a\n````md\n```\nx\n```\n````\nb\n~~~ \n```\n~~~\nc"
    f = order.fence_states(order.lines_of(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t"), "k")
    assert [r["line_no"] for r in f.orderBy("line_no").collect() if not r["fenced"]] == [0, 6, 10]
    o = spark.createDataFrame([("s", i, d) for i, d in enumerate([0, 2, 2, 4, 0, 4])], "g string, o bigint, i bigint")
    assert [r["parent"] for r in order.parents_by_indent(o, ["g"], "o", "i").orderBy("o").collect()] == [None, 0, 0, 2, None, 4]


def test_sites(spark):
    t = spark.createDataFrame([("a", "One | Site"), ("a", "Two | Site"), ("b", "One | Site"), ("b", "Plain"), ("c", "Only | Site"), ("d", "A - B | C"), ("d", "X | C"), ("a", "  ")], "g string, title string")
    assert rows(sites.site_names(t, "g")) == [("a", "Site"), ("b", None), ("c", None), ("d", "C")]
    p = spark.createDataFrame([("h", "/a/b/c"), ("h", "/a/b/d/e"), ("i", "/x"), ("j", ""), ("j", "/y")], "g string, path string")
    assert rows(sites.common_bases(p, "g")) == [("h", 2, "/a/b"), ("i", 1, "/x"), ("j", 2, "/")]
    html = spark.createDataFrame([("<x-one>",), ("<b>",), (None,)], "html string")
    s = sites.platform_scores(html, [("one", "<x-one>", 2.0), ("one", "never", 1.0), ("two", "<b>", 1.0), ("three", "never", 1.0)])
    assert [(r[0], round(r[3], 3)) for r in s.orderBy("platform").collect()] == [("one", 0.667), ("two", 1.0)]
    assert tuple(sites.platform(s).first()) == ("two", 1.0, False)
    assert sites.platform(s.limit(0)).first()["ambiguous"]


def test_rules(spark):
    comps = spark.createDataFrame([("p", 1, "x", "Note", {"type": "info", "id": "7"}, ["big"]), ("p", 2, "x", "Note", {}, []), ("p", 3, "y", "Other", {"a": "1"}, [])], "page_id string, node_id long, platform string, name string, props map<string,string>, style_deps array<string>")
    table = spark.createDataFrame([("*", 0, "Note", None, {}, "Callout", {"kind": "plain"}, "keep", []), ("x", 5, "Note", "big", {"type": "any"}, "Callout", {"kind": "$type", "label": "$missing"}, "keep", [])], rules.RULES)
    out = {r["node_id"]: r for r in rules.applied(rules.matched(comps, table)).collect()}
    assert out[1]["new_props"] == {"kind": "info"} and out[1]["lossy"] == ["id"]
    assert out[2]["new_props"] == {"kind": "plain"} and out[2]["lossy"] == [] and out[3]["new_name"] == "unmapped"


def test_passages(spark):
    d = spark.createDataFrame([(1, "x The quick brown fox jumps over it y"), (2, "quick brown fox"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(10, "the  QUICK brown fox jumps over it"), (11, "quick brown"), (12, " ")], "item_id long, p string")
    assert rows(passages.holders(d, "doc_id", "text", i, "item_id", "p")) == [(1, 10), (1, 11), (2, 11)]
    assert passages.holders(d, "doc_id", "text", i.limit(0), "item_id", "p").count() == 0


def test_gates(spark):
    none, some = spark.range(0), spark.range(3)
    g = gates.rollup(spark, {"a": none, "b": some}, ["a", "b", "c"])
    assert rows(g, "gate", "status") == [("a", "pass"), ("b", "fail"), ("c", "fail")]
    assert tuple(gates.released(g, spark.createDataFrame([("c",)], "gate string")).first()) == (False, "b")
    assert gates.gate("b", some, 2, "id").first()["samples"] == ["0", "1"]


def test_trees(spark):
    from foliograph.sources import blocks

    body = "# T\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n\n```py\ncode  \n```\n\n- one\n- two\n"
    b = blocks.markdown_blocks(spark.createDataFrame([("p", body), ("q", body.replace("| 1 |", "|  1 |"))], "page_id string, body string"))
    assert rows(trees.titles(b)) == [("p", "T"), ("q", "T")]
    assert len({r["signature"] for r in trees.table_signatures(b).collect()}) == 1
    assert {r["code"] for r in trees.code_blocks(b).collect()} == {"code"}
    roots = b.filter("kind = 'list'").select("page_id", "path")
    assert rows(trees.subtree(b, roots), "page_id", "text") == [("p", ""), ("p", "one"), ("p", "two"), ("q", ""), ("q", "one"), ("q", "two")]
    assert "```py\ncode\n```" in trees.to_mdx(b).filter("page_id = 'p'").first()["mdx"]


def test_places_by_locale(spark):
    from foliograph.operators import order

    names = ["b", "A", "ä", "a", "Z", "z", "é", "e", "f", "10", "9", "B", "Ö", "o", None, "a", ""]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    said = lambda **kw: [r["name"] for r in order.placed_by_locale(rows, "name", "id", **kw).orderBy("place").collect()]
    assert said() == [None, "", "10", "9", "a", "a", "A", "ä", "b", "B", "e", "é", "f", "o", "Ö", "z", "Z"]
    assert said(locale="sv")[-2:] == ["ä", "Ö"]
    assert order.placed_by_locale(rows.limit(0), "name", "id").count() == 0


def test_links_in_all_spellings(spark):
    from foliograph.operators import links

    html = """<a href="/a">1</a><A class=x HREF='/b?x=1&amp;y=2'>2</A><a  href=c/d#e>3</a><a data-href="/no">4</a><a href="">5</a><a href = "f">6</a>"""
    pages = spark.createDataFrame([(1, "https://x.example/p/", html), (2, "https://x.example/q", None)], "page_id long, url string, html string")
    assert [r["href"] for r in links.links(pages).orderBy("pos").collect()] == ["/a", "/b?x=1&y=2", "c/d#e", "", "f"]


def test_parents_by_indent_holds_no_group(spark):
    """Groups are passed over, never collected; the open levels go from one batch to the next, and two groups don't mix."""
    rows = [(g, k, (k * 7 + g) % 5) for g in range(3) for k in range(50)]
    df = spark.createDataFrame([*rows, (3, 0, None), (3, 1, 2), (None, 0, 1), (None, 1, 2)], "g int, o long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = order.parents_by_indent(df, ["g"], "o", "i")
        assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
        found = {(r["g"], r["o"]): r["parent"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(g, k): max((o for h, o, j in rows if h == g and o < k and j < i), default=None) for g, k, i in rows}
    assert found == want | {(3, 0): None, (3, 1): None, (None, 0): None, (None, 1): 0}
