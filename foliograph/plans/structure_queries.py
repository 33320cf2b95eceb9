"""Queries over navigation, components and references, with tables of orders and events as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import urls
from foliograph.operators import assets, navigation, reports, rules, specs
from foliograph.workspace import table


def _placed_suppliers(spark, d):
    """Suppliers as pages in groups of region and nation."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("s_suppkey").cast("string").alias("page_id"), F.col("s_name").alias("title"), F.array("r_name", "n_name").alias("groups"), F.col("s_suppkey").alias("ord"))


def nav_from_groups(spark, d):
    return navigation.from_groups(_placed_suppliers(spark, d)).select("node_id", "parent_id", "kind", "label", "ord", "page_id")


def sidebar_order(spark, d):
    return navigation.sidebar(navigation.from_groups(_placed_suppliers(spark, d))).select("path", "page_id", F.col("place").cast("long").alias("place"))


def navigation_problems(spark, d):
    nodes = navigation.from_groups(_placed_suppliers(spark, d))
    files = table(spark, d, "supplier").filter("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("page_id"))
    return navigation.problems(nodes, files)


def navigation_differences(spark, d):
    """The navigation against one in which every eighth supplier moved."""
    a = navigation.from_groups(_placed_suppliers(spark, d)).withColumn("path", F.coalesce("parent_id", F.lit("")))
    b = a.withColumn("path", F.when((F.col("kind") == "page") & (F.col("ord") % 8 == 0), "g:MOVED").otherwise(F.col("path")))
    return navigation.differences(a, b).select("side", "path", "label")


def unserved_pages(spark, d):
    written = table(spark, d, "supplier").select((F.col("s_suppkey") + 7).alias("page_id"))
    return navigation.unserved(written, navigation.from_groups(_placed_suppliers(spark, d)))


def _components(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 500).cast("string").alias("page_id"), F.col("event_id").alias("node_id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("platform"), F.col("event_type").alias("name"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string")).alias("props"), F.array(F.when(F.col("value") > 30, "big").otherwise("small")).alias("style_deps"))


RULES = [
    ("*", 1, "click", None, {}, "Button", {"size": "$k"}, "keep", ["user"]),
    ("even", 9, "click", "big", {}, "BigButton", {"size": "$k", "by": "$user"}, "keep", []),
    ("*", 2, "view", None, {"k": "7"}, "Seven", {}, "drop", []),
    ("*", 3, "view", None, {"k": "any"}, "Frame", {"title": "$missing", "kind": "fixed"}, "unwrap", []),
    ("odd", 4, "error", "small", {"user": "any"}, "Note", {"text": "$k"}, "keep", []),
]


def component_rules(spark, d):
    """What the first matching rule makes of each component; events stand in for components."""
    out = rules.applied(rules.matched(_components(spark, d), spark.createDataFrame(RULES, rules.RULES)))
    props = F.array_join(F.transform(F.array_sort(F.map_entries("new_props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("node_id", "new_name", props.alias("props"), F.array_join("lossy", ",").alias("lossy"))


def reference_closure(spark, d):
    """Documents reached from every fiftieth one; orders stand in for references, each among fifty neighbours."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    edges = o.select(key.alias("document"), (key - key % 50 + (F.col("o_custkey") * 3 + key) % 50).alias("target"))
    return specs.closure(edges, edges.filter("document % 50 = 0").select("document")).select("document", F.col("depth").cast("long").alias("depth"))


def _references(spark, d):
    """Two references of each document, from the whole keys of orders: one forward, one back."""
    o, key, by = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(key.alias("document"), F.explode(F.array(key + by * 3, F.abs(key - by * 2))).alias("target"))


def reference_closure_whole(spark, d):
    """Documents reached from every 400th one over the references of all; orders stand in for references."""
    edges = _references(spark, d)
    roots = edges.filter("document % 400 = 0").select("document")
    return specs.closure(edges, roots).select("document", F.col("depth").cast("long").alias("depth"))


def asset_references(spark, d):
    """Media that pages load; each page is given a picture, some a variant set."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.col("html"), F.lit('<img alt="a" src="/i/'), F.col("page_id") % 10, F.lit('.png"'), F.when(F.col("page_id") % 4 == 0, ' srcset="/s/1.png 1x, /s/2.png 2x"').otherwise(""), F.lit(">")).alias("html"))
    return assets.references(p)


def seo_fields(spark, d):
    p = table(spark, d, "pages")
    p = p.withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit('<head><link rel="canonical" href="'), F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", r"[?#].*$", "")).otherwise("/elsewhere"), F.lit('"><meta name="description" content="Page '), F.col("page_id").cast("string"), F.lit(' &amp; more">'))))
    return assets.seo(p).select("page_id", "canonical", "description", "robots")


def shortfalls(spark, d):
    """Orders kept back by status and priority, with the first three of each; a stand-in for skipped pages."""
    o = table(spark, d, "orders").select(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("reason"), "o_orderkey")
    return reports.shortfalls(o, "reason", "o_orderkey")


def section_of_page(spark, d):
    """Pages by the longest declared section their path lies in; sections are the paths of every twentieth page's directory."""
    p = table(spark, d, "pages").select("page_id", urls.path(F.col("url")).alias("path"))
    sections = p.filter("page_id % 20 = 0").select(F.regexp_replace("path", "/[^/]*/?$", "").alias("section")).filter("section <> ''").distinct()
    met = p.select("page_id", F.explode(urls.section_prefixes(F.col("path"))).alias("section")).join(sections, "section")
    best = met.groupBy("page_id").agg(F.max_by("section", F.length("section")).alias("section"))
    return p.select("page_id").join(best, "page_id", "left").groupBy("section").agg(F.count("*").alias("n_pages"))


QUERIES = {f.__name__: f for f in (shortfalls, section_of_page, nav_from_groups, sidebar_order, navigation_problems, navigation_differences, unserved_pages, component_rules, reference_closure, reference_closure_whole, asset_references, seo_fields)}

_PLACED = """placed AS (SELECT s_suppkey::VARCHAR AS page_id, s_name AS title, r_name AS g1, n_name AS g2, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_NODES = f"""{_PLACED}, nodes AS (
  SELECT 'g:' || g1 AS node_id, NULL::VARCHAR AS parent_id, 'group' AS kind, g1 AS label, min(ord) AS ord, NULL::VARCHAR AS page_id FROM placed GROUP BY g1
  UNION ALL SELECT 'g:' || g1 || '/' || g2, 'g:' || g1, 'group', g2, min(ord), NULL FROM placed GROUP BY g1, g2
  UNION ALL SELECT 'p:' || page_id, 'g:' || g1 || '/' || g2, 'page', title, ord, page_id FROM placed)"""
ORACLES = {
    "shortfalls": """SELECT o_orderstatus || ':' || o_orderpriority AS reason, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS examples FROM orders GROUP BY 1""",
    "section_of_page": r"""
      WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
      s AS (SELECT DISTINCT regexp_replace(path, '/[^/]*/?$', '') AS section FROM p WHERE page_id % 20 = 0 AND regexp_replace(path, '/[^/]*/?$', '') <> ''),
      b AS (SELECT p.page_id, max_by(s.section, length(s.section)) AS section FROM p LEFT JOIN s ON p.path = s.section OR starts_with(p.path, s.section || '/') GROUP BY 1)
      SELECT section, count(*) AS n_pages FROM b GROUP BY 1""",
    "nav_from_groups": f"WITH {_NODES} SELECT node_id, parent_id, kind, label, ord, page_id FROM nodes",
    "sidebar_order": f"""WITH {_PLACED}, o AS (SELECT *, min(ord) OVER (PARTITION BY g1) AS o1, min(ord) OVER (PARTITION BY g1, g2) AS o2 FROM placed)
      SELECT g1 || '/' || g2 || '/' || title AS path, page_id, row_number() OVER (ORDER BY o1, g1, o2, g2, ord, page_id) - 1 AS place FROM o""",
    "navigation_problems": f"WITH {_NODES} SELECT node_id, 'page without a file' AS problem FROM nodes WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 9 <> 4)",
    "navigation_differences": f"""WITH {_NODES}, m AS (SELECT * FROM nodes WHERE kind = 'page' AND ord % 8 = 0)
      SELECT 'first' AS side, parent_id AS path, label FROM m UNION ALL SELECT 'second', 'g:MOVED', label FROM m""",
    "unserved_pages": "SELECT (s_suppkey + 7)::VARCHAR AS page_id FROM supplier WHERE s_suppkey + 7 NOT IN (SELECT s_suppkey FROM supplier)",
    "component_rules": """
      WITH c AS (SELECT event_id AS node_id, user_id % 2 = 0 AS even, event_type AS name, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS u, value > 30 AS big FROM events)
      SELECT node_id, CASE WHEN name = 'click' AND even AND big THEN 'BigButton' WHEN name = 'click' THEN 'Button' WHEN name = 'view' AND k = '7' THEN 'Seven' WHEN name = 'view' THEN 'Frame'
          WHEN name = 'error' AND NOT even AND NOT big THEN 'Note' ELSE 'unmapped' END AS new_name,
        CASE WHEN name = 'click' AND even AND big THEN 'by=' || u || ',size=' || k WHEN name = 'click' THEN 'size=' || k WHEN name = 'view' AND k = '7' THEN '' WHEN name = 'view' THEN 'kind=fixed'
          WHEN name = 'error' AND NOT even AND NOT big THEN 'text=' || k ELSE 'k=' || k || ',user=' || u END AS props,
        CASE WHEN name = 'view' THEN 'user' ELSE '' END AS lossy FROM c""",
    "reference_closure": """
      WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS document, o_orderkey - o_orderkey % 50 + (o_custkey * 3 + o_orderkey) % 50 AS target FROM orders),
      w AS (SELECT DISTINCT document, 0::BIGINT AS depth FROM e WHERE document % 50 = 0
        UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.document = w.document WHERE e.document <> e.target AND w.depth < 50)
      SELECT document, min(depth) AS depth FROM w GROUP BY document""",
    "asset_references": """
      SELECT page_id, 'image' AS kind, '/i/' || (page_id % 10) || '.png' AS url FROM pages
      UNION ALL SELECT page_id, 'srcset', u FROM pages, (VALUES ('/s/1.png'), ('/s/2.png')) t(u) WHERE page_id % 4 = 0""",
    "seo_fields": r"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN regexp_extract(url, '^[^/]*//', 0) || lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)) || '/elsewhere' END AS canonical,
      'Page ' || page_id || ' & more' AS description, NULL::VARCHAR AS robots FROM pages""",
}
