"""Queries over what a site says of itself: robots files, sitemaps, link lists, summaries, front matter, definitions and API
descriptions. Files are made of the tables' rows, a file for each nation and a line or more for each customer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.operators import navigation, reconcile, routing, sidebars, specs
from foliograph.plans import gates
from foliograph.plans.page_queries import sql_entities
from foliograph.sources import files, indexes
from foliograph.workspace import table


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))


def _files(spark, d, line: Column, head: str = "", foot: str = ""):
    """file, body: the lines of each nation's customers, in the order of their keys."""
    one = _customers(spark, d).select("n", "c", line.alias("line")).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("c", "line"))).alias("ls"))
    return one.select(F.concat(F.lit("f"), "n").alias("file"), F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(foot)).alias("body"))


_ROBOTS = ("User-agent: *\nDisallow: /c1\n\nUser-agent: other\nDisallow: /\n", "User-agent: other\nUser-agent: Me\nDisallow: /c2 # twos\nDisallow: /c3*\n\nUser-agent: *\nDisallow: /\n", "# nothing\nDisallow:\n")


def robots_allowed(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".example")).alias("host"), F.element_at(F.array(*map(F.lit, _ROBOTS)), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("body"))
    pages = _customers(spark, d).select(F.concat(F.lit("https://n"), "n", F.lit(".example/c"), "c").alias("url"))
    return indexes.allowed(pages, indexes.robots_rules(n, "me"))


def sitemap_entries(spark, d):
    """Every seventh address comes twice; the first counts."""
    entry = lambda more: F.concat(F.lit("<url><loc> https://x.example/?a=1&amp;c="), "c", F.lit("</loc>"), more, F.when(F.col("c") % 2 == 0, F.lit("<priority>0.5</priority>")).otherwise("<priority>high</priority>"), F.lit('<xhtml:link rel="alternate" href="/fr"/></url>'))
    line = F.concat(entry(F.concat(F.lit("<lastmod>d"), "c", F.lit("</lastmod>"))), F.when(F.col("c") % 7 == 0, entry(F.lit("<lastmod>later</lastmod>"))).otherwise(""))
    e = indexes.sitemap_entries(_files(spark, d, line, "<urlset>", "</urlset>"))
    return e.select("file", "loc", "lastmod", "priority", F.size("alternates").cast("long").alias("n_alternates"))


def sitemaps_reached(spark, d):
    """Customers as index files that name two others each; what the first reaches within the depth that counts."""
    child = lambda k: F.concat(F.lit("<sitemap><loc>s"), F.col("c") * 2 + k, F.lit("</loc></sitemap>"))
    f = _customers(spark, d).select(F.concat(F.lit("s"), "c").alias("file"), F.concat(child(0), child(1)).alias("body"))
    got = indexes.sitemap_tree(f, spark.createDataFrame([("s1",)], "file string"))
    return got.select("file", F.col("depth").cast("long").alias("depth"))


def llms_entries(spark, d):
    line = F.concat(F.when(F.col("c") % 10 == 0, F.concat(F.lit("## Part "), "c", F.lit("\n"))).otherwise(""), F.lit("- [Title "), F.col("c"), F.lit("](https://x.example/c"), F.col("c"), F.lit(".md)"), F.when(F.col("c") % 3 == 0, F.concat(F.lit(": About "), "c")).otherwise(""), F.lit("\nplain [text](x) here"))
    return indexes.llms_entries(_files(spark, d, line, "# Site\n")).select("file", "section", "title", "url", "description")


def summary_parents(spark, d):
    """Bullets indented by their key; every fifth leads elsewhere."""
    line = F.concat(F.repeat(F.lit("  "), (F.col("c") % 3).cast("int")), F.lit("* [C"), "c", F.lit("]("), F.when(F.col("c") % 5 == 0, F.lit("https://e.example/")).otherwise(F.concat(F.lit("c/"), "c", F.lit(".md#top"))), F.lit(")"))
    got = indexes.summary_nodes(_files(spark, d, line))
    return got.select("file", "line_no", "title", "target", "parent")


def discovered_order(spark, d):
    o = table(spark, d, "orders")
    reason = F.when(F.col("o_orderstatus") == "F", "sidebar").when(F.col("o_orderstatus") == "P", "sitemap").otherwise("link")
    found = o.select(F.concat(F.lit("https://x.example/"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("url"), reason.alias("reason"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 1000).alias("hint"))
    got = indexes.discovery_order(found)
    return got.select("url", F.col("place").cast("long").alias("place"), F.array_join("reasons", ",").alias("reasons"))


def front_matter(spark, d):
    """Documents with front matter, every fourth without."""
    head = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('---\nlang: "'), "lang", F.lit("\"\ntitle: first\nn: "), "doc_id", F.lit("\ntitle: 'last'\n  nested: no\n---\n")))
    f = table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    got = files.with_frontmatter(f)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return got.select("doc_id", pairs.alias("data"), F.md5("body").alias("md5"))


def definitions_found(spark, d):
    """Parts as source files below snippets or elsewhere; of one name the first path counts."""
    p = table(spark, d, "part")
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "snippets/").otherwise("pages/"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit(".jsx"))
    f = p.select(path.alias("path"), F.concat(F.lit("export const "), F.initcap("p_type"), F.lit(" = () => "), "p_partkey").cast("binary").alias("content"))
    return files.component_definitions(f)


def placeholders_used(spark, d):
    p = table(spark, d, "documents").select(F.concat(F.coalesce("text", F.lit("")), F.lit(" {{ "), "lang", F.lit(".name }} {{"), "source", F.lit("}} {{ two words }}")).alias("text"))
    return files.tokens_used(p)


def _descriptions(spark, d):
    line = F.concat(F.lit('"/c'), "c", F.lit('": {"get": {"operationId": "op'), (F.col("c") - F.col("c") % 10).cast("string"), F.lit('"}, "summary": "no method"'), F.when(F.col("c") % 2 == 0, ', "post": {}').otherwise(""), F.lit("}"))
    one = _customers(spark, d).select("n", "c", line.alias("line")).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("c", "line"))).alias("ls"))
    return one.select(F.concat(F.lit("f"), "n").alias("document"), F.concat(F.lit('{"paths": {'), F.array_join(F.transform("ls", lambda x: x["line"]), ","), F.lit("}}")).alias("body"))


def repeated_operation_ids(spark, d):
    return specs.duplicate_ids(specs.operations(_descriptions(spark, d)))


def unbound_operations(spark, d):
    """Customers as pages of operations: some of another nation's description, some by a method that isn't there."""
    p = _customers(spark, d).select(F.col("c").alias("page_id"), F.concat(F.lit("f"), F.when(F.col("c") % 9 == 0, F.col("n") + 1).otherwise(F.col("n"))).alias("document"), F.when(F.col("c") % 4 < 2, "POST").otherwise("Get").alias("method"), F.concat(F.lit("/c"), "c").alias("path"))
    return specs.unbound(p, specs.operations(_descriptions(spark, d))).select("page_id", "document", "reason")


def parameter_anchors(spark, d):
    c = _customers(spark, d)
    links = c.select(F.col("c").alias("page_id"), F.when(F.col("c") % 6 == 0, "other").otherwise(F.concat(F.lit("param-p"), "c")).alias("fragment"))
    anchors = c.select(F.col("c").alias("page_id"), F.explode(F.array(*[F.when(F.col("c") % m == 0, F.concat(F.lit(f"{p}-p"), "c")) for p, m in (("body", 1), ("header", 2), ("path", 5))])).alias("anchor")).filter("anchor IS NOT NULL AND page_id % 7 <> 0")
    return specs.parameter_anchors(links, anchors)


def parents_by_slug(spark, d):
    c = _customers(spark, d).select(F.col("c").alias("page_id"), F.concat(F.lit("s"), "c").alias("slug"), F.when(F.col("c") % 3 > 0, F.concat(F.lit("s"), (F.col("c") / 2).cast("int"))).alias("parent_slug"), F.concat(F.lit("k"), "n").alias("category"))
    return navigation.parents_by_slug(c)


def fragments_merged(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey")).alias("spec"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"), F.lit("get").alias("method"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").cast("string").alias("value"))
    return specs.merged_fragments(o)


def sidebar_trees(spark, d):
    """Pages' navigation, with a list of two levels, an empty group, a badge and a link to a fragment at its end."""
    more = F.concat(F.lit('<li><a href="/g'), "page_id", F.lit('">Group <span class="badge">new</span></a><ul><li>Inner<ul><li><a href=\'/x\'>X &amp; Y</a></li></ul></li><li><a href="#f">F</a></li></ul></li><li><span>Empty</span><ul></ul></li></ul></nav>'))
    p = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("</ul></nav>"), more).alias("html"))
    got = sidebars.sidebar_nodes(p)
    up = got.select("page_id", F.col("node").alias("parent"), F.col("label").alias("under"))
    return got.join(up, ["page_id", "parent"], "left").select("page_id", "kind", "label", "href", "under")


def script_data(spark, d):
    """Pages with JSON in scripts, whole and in pieces."""
    k = F.col("page_id").cast("string")
    more = F.concat(F.lit('<script type="application/ld+json">{"b": [1, {"z": 1, "a": "'), k, F.lit('"}], "a": null}</script><script>self.f.push([1,"1:{\\"k\\":"])</script><script>self.f.push([1,"'), k, F.lit('}\\n2:no json\\n"])</script>'))
    got = sidebars.embedded_json(table(spark, d, "pages").select("page_id", F.concat("html", more).alias("html")))
    return got.select("page_id", F.to_json("v").alias("json"))


def published_unwrapped(spark, d):
    """Documents as published: with a wrapper, a title, a description that is repeated or a quotation of their own, by turns."""
    k = F.col("doc_id")
    head = F.concat(F.when(k % 2 == 0, F.lit("\ufeff\n> ## Documentation Index\n> more\n\n")).otherwise(""), F.when(k % 3 > 0, F.concat(F.lit("# Title \\_"), k, F.lit("\n\n"))).otherwise(""), F.when(k % 5 == 0, F.lit("> About  it\n> all\n\n")).when(k % 5 == 1, F.lit("> Words\n\n")).otherwise(""))
    p = table(spark, d, "documents").select("doc_id", F.concat(head, F.lit("Begin "), F.coalesce("text", F.lit(""))).alias("published"), F.lit("About it all").alias("expected"))
    got = sidebars.unwrapped_markdown(p, "published", "expected")
    return got.select("doc_id", "wrapped", "title", "description", F.md5("authored").alias("md5"))


def paths_from_tree(spark, d):
    c = table(spark, d, "customer")
    groups = F.array(F.concat(F.lit("Area "), "c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "(uncategorised)").when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")))
    return c.select("c_custkey", routing.path_from_tree(groups, F.concat(F.lit("Page "), "c_custkey")).alias("path"))


def sorted_documents(spark, d):
    o = table(spark, d, "orders")
    json = F.concat(F.lit('{ "z": {"b": '), "o_orderkey", F.lit(', "a": [ {"d": 1, "c": "'), "o_orderstatus", F.lit('"} ]}, "k": true'), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(" }"))
    return o.select("o_orderkey", reconcile.sorted_json(json).alias("json"))


def proofs_inapplicable(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.when(F.col("c_custkey") % 3 == 0, "repository").otherwise("url").alias("kind"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4 == 1).alias("publishes_markdown"))
    return gates.inapplicable(c)


QUERIES = {f.__name__: f for f in (robots_allowed, sitemap_entries, sitemaps_reached, llms_entries, summary_parents, discovered_order, front_matter, definitions_found, placeholders_used, repeated_operation_ids, unbound_operations, parameter_anchors, parents_by_slug, fragments_merged, sidebar_trees, script_data, published_unwrapped, paths_from_tree, sorted_documents, proofs_inapplicable)}

_C = "c AS (SELECT c_custkey AS c, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)"
ORACLES = {
    "robots_allowed": f"""WITH {_C} SELECT 'https://n' || n || '.example/c' || c AS url FROM c
      WHERE NOT (n % 3 = 0 AND c::VARCHAR LIKE '1%') AND NOT (n % 3 = 1 AND (c::VARCHAR LIKE '2%' OR c::VARCHAR LIKE '3%'))""",
    "sitemap_entries": f"""WITH {_C} SELECT 'f' || n AS file, 'https://x.example/?a=1&c=' || c AS loc, 'd' || c AS lastmod, CASE WHEN c % 2 = 0 THEN 0.5::DOUBLE END AS priority, 1::BIGINT AS n_alternates FROM c""",
    "sitemaps_reached": f"""WITH RECURSIVE {_C}, r AS (SELECT 1::BIGINT AS k, 0::BIGINT AS depth UNION ALL SELECT r.k * 2 + b, depth + 1 FROM r JOIN c ON c.c = r.k, range(2) q(b) WHERE depth < 8) SELECT 's' || k AS file, depth FROM r""",
    "llms_entries": f"""WITH {_C} SELECT 'f' || n AS file, 'Part ' || (SELECT max(e.c) FROM c e WHERE e.n = c.n AND e.c <= c.c AND e.c % 10 = 0) AS section, 'Title ' || c AS title, 'https://x.example/c' || c || '.md' AS url,
      CASE WHEN c % 3 = 0 THEN 'About ' || c END AS description FROM c""",
    "summary_parents": f"""WITH {_C} SELECT 'f' || n AS file, i AS line_no, 'C' || c AS title, CASE WHEN c % 5 > 0 THEN 'c/' || c || '.md' END AS target,
      (SELECT max(e.i) FROM c e WHERE e.n = c.n AND e.i < c.i AND e.c % 3 < c.c % 3) AS parent FROM c""",
    "discovered_order": """
      WITH f AS (SELECT o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 'sidebar' WHEN 'P' THEN 'sitemap' ELSE 'link' END AS reason, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 END AS hint FROM orders),
      o AS (SELECT 'https://x.example/' || lpad(c::VARCHAR, 9, '0') AS url, min(CASE reason WHEN 'sidebar' THEN 0 WHEN 'sitemap' THEN 1 ELSE 2 END) AS tier, min(hint) AS hint, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM f GROUP BY c)
      SELECT url, row_number() OVER (ORDER BY tier, hint NULLS LAST, url) - 1 AS place, reasons FROM o""",
    "front_matter": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'lang=' || lang || ',n=' || doc_id || ',title=last' END AS data, md5(coalesce(text, '')) AS md5 FROM documents""",
    "definitions_found": """
      WITH f AS (SELECT upper(p_type[1]) || lower(p_type[2:]) AS name, min(p_partkey) AS k FROM part WHERE p_size % 2 = 0 GROUP BY 1)
      SELECT name, sha256('export const ' || name || ' = () => ' || k)[1:16] AS definition_hash, 'snippets/' || lpad(k::VARCHAR, 7, '0') || '.jsx' AS path FROM f""",
    "placeholders_used": "SELECT token, count(*) AS n FROM (SELECT lang || '.name' AS token FROM documents UNION ALL SELECT source FROM documents) GROUP BY token",
    "repeated_operation_ids": f"WITH {_C} SELECT 'f' || n AS document, 'op' || (c - c % 10) AS operation_id, count(*) AS n FROM c GROUP BY c.n, c - c % 10 HAVING count(*) > 1",
    "unbound_operations": f"""WITH {_C}, p AS (SELECT c, CASE WHEN c % 9 = 0 THEN n + 1 ELSE n END AS f, c % 9 = 0 AS off, c % 4 < 2 AS post FROM c)
      SELECT c AS page_id, 'f' || f AS document, CASE WHEN f NOT IN (SELECT n FROM c) THEN 'no such description' ELSE 'no such operation' END AS reason FROM p WHERE off OR (post AND c % 2 = 1)""",
    "parameter_anchors": f"""WITH {_C} SELECT c AS page_id, 'param-p' || c AS fragment, CASE WHEN c % 7 <> 0 THEN CASE WHEN c % 5 = 0 THEN 'path' WHEN c % 2 = 0 THEN 'header' ELSE 'body' END || '-p' || c END AS anchor FROM c WHERE c % 6 <> 0""",
    "parents_by_slug": f"""WITH {_C} SELECT a.c AS page_id, CASE WHEN b.c IS NOT NULL THEN 'page:' || b.c ELSE 'category:k' || a.n END AS parent, CASE WHEN b.c IS NOT NULL THEN 'page' ELSE 'category' END AS placed_by
      FROM c a LEFT JOIN c b ON b.c = a.c // 2 AND a.c % 3 > 0""",
    "fragments_merged": "SELECT 's' || o_custkey AS spec, o_orderstatus AS key, min_by(o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0'))::VARCHAR AS value FROM orders GROUP BY ALL",
    "sidebar_trees": rf"""
      WITH n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), '<a\b[^>]*>.*?</a>')) AS a FROM pages)
      SELECT page_id, 'page' AS kind, trim({sql_entities("regexp_extract(a, '>(.*?)</a>', 1)")}) AS label, {sql_entities("regexp_extract(a, 'href=.([^>]*).>', 1)")} AS href, NULL AS under FROM n
      UNION ALL SELECT page_id, kind, label, CASE label WHEN 'Group' THEN '/g' || page_id WHEN 'X & Y' THEN '/x' END, under FROM pages, (VALUES ('group', 'Group', NULL), ('group', 'Inner', 'Group'), ('page', 'X & Y', 'Inner')) v(kind, label, under)""",
    "script_data": """
      SELECT page_id, unnest(['{"a":null,"b":[1,{"a":"' || page_id || '","z":1}]}', '{"k":' || page_id || '}']) AS json FROM pages""",
    "published_unwrapped": """
      SELECT doc_id, doc_id % 2 = 0 AS wrapped, CASE WHEN doc_id % 3 > 0 THEN 'Title _' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN 'About it all' END AS description,
        md5(CASE WHEN doc_id % 5 = 1 THEN '> Words' || chr(10) || chr(10) ELSE '' END || regexp_replace('Begin ' || coalesce(text, ''), '\\s+$', '') || chr(10)) AS md5 FROM documents""",
    "paths_from_tree": """SELECT c_custkey, 'area-' || c_nationkey || CASE WHEN c_custkey % 3 = 1 THEN '/' || lower(c_mktsegment) ELSE '' END || '/page-' || c_custkey AS path FROM customer""",
    "sorted_documents": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN '{"k":true,"z":{"a":[{"c":"' || o_orderstatus || '","d":1}],"b":' || o_orderkey || '}}' END AS json FROM orders""",
    "proofs_inapplicable": """
      SELECT c_custkey AS site, gate, reason FROM customer, (VALUES (true, 'html-reconciliation', 'no rendered pages'), (true, 'chrome-absent', 'no page furniture'), (false, 'source-content-exact', 'no published Markdown')) v(of_files, gate, reason)
      WHERE (c_custkey % 3 = 0) = of_files AND (of_files OR c_custkey % 4 <> 1)""",
}
