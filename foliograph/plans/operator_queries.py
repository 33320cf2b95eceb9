"""Queries over operators for ledgers, navigation, redirects, assets and reports; tables of orders, events and pages stand in for theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import assets, navigation, order, passages, reconcile, redirects, reports, sites
from foliograph.operators import headings as hd
from foliograph.operators import ledger as lg
from foliograph.plans import corpus_queries, gates, page_queries, structure_queries, table_queries
from foliograph.workspace import table


def effective_exclusions(spark, d):
    return lg.effective_exclusions(table_queries._ledger(spark, d))


def disposition_counts(spark, d):
    return lg.quarantine_counts(table_queries._ledger(spark, d))


#: A tree of 15 blocks: block k has the children 2k + 1 and 2k + 2.
TREE = [[0], [0, 0], [0, 1], [0, 0, 0], [0, 0, 1], [0, 1, 0], [0, 1, 1], *([0, a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1))]


def _tree(spark, d):
    paths = F.array(*[F.array(*map(F.lit, p)) for p in TREE])
    return table(spark, d, "pages").select("page_id", F.posexplode(paths).alias("node_id", "path"))


def blocks_without_exclusions(spark, d):
    """Fifteen blocks a page, of which every eleventh is excluded with what lies beneath it."""
    blocks = _tree(spark, d)
    return lg.without_subtrees(blocks, blocks.filter("(page_id * 3 + node_id) % 11 = 0")).select("page_id", F.col("node_id").cast("long").alias("node_id"))


def findings_not_waived(spark, d):
    findings = table(spark, d, "events").select("event_id", F.col("event_type").alias("gate"), F.concat(F.lit("/u"), F.col("user_id") % 20).alias("route"), F.col("props").alias("detail"))
    accepted = spark.createDataFrame([("click", "/u3", '"k"'), ("view", "/u4", '"k": 7'), ("error", "/u5", "never there"), ("purchase", "/u6", "")], "gate string, route string, detail string")
    return reconcile.waived(findings, accepted).select("event_id")


def _decisions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("rule"), (F.col("o_orderkey") % 3 == 0).alias("needs_review"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("reviewer"), "o_orderkey")


def decision_gaps(spark, d):
    return reports.gaps(_decisions(spark, d))


def unreviewed_decisions(spark, d):
    return reports.unreviewed(_decisions(spark, d)).select("o_orderkey")


def unplaced_pages(spark, d):
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))
    nodes = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("page_id"))
    return sites.unplaced(pages, nodes)


def search_canary(spark, d):
    """The first words of five documents are looked for in them, those of the third in another one."""
    docs = table(spark, d, "documents").filter("length(text) > 40")
    searches = docs.select(F.col("doc_id").alias("search_id"), F.when(F.col("doc_id") == 2, 0).otherwise(F.col("doc_id")).alias("page_id"), F.substring_index("text", " ", 3).alias("phrase"))
    return reports.canary(searches, docs.select(F.col("doc_id").alias("page_id"), "text"))


def shadowed_redirects(spark, d):
    """Rules between routes of orders against two wildcard rules, one of which agrees with some of them."""
    rules = table(spark, d, "orders").select(F.concat(F.lit("/g"), F.col("o_custkey") % 10, F.lit("/p"), F.col("o_orderkey")).alias("source"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/new/p"), "o_orderkey")).otherwise("/other").alias("destination"))
    wild = spark.createDataFrame([("/g3/*", "/new/:splat"), ("/g4/*", "/elsewhere")], "source string, destination string")
    return redirects.shadowed(rules, wild)


def label_shortfalls(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_brand").alias("label"))
    shown = table(spark, d, "part").select(F.concat_ws("-", "p_type", F.col("p_partkey") % 3).alias("surface"), F.col("p_brand").alias("label"))
    return navigation.label_shortfalls(wanted, shown)


def condition_tags(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "cloud"), F.when(F.col("event_id") % 3 == 0, "internal"), F.when(F.col("event_id") % 5 == 0, "old")))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 > 0, tags).alias("tags"))
    return navigation.condition_filter(rows, "tags", ["cloud"], ["internal", "old"]).select("event_id", "kept")


def section_tabs(spark, d):
    s = table(spark, d, "nation").select(F.when(F.col("n_regionkey") == 2, "/").otherwise(F.concat(F.lit("/r"), "n_regionkey")).alias("path"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"))
    return navigation.section_tabs(s)


def published_pages(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4 == 0).alias("draft"), (F.col("c_acctbal") < 0).alias("unlisted"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") > 20).alias("hidden"))
    return navigation.published(p, ["draft", "unlisted", "hidden"]).select("c_custkey", "withheld")


def pages_of_links(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.concat(F.lit("/c"), F.col("o_custkey") + 1).alias("route"))
    pages = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("/c"), "c_custkey").alias("route"))
    return navigation.pages_of_links(nodes, pages).select("node_id", "page_id")


def sidebars_observed(spark, d):
    """Suppliers' items as sidebars over parts; only some are large enough to be navigation."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sidebar"), F.col("l_partkey").alias("url"))
    return navigation.sidebars_observed(items, table(spark, d, "part").agg(F.count("*").alias("n")))


def language_sets(spark, d):
    return navigation.value_sets(table(spark, d, "documents"), "source", "lang", "en")


def _assets(spark, d):
    """Every order refers to a picture of its customer's; pictures of one segment have one content."""
    c = table(spark, d, "customer")
    fetched = c.select(F.concat(F.lit("/i/"), "c_custkey").alias("url"), F.concat("c_mktsegment", F.col("c_nationkey") % 3).alias("content"))
    references = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderkey") % 3 == 0, "image").otherwise("file").alias("kind"), F.concat(F.lit("/i/"), "o_custkey").alias("url"))
    return fetched, references


def asset_manifest(spark, d):
    return assets.manifest(*_assets(spark, d))


def asset_tally(spark, d):
    return assets.tally(_assets(spark, d)[1])


def assets_rewritten(spark, d):
    fetched, references = _assets(spark, d)
    final = fetched.filter("url LIKE '%7' OR url LIKE '%1'").select("url", F.concat(F.lit("https://cdn.example"), "url").alias("final_url"))
    done = assets.rewritten(references, final, fetched.filter("url LIKE '%21' OR url LIKE '%5'").select("url"))
    return done.groupBy("kind", "status").agg(F.count("*").alias("n"), F.min("final_url").alias("first_final"))


def indented_parents(spark, d):
    """Forty lines a page with indents that rise and fall."""
    lines = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("line"))
    lines = lines.withColumn("indent", (F.col("page_id") * 7 + F.col("line") * F.col("line") * 5) % 9)
    return order.parents_by_indent(lines, ["page_id"], "line", "indent").select("page_id", "line", "indent", "parent")


def code_missing(spark, d):
    """Parts' types as the code of a source's pages; the copy has them but for one brand, which it has elsewhere only."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("page_id"), "p_brand", F.sha2("p_type", 256).alias("code_hash"))
    return passages.missing_code(p, p.filter("p_brand <> 'Brand#1' AND p_brand NOT LIKE '%3'"))


def known_pages(spark, d):
    route = lambda t, c, f=None: (table(spark, d, t).filter(f) if f else table(spark, d, t)).select(F.concat(F.lit("/"), c).alias("route"))
    return reconcile.known_pages(manifest=route("customer", "c_custkey", "c_custkey % 2 = 0"), tree=route("customer", "c_custkey", "c_custkey % 3 = 0"), sitemap=route("orders", "o_custkey", "o_orderstatus = 'P'"))


def retained_pages(spark, d):
    o = table(spark, d, "orders")
    return reconcile.retained(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_custkey")


def sorted_keys(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"z": "'), "event_type", F.lit('", "a": "'), F.col("user_id").cast("string"), F.lit('", "m": "1"}')).alias("document"))
    return e.select("event_id", reconcile.sorted_keys(F.col("document")).alias("document"))


def outlines_in_order(spark, d):
    """Whether every third word of a document's first line comes in order, read forwards for even ids and backwards for odd ones."""
    words = F.split(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), " ")
    docs = table(spark, d, "documents").select("doc_id", words.alias("shown"))
    some = F.filter("shown", lambda w, i: i % 3 == 0)
    docs = docs.withColumn("wanted", F.when(F.col("doc_id") % 2 == 0, some).otherwise(F.reverse(some)))
    return docs.select("doc_id", hd.in_order(F.col("wanted"), F.col("shown")).alias("in_order"))


_FUNCTIONS = (
    effective_exclusions, disposition_counts, blocks_without_exclusions, findings_not_waived, decision_gaps, unreviewed_decisions, unplaced_pages, search_canary, shadowed_redirects, label_shortfalls, condition_tags,
    section_tabs, published_pages, pages_of_links, sidebars_observed, language_sets, asset_manifest, asset_tally, assets_rewritten, indented_parents, code_missing, known_pages, retained_pages, sorted_keys, outlines_in_order,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_LAST = table_queries._LEDGER
_ASSETS = """f AS (SELECT '/i/' || c_custkey AS url, c_mktsegment || (c_nationkey % 3) AS content FROM customer),
r AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN 'image' ELSE 'file' END AS kind, '/i/' || o_custkey AS url FROM orders)"""
ORACLES = {
    "effective_exclusions": f"WITH {_LAST} SELECT page_id, node_id FROM last WHERE kind = 'excluded'",
    "disposition_counts": f"WITH {_LAST} SELECT kind, count(*) AS n FROM last GROUP BY kind",
    "blocks_without_exclusions": """
      WITH RECURSIVE b AS (SELECT page_id, unnest(range(15)) AS node_id FROM pages),
      up AS (SELECT page_id, node_id, node_id AS above FROM b UNION ALL SELECT page_id, node_id, (above - 1) // 2 FROM up WHERE above > 0)
      SELECT page_id, node_id FROM up GROUP BY ALL HAVING NOT bool_or((page_id * 3 + above) % 11 = 0)""",
    "findings_not_waived": """
      WITH a(gate, route, part) AS (VALUES ('click', '/u3', '"k"'), ('view', '/u4', '"k": 7'), ('error', '/u5', 'never there'), ('purchase', '/u6', ''))
      SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM a WHERE gate = event_type AND route = '/u' || (user_id % 20) AND position(part IN props) > 0)""",
    "decision_gaps": "SELECT o_orderstatus AS tier, o_orderpriority AS rule, count(*) AS n, count(DISTINCT o_custkey) AS n_pages FROM orders GROUP BY 1, 2",
    "unreviewed_decisions": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1",
    "unplaced_pages": "SELECT c_custkey AS page_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')",
    "search_canary": """
      WITH s AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS phrase, CASE WHEN doc_id = 2 THEN 0 ELSE doc_id END AS page FROM documents WHERE length(text) > 40 ORDER BY doc_id LIMIT 5),
      h AS (SELECT coalesce(contains(d.text, s.phrase), false) AS ok FROM s LEFT JOIN (SELECT * FROM documents WHERE length(text) > 40) d ON d.doc_id = s.page)
      SELECT count(*) AS n_checked, count(*) FILTER (NOT ok) AS n_failed, count(*) > 0 AND count(*) FILTER (NOT ok) = 0 AS passed FROM h""",
    "shadowed_redirects": """SELECT '/g' || (o_custkey % 10) || '/p' || o_orderkey AS source, '/g' || (o_custkey % 10) || '/*' AS by FROM orders
      WHERE o_custkey % 10 = 4 OR (o_custkey % 10 = 3 AND o_orderkey % 2 = 1)""",
    "label_shortfalls": """SELECT p_brand AS label, count(*) - count(DISTINCT p_type || '-' || (p_partkey % 3)) AS missing FROM part GROUP BY 1 HAVING count(*) > count(DISTINCT p_type || '-' || (p_partkey % 3))""",
    "condition_tags": """
      WITH t AS (SELECT event_id, event_id % 7 > 0 AND event_id % 2 = 0 AS a, event_id % 7 > 0 AND (event_id % 3 = 0 OR event_id % 5 = 0) AS b FROM events)
      SELECT event_id, CASE WHEN a AND b THEN 'ambiguous' WHEN b THEN 'dropped' ELSE 'kept' END AS kept FROM t""",
    "section_tabs": """
      WITH s AS (SELECT CASE WHEN n_regionkey = 2 THEN '/' ELSE '/r' || n_regionkey END AS path, min_by(n_name, n_nationkey) AS label, min(n_nationkey) AS ord FROM nation GROUP BY 1)
      SELECT path, label, (row_number() OVER (ORDER BY path <> '/', ord, path) - 1)::INT AS place FROM s""",
    "published_pages": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'draft' WHEN c_acctbal < 0 THEN 'unlisted' WHEN c_custkey % 3 = 0 AND c_nationkey > 20 THEN 'hidden' END AS withheld FROM customer",
    "pages_of_links": "SELECT o_orderkey AS node_id, c_custkey AS page_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 1 AND c_custkey % 4 <> 0",
    "sidebars_observed": """
      WITH e AS (SELECT l_suppkey AS sidebar, l_partkey AS url, count(*) AS times FROM lineitem GROUP BY 1, 2)
      SELECT sidebar, count(*) AS n_placed, bool_or(times >= 2) AS observed, count(*) >= 2 AND count(*) >= 0.02 * (SELECT count(*) FROM part) AS is_navigation FROM e GROUP BY 1""",
    "language_sets": "SELECT source, string_agg(lang, ',' ORDER BY lang <> 'en', lang) AS values FROM (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL) GROUP BY source",
    "asset_manifest": f"""WITH {_ASSETS} SELECT sha256(content) AS hash, min(length(content)) AS bytes, count(DISTINCT f.url) AS n_urls, min(f.url) AS first_url, count(DISTINCT page_id) AS n_pages
      FROM f LEFT JOIN r ON f.url = r.url GROUP BY content""",
    "asset_tally": f"WITH {_ASSETS} SELECT kind, count(*) AS n FROM r GROUP BY kind",
    "assets_rewritten": f"""WITH {_ASSETS}, s AS (SELECT kind, url, CASE WHEN f.url IS NULL THEN 'unhosted' WHEN url LIKE '%21' OR url LIKE '%5' THEN 'excluded' WHEN url LIKE '%7' OR url LIKE '%1' THEN 'hosted' ELSE 'unhosted' END AS status
        FROM r LEFT JOIN f USING (url))
      SELECT kind, status, count(*) AS n, min(CASE WHEN status = 'hosted' THEN 'https://cdn.example' || url END) AS first_final FROM s GROUP BY 1, 2""",
    "indented_parents": """
      WITH l AS (SELECT page_id, line, (page_id * 7 + line * line * 5) % 9 AS indent FROM (SELECT page_id, unnest(range(40)) AS line FROM pages))
      SELECT a.page_id, a.line, a.indent, max(b.line) AS parent FROM l a LEFT JOIN l b ON a.page_id = b.page_id AND b.line < a.line AND b.indent < a.indent GROUP BY ALL""",
    "code_missing": """
      SELECT DISTINCT p_partkey // 4 AS page_id, sha256(p_type) AS code_hash FROM part p WHERE NOT EXISTS (
        SELECT 1 FROM part q WHERE q.p_partkey // 4 = p.p_partkey // 4 AND q.p_type = p.p_type AND q.p_brand <> 'Brand#1' AND q.p_brand NOT LIKE '%3')""",
    "known_pages": """
      WITH k AS (SELECT '/' || c_custkey AS route, 'manifest' AS side FROM customer WHERE c_custkey % 2 = 0 UNION SELECT '/' || c_custkey, 'tree' FROM customer WHERE c_custkey % 3 = 0
        UNION SELECT '/' || o_custkey, 'sitemap' FROM orders WHERE o_orderstatus = 'P')
      SELECT route, string_agg(side, ',' ORDER BY side) AS known_by FROM k GROUP BY route""",
    "retained_pages": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "sorted_keys": """SELECT event_id, '{"a":"' || user_id || '","m":"1","z":"' || event_type || '"}' AS document FROM events""",
    "outlines_in_order": r"""
      WITH RECURSIVE w AS (SELECT doc_id, string_split(split_part(coalesce(text, ''), chr(10), 1), ' ') AS s FROM documents),
      t AS (SELECT doc_id, s, list_filter(s, lambda x, i: (i - 1) % 3 = 0) AS k FROM w),
      u AS (SELECT doc_id, s, CASE WHEN doc_id % 2 = 0 THEN k ELSE list_reverse(k) END AS k FROM t),
      walk AS (SELECT doc_id, s, k, 1 AS n, 0::BIGINT AS reached FROM u
        UNION ALL SELECT doc_id, s, k, n + 1, reached + list_position(s[reached + 1:], k[n]) FROM walk WHERE n <= len(k) AND list_position(s[reached + 1:], k[n]) > 0)
      SELECT doc_id, max(n) > max(len(k)) AS in_order FROM walk GROUP BY doc_id""",
}

#: Gates and the registered queries whose rows are their findings.
GATES = {
    "prose-match": (corpus_queries, "prose_missing"),
    "internal-links": (page_queries, "internal_links_broken"),
    "unmigrated-links": (page_queries, "unmigrated_links"),
    "navigation-valid": (structure_queries, "navigation_problems"),
    "navigation-exact": (structure_queries, "navigation_differences"),
    "block-dispositions": (table_queries, "nodes_without_disposition"),
    "exclusions-attributed": (table_queries, "exclusions_attributed"),
    "pages-accounted": (table_queries, "pages_accounted"),
    "redirects-clean": (table_queries, "redirect_loops"),
    "redirect-targets": (table_queries, "redirect_missing_targets"),
    "tables": (table_queries, "multiset_except"),
    "sources-pinned": (page_queries, "drift_report"),
}


def _gate(name, module, query):
    return lambda spark, d: gates.gate(name, module.QUERIES[query](spark, d))


for _name, (_module, _query) in GATES.items():
    if _query in _module.QUERIES and _query in _module.ORACLES:
        _key = "gate_" + _name.replace("-", "_")
        QUERIES[_key] = _gate(_name, _module, _query)
        ORACLES[_key] = f"SELECT '{_name}' AS gate, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS count FROM ({_module.ORACLES[_query]})"


def gates_against_themselves(spark, d):
    """Gates that compare a table with itself, so each passes, and the decision over them with one waived."""
    e = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.sha2("o_orderpriority", 256).alias("code_hash"))
    found = {"tables": reconcile.multiset_except(e, e), "code-blocks": passages.missing_code(o, o), "pages-accounted": reconcile.accounted(o, o), "redirects-clean": redirects.loops(table_queries._edges(spark, d))}
    rolled = gates.rollup(spark, found, [*found, "internal-links"])
    return gates.released(rolled, spark.createDataFrame([("internal-links",)], "gate string"))


QUERIES["gates_against_themselves"] = gates_against_themselves
ORACLES["gates_against_themselves"] = f"WITH {table_queries._EDGES}, {table_queries._REACH} SELECT count(*) = 0 AS released, CASE WHEN count(*) > 0 THEN 'redirects-clean' ELSE '' END AS blockers FROM reach"
