"""Queries over the tables of events and orders, which stand in for ledgers, manifests and navigation of a migrated site."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import ledger as lg
from foliograph.operators import reconcile, redirects, sites
from foliograph.workspace import table


def _ledger(spark, d):
    """Events as a ledger: users are pages, hundreds of a property are nodes, event types are dispositions."""
    kinds = F.create_map(*[F.lit(x) for p in (("click", "identical"), ("view", "transformed"), ("purchase", "excluded"), ("error", "quarantined"), ("signup", "excluded")) for x in p])
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("page_id"), (F.col("event_id") % 7).alias("node_id"), kinds[F.col("event_type")].alias("kind"), F.when(F.col("value") > 20, F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string"))).alias("reviewer"))


_LEDGER = """ledger AS (SELECT event_id AS seq, user_id AS page_id, event_id % 7 AS node_id,
  CASE event_type WHEN 'click' THEN 'identical' WHEN 'view' THEN 'transformed' WHEN 'error' THEN 'quarantined' ELSE 'excluded' END AS kind,
  CASE WHEN value > 20 THEN 'r' || (event_id % 5) END AS reviewer FROM events),
last AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY page_id, node_id ORDER BY seq DESC, kind DESC) = 1)"""


def ledger_last_wins(spark, d):
    return lg.last(_ledger(spark, d)).select("page_id", "node_id", "seq", "kind", "reviewer")


def _nodes(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("page_id")).distinct()
    return u.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("node_id"))


def ledger_coverage(spark, d):
    return lg.coverage(_nodes(spark, d), _ledger(spark, d))


def nodes_without_disposition(spark, d):
    return lg.missing(_nodes(spark, d), _ledger(spark, d))


def exclusions_attributed(spark, d):
    return lg.unattributed_exclusions(_ledger(spark, d))


def universe_account(spark, d):
    """Customers as the manifest, those with orders as written; segments, balances and keys decide the rest."""
    c = table(spark, d, "customer")
    manifest = c.filter("c_custkey % 17 <> 5").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").cast("string").alias("source_id"), (F.col("c_acctbal") > 0).alias("published"))
    tree = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("page_id"), (F.col("c_mktsegment") != "BUILDING").alias("migrate"))
    excluded = c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(-1).cast("string").alias("source_id"))
    written = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("page_id"))
    held = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("page_id"))
    return reconcile.universe(manifest, tree, excluded, written, held).groupBy("outcome").agg(F.count("*").alias("n"))


def pages_accounted(spark, d):
    o = table(spark, d, "orders")
    scoped = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("page_id"))
    return reconcile.accounted(scoped, side("F"), side("P"))


def multiset_except(spark, d):
    """Line items' (return flag, supplier, quantity) of odd orders beyond those of even orders."""
    li = table(spark, d, "lineitem")
    keys = ["l_returnflag", "l_suppkey", "l_quantity"]
    return reconcile.multiset_except(li.filter("l_orderkey % 2 = 1").select(*keys), li.filter("l_orderkey % 2 = 0").select(*keys)).select(*keys, F.col("missing").cast("long").alias("missing"))


def _nodes_of(spark, d):
    """Regions, nations and suppliers as a navigation tree."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("ord"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") < 5, F.concat(F.lit("REGION_"), "n_regionkey")).otherwise(F.col("n_name")), F.col("n_nationkey").cast("long"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_name"), F.col("s_suppkey").cast("long"))
    return r.union(n).union(s)


_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, r_name AS label, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey < 5 THEN 'REGION_' || n_regionkey ELSE n_name END, n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, s_suppkey FROM supplier)"""


def nav_paths(spark, d):
    return sites.nav_paths(_nodes_of(spark, d)).select("node_id", "path", F.col("depth").cast("long").alias("depth"))


def nav_rollup(spark, d):
    """How many nodes lie beneath each node: every node counts for all prefixes of its path."""
    p = sites.nav_paths(_nodes_of(spark, d))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return p.select(F.explode(above).alias("path")).groupBy("path").agg((F.count("*") - 1).alias("n_beneath"))


def landing_pages(spark, d):
    return sites.landing_children(_nodes_of(spark, d))


def _edges(spark, d):
    """Orders as redirect rules, one for each order key, so the rules grow with the table; they lead back and forth and run into loops."""
    to = F.abs(F.col("o_orderkey") - F.col("o_custkey") * 7)
    return table(spark, d, "orders").select(F.concat(F.lit("/r"), "o_orderkey").alias("source"), F.concat(F.lit("/r"), to).alias("destination")).filter("source <> destination").groupBy("source").agg(F.min("destination").alias("destination"))


_EDGES = """edges AS (SELECT source, min(destination) AS destination FROM (
  SELECT '/r' || o_orderkey AS source, '/r' || abs(o_orderkey - o_custkey * 7) AS destination FROM orders) WHERE source <> destination GROUP BY source)"""


def redirect_chains(spark, d):
    return redirects.chains(_edges(spark, d))


def redirect_loops(spark, d):
    return redirects.loops(_edges(spark, d))


def redirect_missing_targets(spark, d):
    routes = table(spark, d, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("route"))
    return redirects.missing_targets(_edges(spark, d), routes)


def alias_closure(spark, d):
    """Chains of aliases that never turn back: every order key stands for its third."""
    e = table(spark, d, "orders").filter("o_orderkey > 0").select(F.col("o_orderkey").alias("alias"), F.floor(F.col("o_orderkey") / 3).cast("long").alias("target"))
    return redirects.aliases_closed(e)


def signature_clusters(spark, d):
    c = table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.from_json("props", "map<string,string>").alias("props"))
    return sites.clusters(sites.signatures(c), "event_id").select("signature", "name", "count", "samples")


def first_last_event(spark, d):
    """First event of each user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return reconcile.first_of_each(e, ["user_id", "event_type"], ["event_id"])


def gate_rollup(spark, d):
    """Gates over the stand-in ledger: a gate fails if it finds anything; missing evidence would fail too."""
    from foliograph.plans import gates

    found = {"block-dispositions": nodes_without_disposition(spark, d), "exclusions-attributed": exclusions_attributed(spark, d), "pages-accounted": pages_accounted(spark, d), "redirects-clean": redirect_loops(spark, d)}
    required = ["block-dispositions", "exclusions-attributed", "pages-accounted", "redirects-clean", "internal-links"]
    return gates.rollup(spark, found, required)


QUERIES = {f.__name__: f for f in (
    ledger_last_wins, ledger_coverage, nodes_without_disposition, exclusions_attributed, universe_account, pages_accounted, multiset_except, nav_paths, nav_rollup, landing_pages, redirect_chains,
    redirect_loops, redirect_missing_targets, alias_closure, signature_clusters, first_last_event, gate_rollup)}

_REACH = """reach AS (
  WITH RECURSIVE walk(start, cur) AS (SELECT source, destination FROM edges UNION SELECT w.start, e.destination FROM walk w JOIN edges e ON e.source = w.cur WHERE w.cur <> w.start)
  SELECT DISTINCT start FROM walk WHERE start = cur)"""
ORACLES = {
    "ledger_last_wins": f"WITH {_LEDGER} SELECT page_id, node_id, seq, kind, reviewer FROM last",
    "ledger_coverage": f"""WITH {_LEDGER}, nodes AS (SELECT page_id, unnest(range(10)) AS node_id FROM (SELECT DISTINCT user_id AS page_id FROM events)),
      b AS (SELECT n.page_id, n.node_id, l.kind, l.reviewer FROM nodes n LEFT JOIN last l ON n.page_id = l.page_id AND n.node_id = l.node_id)
      SELECT count(*) AS total, count(*) FILTER (kind = 'identical') AS identical, count(*) FILTER (kind = 'transformed') AS transformed, count(*) FILTER (kind = 'excluded') AS excluded,
        count(*) FILTER (kind = 'excluded' AND reviewer IS NULL) AS unattributed, count(*) FILTER (kind = 'quarantined') AS quarantined, count(*) FILTER (kind IS NULL) AS missing FROM b""",
    "nodes_without_disposition": f"WITH {_LEDGER}, nodes AS (SELECT page_id, unnest(range(10)) AS node_id FROM (SELECT DISTINCT user_id AS page_id FROM events)) SELECT page_id, node_id FROM nodes EXCEPT SELECT page_id, node_id FROM ledger",
    "exclusions_attributed": f"WITH {_LEDGER} SELECT page_id, node_id, seq FROM last WHERE kind = 'excluded' AND coalesce(reviewer, '') = ''",
    "universe_account": """
      WITH m AS (SELECT c_custkey AS page_id, c_nationkey::VARCHAR AS source_id, c_acctbal > 0 AS published FROM customer WHERE c_custkey % 17 <> 5),
      t AS (SELECT c_custkey AS page_id, c_mktsegment <> 'BUILDING' AS migrate FROM customer WHERE c_custkey % 5 <> 0),
      e AS (SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE -1 END::VARCHAR AS excluded_as FROM customer WHERE c_custkey % 7 = 0),
      w AS (SELECT DISTINCT o_custkey AS page_id FROM orders WHERE o_orderstatus = 'O'), q AS (SELECT DISTINCT o_custkey AS page_id FROM orders WHERE o_orderstatus = 'P'),
      k AS (SELECT page_id FROM m UNION SELECT page_id FROM t UNION SELECT page_id FROM e UNION SELECT page_id FROM w UNION SELECT page_id FROM q)
      SELECT CASE WHEN m.page_id IS NULL AND t.page_id IS NOT NULL THEN 'not-in-source' WHEN m.page_id IS NULL AND e.page_id IS NOT NULL THEN 'excluded-unknown' WHEN m.page_id IS NULL THEN 'output-without-page'
        WHEN t.migrate AND e.page_id IS NOT NULL THEN 'stale-exclusion' WHEN t.migrate AND w.page_id IS NOT NULL THEN 'migrated' WHEN t.migrate AND q.page_id IS NOT NULL THEN 'quarantined' WHEN t.migrate THEN 'unwritten'
        WHEN e.page_id IS NOT NULL AND e.excluded_as = m.source_id THEN 'excluded' WHEN e.page_id IS NOT NULL THEN 'mismatched-exclusion' WHEN m.published THEN 'undecided' ELSE 'unpublished' END AS outcome, count(*) AS n
      FROM k LEFT JOIN m USING (page_id) LEFT JOIN t USING (page_id) LEFT JOIN e USING (page_id) LEFT JOIN w USING (page_id) LEFT JOIN q USING (page_id) GROUP BY 1""",
    "pages_accounted": "SELECT c_custkey AS page_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))",
    "multiset_except": """SELECT l_returnflag, l_suppkey, l_quantity, count(*) AS missing FROM (
      SELECT l_returnflag, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 1 EXCEPT ALL SELECT l_returnflag, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY ALL""",
    "nav_paths": f"""WITH RECURSIVE {_NODES}, p AS (SELECT node_id, label AS path, 0::BIGINT AS depth FROM nodes WHERE parent_id IS NULL
      UNION ALL SELECT n.node_id, p.path || '/' || n.label, p.depth + 1 FROM nodes n JOIN p ON n.parent_id = p.node_id) SELECT node_id, path, depth FROM p""",
    "nav_rollup": f"""WITH RECURSIVE {_NODES}, p AS (SELECT node_id, label AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, p.path || '/' || n.label FROM nodes n JOIN p ON n.parent_id = p.node_id),
      k AS (SELECT DISTINCT path FROM p) SELECT k.path, count(*) - 1 AS n_beneath FROM k JOIN p ON p.path = k.path OR starts_with(p.path, k.path || '/') GROUP BY 1""",
    "landing_pages": f"""WITH {_NODES}, f AS (SELECT parent_id, node_id, label FROM nodes WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) = 1)
      SELECT f.parent_id, f.node_id FROM f JOIN nodes n ON n.node_id = f.parent_id WHERE lower(n.label) = lower(f.label)""",
    "redirect_chains": f"WITH {_EDGES} SELECT a.source, a.destination AS via, b.destination FROM edges a JOIN edges b ON a.destination = b.source WHERE b.destination <> a.destination",
    "redirect_loops": f"WITH {_EDGES}, {_REACH} SELECT start AS source FROM reach",
    "redirect_missing_targets": f"WITH {_EDGES} SELECT source, destination FROM edges WHERE destination NOT IN (SELECT source FROM edges) AND destination NOT IN (SELECT '/r' || c_custkey FROM customer)",
    "alias_closure": """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS alias, o_orderkey // 3 AS target FROM orders WHERE o_orderkey > 0),
      w AS (SELECT alias, target FROM e UNION SELECT w.alias, e.target FROM w JOIN e ON e.alias = w.target)
      SELECT alias, min(target) AS canonical FROM w GROUP BY alias""",
    "signature_clusters": """
      WITH c AS (SELECT event_id, event_type AS name, (SELECT string_agg(k || '=' || CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean'
          WHEN regexp_matches(v, '^(https?:)?//|^/') THEN 'url' WHEN length(v) <= 40 THEN 'string:short' ELSE 'string:long' END, ',' ORDER BY k)
          FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v)) AS kinds FROM events),
      s AS (SELECT *, substr(sha256(name || '|' || kinds), 1, 12) AS signature FROM c)
      SELECT signature, min(name) AS name, count(*) AS count, array_to_string(list_sort(list(event_id))[1:5], ',') AS samples FROM s GROUP BY signature""",
    "first_last_event": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
}
ORACLES["signature_clusters"] = ORACLES["signature_clusters"].replace("\\\\.", "\\.")
ORACLES["gate_rollup"] = f"""
WITH {_LEDGER}, {_EDGES}, {_REACH}, nodes AS (SELECT page_id, unnest(range(10)) AS node_id FROM (SELECT DISTINCT user_id AS page_id FROM events)),
found AS (
  SELECT 'block-dispositions' AS gate, count(*) AS n FROM (SELECT page_id, node_id FROM nodes EXCEPT SELECT page_id, node_id FROM ledger)
  UNION ALL SELECT 'exclusions-attributed', count(*) FROM last WHERE kind = 'excluded' AND coalesce(reviewer, '') = ''
  UNION ALL SELECT 'pages-accounted', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))
  UNION ALL SELECT 'redirects-clean', count(*) FROM reach)
SELECT gate, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS count FROM found UNION ALL SELECT 'internal-links', 'fail', NULL"""
