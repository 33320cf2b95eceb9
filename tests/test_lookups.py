"""What many rows share is looked up where they are."""

from foliograph import workspace
from foliograph.operators import conversion, lookups, rules, specs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def components(spark):
    c = spark.range(400).selectExpr("CAST(id AS string) AS page_id", "id AS node_id", "'web' AS platform", "if(id % 8 = 0, NULL, 'Note') AS name", "map('k', CAST(id % 3 AS string)) AS props", "array('big') AS style_deps")
    return c.selectExpr("*", "CAST(array() AS array<string>) AS expressions", "if(node_id % 5 = 0, NULL, 's:Note') AS signature")


def test_components_stay_where_they_are_while_rules_are_matched(spark):
    table = [("*", 1, "Note", None, {}, "Last", {}, "keep", []), ("*", 0, "Note", None, {"k": "1"}, "One", {}, "keep", []), ("web", 9, "Note", "big", {"k": "2"}, "Own", {}, "keep", [])]
    found = rules.matched(components(spark), spark.createDataFrame(table, rules.RULES))
    got = {r["node_id"]: r["rule"] and r["rule"]["r_to_name"] for r in found.collect()}
    assert got == {i: None if i % 8 == 0 else ("Last", "One", "Own")[i % 3] for i in range(400)}
    assert "hashpartitioning(page_id" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)


def test_components_stay_where_they_are_while_they_are_decided(spark):
    table = spark.createDataFrame([("r", "*", 1, "Note", None, {}, "Callout", {}, None, [], [], None)], conversion.RULES)
    plan = spark.createDataFrame([("s:Note", "excluded", "not ours", None)], conversion.PLAN)
    found = conversion.decided(components(spark).withColumnRenamed("node_id", "node"), table, plan)
    got = {r["node"]: (r["act"], r["reason"]) for r in found.select("node", "act", "reason").collect()}
    assert got == {i: ("drop", "not ours") if i % 5 else ("preserve", None) if i % 8 == 0 else ("to", None) for i in range(400)}
    assert "hashpartitioning(signature" not in plan_of(found).split("HashAggregate")[0] and "SortMergeJoin" not in plan_of(found)


def test_hot_keys_and_missing_keys(spark):
    many = spark.range(6_000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN id ELSE 2 END AS key")
    known = spark.createDataFrame([(2, "two"), (5, "five"), (7, "seven")], "key long, what string")
    for look in (lookups.by_hot_keys, lookups.looked_up):
        got = {(r["key"], r["what"]): r["count"] for r in look(many, known, "key").groupBy("key", "what").count().collect()}
        assert got[2, "two"] == 3_000 and got[5, "five"] == 1 and got[None, None] == 1_500 and sum(got.values()) == 6_000


def test_large_levels_of_a_closure_are_not_sent_through_the_driver(spark, monkeypatch):
    """What is broadcast has a bound in rows: files may be far smaller than what they hold."""
    plans = []

    def written(df, *more, **how):
        plans.append(plan_of(df))
        return workspace.written(df, *more, **how)

    monkeypatch.setattr(specs, "written", written)
    edges = spark.range(70_000).selectExpr("id * 2 AS document", "id * 2 + 1 AS target")
    got = specs.closure(edges, edges.select("document"))
    assert [tuple(r) for r in got.groupBy("depth").count().orderBy("depth").collect()] == [(0, 70_000), (1, 70_000)]
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)
    plans.clear()
    few = edges.filter("document < 100")
    assert specs.closure(edges, few.select("document")).count() == 100 and any("Broadcast" in p for p in plans)
