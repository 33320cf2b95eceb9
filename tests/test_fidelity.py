"""Declared losses, snapshots, running order, contract and plans on small rows, with nulls, ties and empty tables."""

import random

from pyspark.sql import functions as F

from foliograph.functions import urls
from foliograph.operators import fidelity, routing

BLOCKS = "page_id long, seq int, path array<int>, name string, kind string, text string, props map<string,string>"
RULES = "name string, action string, dropped array<string>"


def scan(segments, rendered):
    cursor, in_order, moved, absent, residual = 0, 0, 0, 0, len(rendered)
    for s in segments:
        at = rendered.find(s, cursor)
        if at >= 0:
            cursor, in_order, residual = at + len(s), in_order + 1, residual - len(s)
        elif s in rendered:
            moved += 1
        else:
            absent += 1
    return in_order, moved, absent, residual


def test_running_order_against_a_plain_scan(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        words = [rng.choice(["one", "two", "three", "on", "thr"]) for _ in range(rng.randint(0, 12))]
        shown = words[:] if k % 3 else rng.sample(words, len(words))
        rows.append((k, words, " ".join(shown[: len(shown) - k % 2])))
    df = spark.createDataFrame(rows, "k int, segments array<string>, rendered string")
    got = {r["k"]: tuple(r["o"]) for r in df.select("k", fidelity.running_order(F.col("segments"), F.col("rendered")).alias("o")).collect()}
    assert got == {k: scan(s, t) for k, s, t in rows}
    none = spark.createDataFrame([(None, "abc")], "segments array<string>, rendered string")
    assert tuple(none.select(fidelity.running_order(F.col("segments"), F.col("rendered")).alias("o")).first()["o"]) == (0, 0, 0, 3)


def test_running_order_searches_on_from_the_last_hit(spark):
    """No fold that counts characters from the text's beginning for every segment; empty and null segments as stated."""
    rows = [(0, ["é𝄞", "b"], "aé𝄞bb"), (1, ["a", "", "a"], "ab"), (2, ["a", None], "ab"), (3, ["a"], None), (4, [], None), (5, ["b", "a", "z"], "ab")]
    df = spark.createDataFrame(rows, "k int, segments array<string>, rendered string")
    got = df.select("k", fidelity.running_order(F.col("segments"), F.col("rendered")).alias("o"))
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(2, 0, 0, 2), (3, 0, 0, 0), (None, None, None, 1), (None, None, None, None), (0, 0, 0, None), (1, 1, 1, 1)]
    assert [tuple(r["o"]) for r in got.orderBy("k").collect()] == want


def test_losses_and_first_difference(spark):
    rows = [
        (1, 0, [0], "Frame", "component", None, {"icon": "a"}),
        (1, 1, [0, 0], None, "paragraph", "it’s  here", None),
        (1, 2, [1], "Ask", "component", "", {}),
        (1, 3, [1, 0], None, "paragraph", "chrome", {}),
        (1, 4, [2], "Note", "component", "n", {"icon": "x", "width": "3", "tone": None}),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    rules = spark.createDataFrame([("Frame", "unwrap", None), ("Ask", "drop", None), ("Note", "keep", ["icon"])], RULES)
    kept = fidelity.declared_losses(blocks, rules)
    assert sorted((r["seq"], r["depth"], r["props"]) for r in kept.collect()) == [(1, 1, None), (4, 1, {"width": "3", "tone": None})]
    shot = fidelity.snapshot(kept)
    assert sorted((r["place"], r["field"], r["value"]) for r in shot.collect()) == [(0, "kind", "paragraph"), (0, "text", "it's here"), (1, "kind", "component"), (1, "text", "n")]
    assert fidelity.first_differences(shot, shot).count() == 0
    other = fidelity.snapshot(kept.filter("seq = 4"))
    assert [tuple(r) for r in fidelity.first_differences(shot, other).collect()] == [(1, 0, "kind", "paragraph", "component")]
    none = blocks.limit(0)
    assert fidelity.declared_losses(none, rules).count() == 0 and fidelity.first_differences(fidelity.snapshot(none), fidelity.snapshot(none)).count() == 0


def test_places_and_steps(spark):
    containers = spark.createDataFrame([("ai", f"docs/ai/{k}") for k in range(6)] + [("en", "docs/a"), ("en", "docs/ai/z"), ("one", "solo")], "container string, route string")
    pages = spark.createDataFrame([(1, "docs/ai/new"), (2, "docs/x/y/z"), (3, "elsewhere"), (4, "solo/below"), (5, None)], "page_id long, route string")
    got = {r["page_id"]: (r["container"], r["placed_by"]) for r in routing.placed_by_route(pages, containers).collect()}
    assert got == {1: ("ai", "folder"), 2: ("en", "prefix"), 3: (None, None), 4: ("one", "prefix"), 5: (None, None)}
    before = spark.range(100).selectExpr("lpad(cast(id as string), 3, '0') AS path")
    after = before.filter("path < '010'")
    steps = routing.navigation_steps(before, after, 0.3, 20).groupBy("step").count().collect()
    left = 100
    for n in [r["count"] for r in sorted(steps)]:
        assert n <= max(1, int(left * 0.3)) or left < 20
        left -= n
    assert left == 10
    assert {r["step"] for r in routing.navigation_steps(before, before.filter("path > '004'"), 0.3, 20).collect()} == {1}


def test_null_addresses(spark):
    df = spark.createDataFrame([(None,)], "x string")
    x = F.col("x")
    assert list(df.select(urls.decoded_path(x), urls.unproxied(x), urls.on_seed(x, "https://a.example", ["b"]), urls.markdown_problem(F.lit(200), F.lit("text/plain"), x)).first()) == [None, None, None, "empty"]
