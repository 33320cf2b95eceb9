import duckdb
from pyspark.sql import functions as F

from foliograph.llm import mixing
from tests.llm.helpers import ODD, check_stage_keeps_columns, docs, prose, saved, with_clashes


def targets(sizes):
    """Shares by weight with the excess dealt again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else got[s] for s in names}
        full |= over


def test_targets(spark):
    sizes = {"b": 1000, "a": 10, "c": 500, None: 300, "z": 7}
    frame = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_against_rules(spark, tmp_path):
    rows = [(i, prose(i, 20 + i % 300), None if i % 7 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(500)]
    folder = saved(spark, tmp_path, rows)
    got = mixing.op6_mixing(spark, folder).collect()
    assert len(got) == 500
    again = {r["doc_id"]: r["taken"] for r in mixing.op6_mixing(spark, folder).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    sizes, taken = {}, {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 2 * mixing.BLOCK
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert {r[0]: r[4] for r in con.sql(mixing.ORACLE).fetchall()} == again


def test_odd_rows(spark):
    rows = docs(spark, [*ODD, (7, "b c d", "other"), (7, "b c d", "other")])
    got = mixing.mix_documents(with_clashes(rows)).collect()
    assert len(got) == rows.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    assert mixing.mix_documents(docs(spark, [(1, None), (2, "  ")])).select(F.sum("taken")).first()[0] == 0


def test_mixed_texts_hold_what_is_taken(spark, tmp_path):
    rows = docs(spark, [(i, prose(i, 10 + i % 200), f"s{i % 4}") for i in range(200)] + [(900, prose(1, 150), "s1"), (900, prose(1, 150), "s1"), (None, prose(2, 90), None)])
    texts = mixing.mixed_texts(with_clashes(rows))
    assert texts.columns == with_clashes(rows).columns
    texts = texts.select(rows.columns)
    sums = lambda frame, c: {r[0]: r[1] for r in frame.groupBy("doc_id").agg(F.sum(c)).collect() if r[1]}
    words = sums(texts.withColumn("n", F.size(F.split("text", r"\s+")).cast("long")), "n")
    assert words == sums(mixing.mix_documents(rows), "taken")


def test_columns_of_any_name_stay(spark):
    check_stage_keeps_columns(mixing.mixed_texts, docs(spark, [(i, prose(i, 40), f"s{i % 3}") for i in range(30)] + [(7, prose(7, 40), "s1")] * 2 + [(None, None, None)]))
