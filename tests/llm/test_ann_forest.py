import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import ann_forest as ann


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def best(vectors, ids, q, k=20):
    scores = [(-float(np.dot(v, vectors[q])), i) for v, i in zip(vectors, ids, strict=True) if i != ids[q]]
    return sorted(scores)[:k]


def test_forest_finds_prefix_matches():
    v = np.random.default_rng(0).normal(size=(500, 16))
    forest = ann.Forest(v, 10.0, trees=4, bits=16)
    low, high = forest.matches(v[:20], 40)
    for q in range(20):
        assert (high[:, q] - low[:, q]).sum() >= 40
    assert all((np.diff(s.astype(np.int64)) >= 0).all() for s in forest.sorted)


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(3000, 32)) * rng.uniform(0.2, 2, size=(3000, 1))).astype(np.float32).astype(np.float64)
    got = {}
    for r in ann.search(table(spark, v), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 3000, 20):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(s - float((v[i] * v[q]).sum())) < 1e-12 for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        hits.append(len({i for _, i, _ in rows} & {i for _, i in best(v, range(3000), q)}))
    assert np.mean(hits) / 20 >= 0.9


def test_ties_odd_vectors_and_few_rows(spark):
    v = [[1.0, 0.0]] * 30 + [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = table(spark, v).union(spark.createDataFrame([(None, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(rows.withColumn("dims", F.lit(1)), F.col("vec_id") % 20 == 0).collect())
    want = [(q, k + 1, i) for q in (0, 20) for k, i in enumerate([i for i in range(30) if i != q][:20])]
    assert got == want
    assert ann.search(rows.limit(0), F.lit(True)).count() == 0
    assert ann.search(rows.filter("vec_id = 35"), F.lit(True)).count() == 0


def test_vectors_of_any_size(spark):
    """Very large, very small and cancelling vectors get exact ranks; all rows are candidates here."""
    rng = np.random.default_rng(8)
    for scale in (1e25, 1.0, 1e-25, 3e37):
        v = (rng.normal(size=(300, 16)) * scale * rng.uniform(0.01, 1, size=(300, 1))).astype(np.float32).astype(np.float64)
        v[:150] = v[0] + v[:150] * 1e-4  # nearly equal vectors
        v[150:200, 8:] = -v[150:200, :8]  # cancel against a query whose halves are equal
        v[20, 8:] = v[20, :8]
        v = v.astype(np.float32).astype(np.float64)
        got = {}
        for r in ann.search(table(spark, v), F.col("vec_id") % 20 == 0, wanted=64.0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert len(got) == 15
        for q, rows in got.items():
            scores = (v * v[q]).sum(axis=1)
            want = sorted((-scores[i], i) for i in range(300) if i != q)[:20]
            assert [(i, s) for _, i, s in sorted(rows)] == [(i, -s) for s, i in want], (scale, q)
