import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import toxicity
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes

BAD = ["idiotic", "worthless", "pathetic", "disgusting"]


def corpus(n, start=0):
    rng, rows, labels = random.Random(5), [], []
    for i in range(start, start + n):
        words = prose(i, rng.randint(20, 120)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark, tmp_path):
    rows, labels = corpus(700)
    rows += [(9000, prose(1, 40) + " idiotik worthlless pathettic"), (9001, prose(2, 60))]
    got = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, saved(spark, tmp_path, rows, labels)).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([p == t for p, t in held]) > 0.9
    assert got[9000]["predicted"] == 1 and got[9001]["predicted"] == 0


def test_score_is_the_softmax_of_the_mean():
    model = toxicity.SubwordModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), 0.25)
    words = ["Straße", "a", "idiot"]
    for w in words:
        grams = [f"<{w}>"[k : k + n] for n in toxicity.NGRAMS for k in range(len(w) + 3 - n)]
        bucket, owner = toxicity.subwords([w])
        assert len(bucket) == len(grams) + 1 and (owner == 0).all()
        assert model.word_logits([w])[0] == pytest.approx(model.logits[bucket].mean(), rel=1e-5)
    together = model.word_logits(words)
    assert [model.word_logits([w])[0] for w in words] == pytest.approx(list(together))


def test_odd_rows(spark):
    rows, labels = corpus(60)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, label int")
    both = docs(spark, [*ODD, *[(i + 100, t) for i, t in rows]])
    got = toxicity.toxic_scores(with_clashes(both), table)
    assert got.count() == both.count() and not got.filter("score IS NULL OR held_out IS NULL").count()
    assert toxicity.toxic_scores(docs(spark, []), table).count() == 0
    assert toxicity.toxic_scores(docs(spark, ODD), table.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    one = toxicity.toxic_scores(docs(spark, ODD), spark.createDataFrame([(4, 0)], "doc_id long, label int"))
    assert one.filter("score >= 0.5").count() == 0 or zlib.crc32(b"4") % 5 == 0


def test_rows_that_stay_keep_their_columns(spark):
    rows, labels = corpus(300)
    frame = docs(spark, rows).withColumn("__score", F.lit("mine"))
    kept = toxicity.without_toxic(frame, spark.createDataFrame(labels, "doc_id long, label int"))
    assert kept.columns == frame.columns
    clean, stay = {i for i, t in labels if not t}, {r["doc_id"] for r in kept.collect()}
    assert len(stay & clean) > 0.97 * len(clean) and len(stay - clean) < 0.1 * (300 - len(clean))


def test_order_conflicts_and_small_samples(spark):
    rows, labels = corpus(120)
    table = spark.createDataFrame(labels, "doc_id long, label int")
    frame = docs(spark, rows)
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(frame, table).collect()}
    turned = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(frame.orderBy(F.desc("doc_id")).repartition(3), table.repartition(5)).collect()}
    assert plain == turned
    # a second label of 0 changes nothing, as 1 counts
    toxic = [(i, 0) for i, t in labels if t]
    both = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(frame, table.union(spark.createDataFrame(toxic, "doc_id long, label int"))).collect()}
    assert both == plain
    assert np.mean([(plain[i] >= 0.5) == t for i, t in labels]) > 0.9


def test_training_halves_the_loss():
    rows, labels = corpus(60)
    texts, y = [t for _, t in rows], np.array([t for _, t in labels])
    loss = lambda m: float(np.mean([-np.log(p if t else 1 - p) for p, t in ((1 / (1 + np.exp(-(m.bias + np.mean(m.word_logits(toxicity.words_of(x)))))), t) for x, t in zip(texts, y, strict=True))]))
    before = loss(toxicity.SubwordModel(np.zeros(toxicity.BUCKETS, np.float32), float(np.log(y.mean() / (1 - y.mean())))))
    assert loss(toxicity.fit(texts, y, np.ones(len(y)))) < 0.5 * before
