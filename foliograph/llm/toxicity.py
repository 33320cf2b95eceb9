"""Toxicity scores from subword-bag embeddings.

Method: a word is the mean of the vectors of its character n-grams (NGRAMS letters,
with word bounds) and of itself, all hashed into BUCKETS rows; a text is the mean of
its words; a linear softmax over that mean gives the score. Vectors and softmax are
trained jointly in numpy by mini-batch Adagrad, so a misspelling never seen shares
most of its n-gram vectors with the word it came from.

The classifier is fitted on a bounded sample of the labelled training rows: up to about
PER_LABEL ids of each label and SAMPLE_CHARS characters, chosen by hash and put in order
of id and text; the loss weighs the labels back to their true shares. The sample's ids are few enough
to broadcast (the sum of PER_LABEL), so texts are never shuffled. Scoring covers every row and
every whole text in one map-side pass; a worker remembers the scores of at most
WORDS_KEPT distinct words.

Defined results: null text is empty; a text without words gets the softmax of the bias
alone; a null doc_id is returned and is not held out; null or other labels are not
learned from; an id with both labels has label 1; without labelled rows, or with one label only, the score is that
label's smoothed share; repeated rows are scored each; an empty table gives an empty
table; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.workspace import bounded_batches

NGRAMS = (3, 4, 5)
BITS = 17
BUCKETS = 1 << BITS
DIMS = 8
#: Rows of label 0 and of label 1 that training sees at most, about.
PER_LABEL = (4000, 2000)
SAMPLE_CHARS = 20_000_000
EPOCHS, BATCH, RATE = 12, 128, 1.5
#: Small samples are gone through until the vectors have had this many updates.
LEAST_UPDATES = 600
#: An n-gram in h texts of the sample weighs h / (h + SHRINK): rare ones, which are easily learned by heart, count for less.
SHRINK = 5.0
WORDS_KEPT = 400_000
FOLDS = 5
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, and to which word each belongs (ascending)."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * _PRIME + codes[n - 1 :]
        if n in NGRAMS:
            same = owner[: len(h)] == owner[n - 1 :]
            found.append((h[same] + np.uint64(n)) * _SPREAD)
            owners.append(owner[: len(h)][same])
    # the whole word: a position-weighted sum, so that anagrams differ
    ends = np.cumsum(lengths)
    place = (np.arange(len(codes)) - np.repeat(ends - lengths, lengths)).astype(np.uint64)
    mixed = (codes + np.uint64(7)) * ((place + np.uint64(1)) * _PRIME + _SPREAD)
    mixed ^= mixed >> np.uint64(31)
    found.append(np.add.reduceat(mixed * _SPREAD, ends - lengths) * _SPREAD if len(words) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(words)))
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    bucket = ((bucket ^ (bucket >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - BITS)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), owner[order]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the runs start .. start+length-1, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class SubwordModel:
    """What scoring needs of embeddings and softmax: each bucket's share of the logit, and the bias."""

    logits: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        bucket, owner = subwords(words)
        n = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, self.logits[bucket], len(words)) / np.maximum(n, 1)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> SubwordModel:
    """Trains embeddings and softmax jointly; ``weights`` weigh the rows' losses."""
    share = (float((weights * labels).sum()) + 0.5) / (float(weights.sum()) + 1.0)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return SubwordModel(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.Generator(np.random.PCG64(seed))
    # texts as (word, share) lists over one vocabulary, words as bucket lists: small beside texts as buckets
    number: dict[str, int] = {}
    bags = []
    for text in texts:
        found = Counter(words_of(text))
        word = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
        times = np.fromiter(found.values(), np.float32, len(found))
        bags.append((word, times / max(1.0, float(times.sum()))))
    starts = np.r_[0, np.cumsum([len(w) for w, _ in bags])]
    word, share = (np.concatenate([bag[k] for bag in bags]) for k in (0, 1))
    vocabulary = list(number)
    del number, bags
    pieces = [subwords(vocabulary[k : k + 20_000]) for k in range(0, len(vocabulary), 20_000)]
    of_word = np.concatenate([np.bincount(owner, minlength=min(20_000, len(vocabulary) - 20_000 * i)) for i, (_, owner) in enumerate(pieces)]) if pieces else np.zeros(0, np.int64)
    bucket = np.concatenate([b.astype(np.int32) for b, _ in pieces]) if pieces else np.zeros(0, np.int32)
    del pieces, vocabulary
    at = np.cumsum(of_word) - of_word
    held_by = np.zeros(BUCKETS, np.int32)  # how many texts have a bucket
    for i in range(len(texts)):
        own = word[starts[i] : starts[i + 1]]
        held_by[np.unique(bucket[_runs(at[own], of_word[own])])] += 1
    trust = (held_by / (held_by + SHRINK)).astype(np.float32)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    seen = np.full((BUCKETS, 1), 1e-8, np.float32)
    soft, bias = np.zeros((DIMS, 2)), np.array([0.0, prior])
    soft_seen, bias_seen = np.full((DIMS, 2), 1e-8), np.full(2, 1e-8)
    soft[:, 1] = rng.normal(0, 0.1, DIMS)
    weights = weights / weights.mean()
    epochs = max(epochs, math.ceil(LEAST_UPDATES * BATCH / max(BATCH, len(texts))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = np.sort(order[low : low + BATCH])
            n = np.diff(starts)[rows]
            entry, row = _runs(starts[rows], n), np.repeat(np.arange(len(rows)), n)
            used, of = np.unique(word[entry], return_inverse=True)
            x, size = share[entry], np.maximum(1, of_word[used])
            owner, own = np.repeat(np.arange(len(used)), of_word[used]), bucket[_runs(at[used], of_word[used])]
            trusted = vectors * trust[:, None]
            means = [np.bincount(owner, trusted[own, k], len(used)) / size for k in range(DIMS)]
            mean = np.stack([np.bincount(row, m[of] * x, len(rows)) for m in means], axis=1)
            z = mean @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weights[rows, None]
            g_soft, g_bias, g_mean = mean.T @ p, p.sum(axis=0), p @ soft.T
            of_words = [np.bincount(of, g_mean[row, k] * x, len(used)) / size for k in range(DIMS)]
            grad = np.stack([np.bincount(own, g[owner], BUCKETS) for g in of_words], axis=1) * trust[:, None]
            seen += (grad**2).mean(axis=1, keepdims=True)
            vectors -= (rate * grad / np.sqrt(seen)).astype(np.float32)
            soft_seen += g_soft**2
            bias_seen += g_bias**2
            soft -= rate * g_soft / np.sqrt(soft_seen)
            bias -= rate * g_bias / np.sqrt(bias_seen)
    return SubwordModel((trust * (vectors @ (soft[:, 1] - soft[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> SubwordModel:
    """Fits on the bounded sample of docs (doc_id, text) and labels (doc_id, label); rows of held-out ids are never used."""
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0)
    place = lambda *of: F.xxhash64(*of).cast("double") / F.lit(2.0**64) + 0.5  # noqa: E731 - from 0 to 1
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, per_label[label] / n)).otherwise(share)
    few = usable.filter(place("doc_id", F.lit("sample")) <= share)
    few = docs.join(F.broadcast(few), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id", "text"])
    # rows are thinned one by one, so an id with very many texts is bounded too
    chars = few.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > sample_chars:  # shrinks both labels alike
        few = few.filter(place("doc_id", F.xxhash64("text"), F.lit("row")) <= sample_chars / chars)
    rows = few.orderBy("doc_id", "text").select("label", "text").toArrow()  # in one order, however the files lie
    y = rows.column("label").to_numpy().astype(np.int64)
    if not len(y):
        return SubwordModel(np.zeros(BUCKETS, np.float32), 0.0)
    got = np.bincount(y, minlength=2)
    weight = np.array([counts.get(k, 0) / total / max(1, got[k]) for k in (0, 1)]) * len(y)
    return fit(rows.column("text").to_pylist(), y, weight[y])


def with_scores(docs: DataFrame, model: SubwordModel, name: str = "score", text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` and, last, its score under ``name`` (which docs must not have)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        m, known = shared.value, {}
        for batch in batches:
            texts = batch.column(at)
            out = np.empty(len(texts))
            for low in range(0, len(texts), 256):
                lists = [words_of(t.as_py()) for t in texts[low : low + 256]]
                new = list({w for ws in lists for w in ws if w not in known})
                if len(known) + len(new) > WORDS_KEPT:
                    known.clear()
                    new = list({w for ws in lists for w in ws})
                for k in range(0, len(new), 65536):
                    some = new[k : k + 65536]
                    known.update(zip(some, m.word_logits(some).tolist(), strict=True))
                for i, ws in enumerate(lists):
                    out[low + i] = m.bias + (sum(map(known.__getitem__, ws)) / len(ws) if ws else 0.0)
            score = pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return bounded_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that the classifier scores below ``threshold``."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, _trained(docs, labels), name).filter(F.col(name) < threshold).drop(name)


def _trained(docs: DataFrame, labels: DataFrame) -> SubwordModel:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return train(d, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: doc_id, label."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_scores(d, _trained(docs, labels)).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxic_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)
