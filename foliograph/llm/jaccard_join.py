"""Similarity join on word shingles with Bayesian candidate pruning.

Texts are lower-cased, split at white space and cut into shingles of SHINGLE words (a
shorter text is one shingle). Documents with one shingle set form a class; links are
between classes whose sets have a Jaccard similarity of THRESHOLD or more.

Method: classes that share one of BANDS bands of MinHash values meet in a bucket. A
bucket's pairs are compared HASHES_AT_ONCE values at a time; a pair is dropped once the
posterior probability (uniform prior, so a Beta) that it reaches the threshold falls
below TOLERANCE. What is left joins documents into families, and within a family every
pair is verified exactly on the shingle sets. Only counts and one edge per document and
task come out, never a row per pair.

Skew: copies are folded by partial aggregation before anything meets; buckets with the
same members are compared once; buckets and families beyond BLOCK classes are dealt as
pairs of blocks to different tasks, so no task gets more than two blocks. A family's texts
travel once for every other block of it; the MinHash values of all its pairs are compared,
the texts of the remaining ones.

A true pair is missed with a probability of (1 - s**4)**32, 5e-8 at the threshold and
less above it, plus about TOLERANCE for each of the four looks.

Defined results: texts without words (null, empty, white space) have no links and are
their own class; rows with a null doc_id are returned with a null class and no links;
repeated rows are copies of one another; a doc_id with several texts is one document
with the links of all its texts; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.components import components
from foliograph.workspace import bounded_batches, shuffle_partitions, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
HASHES_AT_ONCE = 32
TOLERANCE = 1e-6
BLOCK = 512
#: Distinct words whose hashes a worker remembers.
WORDS_KEPT = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, {}
        self.powers = np.array([pow(0x5851F42D4C957F2D, k + 1, 2**64) for k in range(size)], np.uint64)

    def _hash(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        self.words[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.words, (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([known[w] if w in known else self._hash(w) for w in words], np.uint64)
        if len(h) < self.size:
            s = (h * self.powers[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
        else:
            n = len(h) - self.size + 1
            s = np.zeros(n, np.uint64)
            for k in range(self.size):
                s += h[k : k + n] * self.powers[k]
        s ^= s >> np.uint64(29)
        s *= _MIX
        s ^= s >> np.uint64(32)
        return np.unique(s)


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240229))
    return draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, HASHES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], at_once: int = 4096) -> np.ndarray:
    a, b = family
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(shingles), at_once):
        values = shingles[None, k : k + at_once] * a[:, None]
        values += b[:, None]
        least = np.minimum(least, (values.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return least


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``seen`` that leave a posterior of ``tolerance``: with a uniform prior the posterior that
    the similarity is at least t after m matches is P(Binomial(seen + 1, t) <= m)."""
    total = 0.0
    for m in range(seen + 1):
        total += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_key (null without words), n_set, sig: MinHash values as bytes, a row for each row of ``docs``."""

    def run(batches):
        import pyarrow as pa

        shingle, family = Shingler(), _hash_family()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py())
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sizes.append(len(s))
                sigs.append(min_hashes(s, family).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "set_key", "n_set", "sig"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(d).mapInArrow(run, "doc_id long, set_key binary, n_set int, sig binary")


def _dealt(rows: DataFrame, key: str, member: str, n: str) -> DataFrame:
    """Each row once for every task its group is dealt to: task_a <= task_b are the two blocks that meet there, block is its own."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(member), blocks.cast("long")).cast("int")
    d = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.select("*", F.least("block", "other").alias("task_a"), F.greatest("block", "other").alias("task_b")).drop("other")
    return d.repartition(shuffle_partitions(rows.sparkSession), key, "task_a", "task_b").sortWithinPartitions(key, "task_a", "task_b")


def _groups(batches, columns: int) -> Iterator[tuple[list[np.ndarray], object]]:
    """Runs of rows with equal first ``columns`` columns, as Arrow tables; one run is held at a time."""
    import pyarrow as pa

    held: list = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(columns)], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != held_key:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                held_key = keys[start]
                start = i
    if held:
        yield pa.Table.from_batches(held)


def _roots(n: int, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that each of n nodes reaches over the given pairs."""
    root = names.copy()
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        if (before == root).all():
            break
    return root


def _pairs_in(block: np.ndarray, a: int, b: int, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task, within its one block or across its two, that sizes allow."""
    if a == b:
        left, right = np.triu_indices(len(block), 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == a), np.flatnonzero(block == b), indexing="ij"))
    low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fits = low >= threshold * high - 1e-9
    return left[fits], right[fits]


def _looks(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After how many values pairs are looked at, and how many equal ones they need to stay."""
    return [(k, least_matches(k, threshold, tolerance)) for k in range(HASHES_AT_ONCE, HASHES + 1, HASHES_AT_ONCE)]


def _left_by_posterior(sigs: bytes, left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose MinHash values, compared a look at a time, leave the threshold within reach."""
    sig = np.frombuffer(sigs, np.uint32).reshape(-1, HASHES)
    equal, at = np.zeros(len(left), np.int32), 0
    for seen, least in looks:
        for k in range(0, len(left), 65536):
            part = slice(k, k + 65536)
            equal[part] += (sig[left[part], at:seen] == sig[right[part], at:seen]).sum(axis=1, dtype=np.int32)
        good = equal >= least
        left, right, equal, at = left[good], right[good], equal[good], seen
    return left, right


def pruned_edges(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """a, b: edges whose components hold every pair of classes (rep, n_set, sig) that the posterior doesn't rule out."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    members = classes.select("rep", F.explode(bands).alias("bucket"))
    # buckets with the same members are one: same number, same smallest and same sum of hashes
    alike = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sum")).filter("n > 1")
    kept = written(alike.groupBy("n", "first", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    rows = members.join(kept, "bucket").join(classes.select("rep", "n_set", "sig"), "rep")
    looks = _looks(threshold, tolerance)

    def run(batches):
        import pyarrow as pa

        for t in _groups(batches, 3):
            rep, size, block = (t.column(c).to_numpy() for c in ("rep", "n_set", "block"))
            left, right = _pairs_in(block, t.column(1)[0].as_py(), t.column(2)[0].as_py(), size, threshold)
            left, right = _left_by_posterior(b"".join(t.column("sig").to_pylist()), left, right, looks)
            root = _roots(len(rep), left, right, rep)
            moved = root != rep
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(root[moved])], ["a", "b"])

    dealt = _dealt(rows, "bucket", "rep", "n").select("bucket", "task_a", "task_b", "block", "rep", "n_set", "sig")
    return bounded_batches(dealt).mapInArrow(run, "a long, b long")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    if len(sets) <= 8 or len(left) <= 32:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[number] > 1
    owner, number = owner[common], number[common]
    number = np.unique(number, return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(number.max(initial=-1)) + 1, 2048):
        here = (number >= low) & (number < low + 2048)
        m = np.zeros((len(sets), 2048), np.float32)
        m[owner[here], number[here] - low] = 1
        total += m @ m.T
    return total[left, right].astype(np.int64)


def verified(docs: DataFrame, families: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, text_links, doc_links, root: exact links of each class with others of its family, a row for each task the class is
    dealt to. families: rep, family, weight; docs: rep, text of every class in a family."""
    looks = _looks(threshold)
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    rows = families.join(sizes, "family").join(docs, "rep")

    def run(batches):
        import pyarrow as pa

        shingle, hashes = Shingler(), _hash_family()
        for t in _groups(batches, 3):
            rep, weight, block = (t.column(c).to_numpy() for c in ("rep", "weight", "block"))
            sets = [shingle(x.as_py()) for x in t.column("text")]
            n = np.array([len(s) for s in sets], np.int64)
            left, right = _pairs_in(block, t.column(1)[0].as_py(), t.column(2)[0].as_py(), n, threshold)
            left, right = _left_by_posterior(b"".join(min_hashes(s, hashes).tobytes() for s in sets), left, right, looks)
            both = _shared(sets, left, right)
            good = (1 + threshold) * both >= threshold * (n[left] + n[right]) - 1e-9
            left, right = left[good], right[good]
            texts = np.bincount(left, minlength=len(rep)) + np.bincount(right, minlength=len(rep))
            linked = np.bincount(left, weight[right], len(rep)) + np.bincount(right, weight[left], len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(texts.astype(np.int64)), pa.array(linked.astype(np.int64)), pa.array(_roots(len(rep), left, right, rep))], ["rep", "text_links", "doc_links", "root"])

    dealt = _dealt(rows, "family", "rep", "n").select("family", "task_a", "task_b", "block", "rep", "weight", "text")
    return bounded_batches(dealt).mapInArrow(run, "rep long, text_links long, doc_links long, root long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of the documents it is linked with, directly or through others), copy_id (smallest id with the
    same shingle set), n_links (other documents at the threshold or above, copies included), n_text_links (other sets)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = written(signatures(d), "signatures")
    first = F.min(F.struct("doc_id", "n_set", "sig"))
    classes = sigs.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(first.alias("m"), F.count("*").alias("weight"))
    classes = written(classes.select("set_key", "weight", F.col("m.doc_id").alias("rep"), F.col("m.n_set").alias("n_set"), F.col("m.sig").alias("sig")), "classes")
    families = components(pruned_edges(classes, threshold))
    members = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = written(members.join(classes.groupBy("rep").agg(F.sum("weight").alias("weight")), "rep"), "families")
    texts = d.withColumnRenamed("doc_id", "rep").join(members.select("rep"), "rep", "left_semi").distinct()
    links = written(verified(texts, members, threshold), "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("rep").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    results = classes.select("set_key", "rep", "weight").join(totals, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    results = results.select("set_key", "rep", "weight", "text_links", "doc_links", "component")
    every = sigs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    none = F.lit(0).cast("long")
    return every.join(results, "set_key", "left").select(
        "doc_id",
        F.coalesce("component", "rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_id"),
        (F.coalesce("doc_links", none) + F.coalesce(F.col("weight") - 1, none)).alias("n_links"),
        F.coalesce("text_links", none).alias("n_text_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near duplicates: of each class the smallest doc_id stays, once; rows
    with a null doc_id stay."""
    keep = near_duplicates(docs, threshold=threshold).filter("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    # of repeated rows that differ elsewhere always the same one
    once = rows.join(keep, "doc_id", "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row").union(rows.filter("doc_id IS NULL").select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS rep, count(*) AS weight, s FROM sets GROUP BY s),
items AS (SELECT rep, unnest(s) AS g FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE c >= 0.8 * (len(x.s) + len(y.s) - c) - 1e-9),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS rep, count(*) AS n_text_links, sum(weight) AS doc_links FROM links JOIN classes ON rep = b GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(c.rep, d.doc_id) AS copy_id,
  (coalesce(n.doc_links, 0) + coalesce(c.weight - 1, 0))::BIGINT AS n_links, coalesce(n.n_text_links, 0)::BIGINT AS n_text_links
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.s = s.s LEFT JOIN component k ON k.rep = c.rep LEFT JOIN counted n ON n.rep = c.rep"""
