"""Near-duplicate documents by MinHash tables whose keys are pairs from two small collections of hashes.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its
shingles of SHINGLE words (with fewer words the whole sequence as one). Sets whose Jaccard
similarity is THRESHOLD or more are linked; documents reachable over links are a group.

Method: two collections of HALVES half keys each, a half key being VALUES MinHash values.
Table (i, j) has as its key half i of the first and half j of the second collection, so
HALVES * HALVES tables of 2 * VALUES values cost 2 * HALVES * VALUES values instead of
2 * VALUES * HALVES ** 2: 56 instead of 784. A table row is made only of halves that another
set has too. Candidates are verified on the full sets.

Verification finds groups, not pairs. First every set is compared with one partner, the
first of all buckets it is in; copies by the thousand become one group that way, and each
text travels twice. Buckets that lie in one group are then done. In the others signatures
meet, dealt in pairs of blocks; of the pairs across groups that the posterior similarity
leaves, each in the first table it shares, the texts meet, in the same blocks, and a pair
is compared unless the two are connected by then.

Skew: equal sets are folded before anything meets, buckets with the same members are one,
a bucket beyond a block is dealt to several tasks. No row stands for a pair, except the one
partner of each set.

A true pair is missed if it shares no half of either collection: 2 * (1 - s**VALUES)**HALVES,
1.2e-6 at the threshold and less above it, plus TOLERANCE for each of the two looks of the
posterior (at the table keys' values, then with the bins).

Defined results: texts without words (null, empty, white space) have an empty set and are
linked with nothing; rows with a null doc_id are linked with nothing, have a null component
and are kept; repeated rows are copies; rows of one doc_id with different texts are each
linked by their own text, and each names the smallest doc_id it reaches; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.components import components
from foliograph.llm.jaccard_join import BLOCK, WORDS_KEPT, _groups, least_matches
from foliograph.workspace import bounded_batches, shuffle_partitions, written

SHINGLE = 4
#: In hundredths, as links are decided in whole numbers.
THRESHOLD = 80
HALVES, VALUES = 14, 2
HASHES = 2 * HALVES * VALUES
#: A second sketch for pruning alone: the least hash of each of so many equal parts of the hash range, a byte each.
BINS = 128
TOLERANCE = 1e-6
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordSets:
    """Shingle sets as sorted arrays of 64-bit hashes; words are hashed once as long as they are remembered."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}
        self.powers = np.array([pow(0x5851F42D4C957F2D, k + 1, 2**64) for k in range(size)], np.uint64)

    def _hashed(self, word: bytes) -> int:
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        # as bytes, lower() and split() know ASCII letters and ASCII white space only
        known, words = self.known, (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([known[w] if w in known else self._hashed(w) for w in words], np.uint64)
        size = min(self.size, len(h))
        n = len(h) - size + 1
        s = np.full(n, size, np.uint64)
        for k in range(size):
            s += h[k : k + n] * self.powers[k]
        s ^= s >> np.uint64(29)
        s *= _MIX
        s ^= s >> np.uint64(32)
        return np.unique(s)


def hash_family(n: int = HASHES, seed: int = 20250611) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], at_once: int = 4096) -> np.ndarray:
    """Sixteen bits of each value: two values of a half key that agree in them make the same key everywhere."""
    a, b = family
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), at_once):
        values = shingles[None, k : k + at_once] * a[:, None]
        values += b[:, None]
        least = np.minimum(least, values.min(axis=1))
    return (least * _MIX >> np.uint64(48)).astype(np.uint16)


def bin_minima(shingles: np.ndarray) -> np.ndarray:
    """One byte of the least hash in each part of the range, 0 for parts without any; the array is sorted, so that is each part's first."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(shingles, edges)
    full = first < np.r_[first[1:], len(shingles)]
    out = np.zeros(BINS, np.uint8)
    out[full] = np.maximum(shingles[first[full]] * _MIX >> np.uint64(56), np.uint64(1))
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < threshold * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (low + high - both)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class (null without words), n_shingles, sig (MinHash values, then bins), for rows of doc_id, text_hash, text."""

    def run(batches):
        import pyarrow as pa

        sets, family = WordSets(), hash_family()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(2):
                s = sets(text.as_py())
                sizes.append(len(s))
                keys.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                sigs.append(min_hashes(s, family).tobytes() + bin_minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "class", "n_shingles", "sig"])

    return bounded_batches(docs).mapInArrow(run, "doc_id long, text_hash long, class long, n_shingles long, sig binary")


def table_rows(classes: DataFrame) -> DataFrame:
    """key, table, class: the rows of all tables whose two halves occur in other sets as well."""
    half = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 2 * VALUES * k + 1, 2 * VALUES))
    halves = classes.select("class", F.posexplode(F.array(*[half(k) for k in range(2 * HALVES)])).alias("k", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    mine = halves.join(shared, "half", "left_semi").groupBy("class").agg(F.collect_list(F.struct("k", "half")).alias("h"))
    first, second = F.filter("h", lambda x: x["k"] < HALVES), F.filter("h", lambda x: x["k"] >= HALVES)
    pair = lambda x, y: F.struct((x["k"] * HALVES + y["k"] - HALVES).alias("table"), F.xxhash64(x["half"], y["half"]).alias("key"))
    crossed = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: pair(x, y))))
    return mine.select("class", F.explode(crossed).alias("t")).select("t.key", "t.table", "class")


def _buckets(rows: DataFrame) -> DataFrame:
    """key, table, n, first of the buckets with several members; of buckets with the same members the one of the first table."""
    found = rows.groupBy("key").agg(F.min("table").alias("table"), F.count("*").alias("n"), F.min("class").alias("first"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("sum")).filter("n > 1")
    return found.groupBy("n", "first", "sum").agg(F.min(F.struct("table", "key")).alias("t")).select("t.key", "t.table", "n", "first")


def _partners(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """a, b: each class with the first member of all its buckets."""
    return rows.select("key", "class").join(buckets.select("key", "first"), "key").groupBy("class").agg(F.min("first").alias("a")).filter("a < class").select("a", F.col("class").alias("b"))


def verified_pairs(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets are linked; texts: class, text."""

    def run(batches):
        import pyarrow as pa

        sets, last, s = WordSets(), None, None
        for batch in batches:
            good = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if s is None or a != last:
                    last, s = a, sets(left.as_py())
                good.append(linked(s, sets(right.as_py()), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")
    return bounded_batches(both.select("a", "b", "left", "right")).mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once for every task its bucket is dealt to: task_a <= task_b are the two blocks that meet there."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks.cast("long")).cast("int")
    d = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return d.select("*", F.least("block", "other").alias("task_a"), F.greatest("block", "other").alias("task_b")).drop("other")


def _by_task(rows: DataFrame) -> DataFrame:
    task = ["key", "task_a", "task_b"]
    return rows.repartition(shuffle_partitions(rows.sparkSession), *task).sortWithinPartitions(*task)


@cache
def _least(seen: int, threshold: int, tolerance: float) -> int:
    return least_matches(seen, threshold / 100, tolerance)


def survivors(t, threshold: int = THRESHOLD, tolerance: float = TOLERANCE, at_once: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a task's rows, an Arrow table, that sizes and the posterior leave: of the task's two blocks, of different groups,
    and in the first table they share."""
    block, group, size = (t.column(c).to_numpy() for c in ("block", "group", "n_shingles"))
    a, b, table = (t.column(c)[0].as_py() for c in ("task_a", "task_b", "table"))
    both = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, 2 * HASHES + BINS)
    sig, bins = np.ascontiguousarray(both[:, : 2 * HASHES]).view(np.uint16), both[:, 2 * HASHES :]
    half = np.ascontiguousarray(sig).view(np.uint32).reshape(len(sig), 2, HALVES)
    least = np.array([_least(n, threshold, tolerance) for n in range(HASHES + BINS + 1)])
    if a == b:
        left, right = np.triu_indices(len(block), 1)
    else:
        left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == a), np.flatnonzero(block == b), indexing="ij"))
    low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    fits = (group[left] != group[right]) & (100 * low >= threshold * high)
    left, right = left[fits], right[fits]
    for k in range(0, len(left), at_once):
        x, y = left[k : k + at_once], right[k : k + at_once]
        equal = (sig[x] == sig[y]).sum(axis=1)
        near = equal >= least[HASHES]
        x, y, equal = x[near], y[near], equal[near]
        # parts of the range that either set has something in count as looked at
        one, two = bins[x], bins[y]
        looked = HASHES + ((one | two) > 0).sum(axis=1)
        near = equal + ((one == two) & (one > 0)).sum(axis=1) >= least[looked]
        x, y = x[near], y[near]
        same = half[x] == half[y]
        here = same[:, 0].argmax(axis=1) * HALVES + same[:, 1].argmax(axis=1) == table
        if here.any():
            yield x[here], y[here]


def _needed(rows: DataFrame, threshold: int) -> DataFrame:
    """key, task_a, task_b, class: where which texts have to meet."""

    def run(batches):
        import pyarrow as pa

        for t in _groups(batches, 3):
            wanted = [np.union1d(x, y) for x, y in survivors(t, threshold)]
            if wanted:
                yield from t.select(["key", "task_a", "task_b", "class"]).take(pa.array(np.unique(np.concatenate(wanted)))).to_batches()

    columns = ["key", "task_a", "task_b", "table", "block", "class", "group", "n_shingles", "sig"]
    return bounded_batches(_by_task(_dealt(rows)).select(columns)).mapInArrow(run, "key long, task_a int, task_b int, class long")


def _verified_blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """a, b: links that connect whatever the links of a task's pairs connect."""

    def run(batches):
        import pyarrow as pa

        sets = WordSets()
        for t in _groups(batches, 3):
            root = {c: c for c in t.column("group").to_pylist()}
            name, group = t.column("class").to_pylist(), t.column("group").to_pylist()
            own = [sets(x.as_py()) for x in t.column("text")]
            found = []

            def top(c, root=root):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for left, right in survivors(t, threshold):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    a, b = top(group[i]), top(group[j])
                    if a != b and linked(own[i], own[j], threshold):
                        root[max(a, b)] = min(a, b)
                        found.append((name[i], name[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    columns = ["key", "task_a", "task_b", "table", "block", "class", "group", "n_shingles", "sig", "text"]
    return bounded_batches(_by_task(rows).select(columns)).mapInArrow(run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: verified links whose components are the groups. classes: class, doc_id, text_hash, n_shingles, sig; docs: doc_id, text_hash, text."""
    rows = written(table_rows(classes), "table-rows")
    buckets = written(_buckets(rows), "buckets")
    # the one join that moves all texts; what follows reads those of classes with candidates
    wanted = classes.select("class", "doc_id", "text_hash").join(rows.join(buckets, "key", "left_semi").select("class").distinct(), "class", "left_semi")
    texts = written(docs.join(wanted, ["doc_id", "text_hash"]).select("class", "text").distinct(), "texts")
    classes = classes.select("class", "n_shingles", "sig")
    first = written(verified_pairs(_partners(rows, buckets), texts, threshold), "links")
    groups = components(first)
    members = rows.select("key", "class").join(buckets.select("key", "table", "n"), "key").join(groups.select(F.col("node").alias("class"), F.col("component").alias("group")), "class", "left")
    members = written(members.withColumn("group", F.coalesce("group", "class")), "members")
    open_buckets = members.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("key")
    described = members.join(open_buckets, "key", "left_semi").join(classes, "class")
    needed = written(_needed(described, threshold), "needed")
    # a class is described again where it is needed; its text goes nowhere else
    again = needed.join(members, ["key", "class"]).join(classes, "class").withColumn("block", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    return first.union(written(_verified_blocks(again.join(texts, "class"), threshold), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sigs = written(signatures(d), "signatures")
    folded = sigs.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "sig")).alias("m"))
    classes = written(folded.select("class", "m.*"), "classes")
    found = components(links(classes, d, threshold))
    named = classes.select("class", F.col("doc_id").alias("least")).join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    named = written(named.withColumn("component", F.coalesce("component", "class")), "named")
    of_class = named.select("class", "component").join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id")
    every = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    rows = every.join(of_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_tensor_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, unnest(s) AS g FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(k.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN component k ON k.rep = c.rep"""
