"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Method: each of TREES trees gives a vector a string of BITS sign bits of random
projections and keeps the strings sorted. A query descends in every tree to its longest
prefix match; then all trees ascend together, one bit at a time, and everything that
shares the shortened prefix joins the candidates, until the trees' matches number WANTED
times the rows of the forest. Candidates are ranked by the inner product of the original
vectors in double precision, ties to the smaller id; which of many need that is seen from
products of scaled vectors in single precision, with room for the error these can have.
As nearness is the inner product and not the angle, rows get one more component that
makes all lengths equal before they are hashed; queries get 0 there.

On a cluster the rows are dealt by a hash of their ids to shards of about SHARD_ROWS,
each with a forest of its own in memory, and a block of at most about QUERY_BLOCK queries
meets a shard in one task, which returns each query's best there; a top-k by query over
these merges them. Shards have one size however frequent a vector is, no pair leaves a
task except among the best, and every row is indexed.

On vectors without any structure, as the check's, no short list holds the nearest: to
find nine tenths of them the forest looks at a large part of the rows. WANTED says how
large; smaller values suit clustered data.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors only meet vectors of their
own length; repeated rows are rows of their own, except that a query never finds its
own id; fewer candidates than K give fewer rows; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.llm.jaccard_join import _groups
from foliograph.workspace import bounded_batches, shuffle_partitions, written

K = 20
TREES, BITS = 64, 32
WANTED = 0.8
SHARD_ROWS, QUERY_BLOCK = 8192, 4096
SEED = 20231


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.trees, self.bits, self.longest = vectors, trees, bits, max(longest, 5e-324)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.planes = rng.standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        scaled = vectors / self.longest  # lengths up to 1, whatever the vectors' own
        self.small = scaled.astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))
        codes = self._strings(np.hstack([scaled, rest]))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows: hash strings as numbers whose order is the strings' order."""
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        out = np.empty((self.trees, len(vectors)), np.uint64)
        for low in range(0, len(vectors), 2048):
            signs = (vectors[low : low + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[:, low : low + 2048] = (signs * weights).sum(axis=2, dtype=np.uint64).T
        return out

    def matches(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the run of sorted strings that share the prefix at which the trees' matches reach ``wanted``."""
        codes = self._strings(np.hstack([_unit(queries), np.zeros((len(queries), 1))]))
        n = self.sorted.shape[1]
        low, high = np.zeros(codes.shape, np.int64), np.full(codes.shape, n, np.int64)
        # descending to prefixes of growing length until fewer match; the runs of the last length with enough of them stay
        open_ = np.arange(codes.shape[1])
        for length in range(1, self.bits + 1):
            cut = np.uint64(self.bits - length)
            first = (codes[:, open_] >> cut) << cut
            last = first | ((np.uint64(1) << cut) - np.uint64(1))
            a = np.stack([np.searchsorted(self.sorted[t], first[t], "left") for t in range(self.trees)])
            b = np.stack([np.searchsorted(self.sorted[t], last[t], "right") for t in range(self.trees)])
            enough = (b - a).sum(axis=0) >= wanted
            open_ = open_[enough]
            low[:, open_], high[:, open_] = a[:, enough], b[:, enough]
            if not len(open_):
                break
        return low, high

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and scores of its best candidates, its own id apart; ids are ascending."""
        low, high = self.matches(queries, wanted)
        out = []
        n = len(ids)
        keep = min(n, 4 * k)
        unit = _unit(queries).astype(np.float32)
        # of a product of d terms with |v| and |q| up to 1: rounding both sides and d sums, in units of 2**-24; twice that between two
        slack = np.float32(4 * (queries.shape[1] + 4) * 2.0**-24)
        for i in range(len(queries)):
            if low[:, i].any() or (high[:, i] < n).any():
                hit = np.zeros(n, bool)
                for t in range(self.trees):
                    hit[self.order[t, low[t, i] : high[t, i]]] = True
                rows = np.flatnonzero(hit)
            else:
                rows = np.arange(n)
            rows = rows[ids[rows] != own[i]]
            if len(rows) > keep:  # single precision first, with room for its rounding; every tie stays
                rough = self.small[rows] @ unit[i]
                edge = np.partition(rough, len(rows) - keep)[len(rows) - keep]
                rows = rows[rough >= edge - slack]
            score = (self.vectors[rows] * queries[i]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((rows[best], score[best]))
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, as squares of very large or small ones don't exist."""
    v = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 5e-324)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def _length(vector: Column) -> Column:
    peak = F.array_max(F.transform(vector, F.abs))
    return peak * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: for every row for which ``query`` holds, the k best of all other rows found."""
    spark = rows.sparkSession
    r = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    r = written(r.filter(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("dims", F.size("v")), "vectors")
    n, asking = (int(x or 0) for x in r.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first())
    # a row for each length of vectors; Spark broadcasts the written table only if it is small
    r = r.join(written(r.groupBy("dims").agg(F.max(_length(F.col("v"))).alias("longest")), "longest"), "dims")
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asking / QUERY_BLOCK))
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    indexed = r.select("dims", shard.alias("shard"), every(blocks).alias("block"), F.lit(0).alias("asks"), "id", "longest", "v")
    queries = r.filter("asks").select("dims", every(shards).alias("shard"), block.alias("block"), F.lit(1).alias("asks"), "id", "longest", "v")
    tasks = indexed.union(queries).repartition(shuffle_partitions(spark), "dims", "shard", "block").sortWithinPartitions("dims", "shard", "block", "asks", "id")

    def run(batches):
        import pyarrow as pa

        for t in _groups(batches, 3):
            dims = t.column("dims")[0].as_py()
            ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy() == 1
            if asks.all() or not asks.any():
                continue
            v = np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks]).reshape(-1, dims)
            forest = Forest(v[~asks], t.column("longest")[0].as_py())
            rows, own, asked = ids[~asks], ids[asks], v[asks]
            found = forest.nearest(asked, own, rows, k, int(wanted * len(rows)))
            count = [len(f[0]) for f in found]
            at = np.concatenate([f[0] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, count)), pa.array(rows[at]), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    best = bounded_batches(tasks).mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ann_forest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 20 == 0)
