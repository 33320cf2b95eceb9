"""Document fingerprints from prefix polynomial hashes.

Method: for a text c the array H[i] = sum of c[j] * B**j over j < i, modulo a prime, is
kept for two primes. Any span's hash follows from two entries of each array, so spans
are compared in constant time, and the longest common extension of two positions, in
one text or two, is found by binary search.

A fingerprint is made from the same arrays: the number of characters, the hash of the
whole text and the KEPT smallest mixed hashes of all spans of SPAN characters, counted as
often as they occur. Texts under SHORT characters also keep those of their spans of 4, 2
and 1 characters. Two fingerprints are compared at the longest span that the shorter text
has room for four times, or, where one of them doesn't keep that, at SPAN; their likeness
is the share of equal hashes among the KEPT smallest of both, which estimates the Jaccard
similarity of the texts' spans (exact while both together have KEPT spans or fewer). Equal
fingerprints have 1.

Fingerprinting is map-side. The query's edited texts need the next document: rows are
put into buckets of neighbouring ids (cut points from approximate quantiles, at most
CUTS of them), the first row of each bucket also goes to the bucket before, and each
bucket is streamed in order; no row meets more than its neighbour.

Defined results: null text is empty; a null doc_id comes first; rows with equal ids
follow in order of text; the last row's next is the first; a single row is its own
next; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import bounded_batches, shuffle_partitions

#: Two primes below 2**31, so that products fit 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1105378049, 872514239)
SPAN = 8
KEPT = 64
#: Texts below this length also keep the hashes of shorter spans; a text that needs those is under a quarter of it.
SHORT = 128
SPANS = (8, 4, 2, 1)
CUTS = 8192
_MIX, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


class Powers:
    """B**j and its inverse modulo the primes, as far as any text has needed."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def _grown(self, have: np.ndarray, step: int, p: int, n: int) -> np.ndarray:
        while len(have) < n:  # doubles: x**(j + len) = x**j * x**len
            have = np.concatenate([have, have * np.uint64(pow(step, len(have), p)) % np.uint64(p)])
        return have

    def upto(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        p, b = PRIMES[k], BASES[k]
        self.up[k] = self._grown(self.up[k], b, p, n)
        self.down[k] = self._grown(self.down[k], pow(b, -1, p), p, n)
        return self.up[k], self.down[k]


_powers = Powers()


class PrefixHashes:
    """Prefix arrays of one text; answers span equality and longest common extensions."""

    def __init__(self, text: str | None, powers: Powers = _powers):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.powers = len(codes), powers
        self.prefix = []
        for k, p in enumerate(PRIMES):
            up, _ = powers.upto(self.n + 1, k)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * up[: self.n] % np.uint64(p), out=sums[1:])  # below 2**33 terms of 31 bits
            sums %= np.uint64(p)
            self.prefix.append(sums)

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length at ``starts``, wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(PRIMES):
            _, down = self.powers.upto(self.n + 1, k)
            h = self.prefix[k]
            out = out << np.uint64(31) | (h[starts + length] + np.uint64(p) - h[starts]) * down[starts] % np.uint64(p)
        return out

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])

    def all_spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of one length."""
        out = np.zeros(self.n - length + 1, np.uint64)
        for k, p in enumerate(PRIMES):
            _, down = self.powers.upto(self.n + 1, k)
            h, m = self.prefix[k], np.uint64(p)
            d = h[length:] + m
            d -= h[: len(out)]
            d *= down[: len(out)]  # below 2**32 * 2**31
            d %= m
            out <<= np.uint64(31)
            out |= d
        return out

    def equal(self, a: int, other: PrefixHashes, b: int, length: int) -> bool:
        return a + length <= self.n and b + length <= other.n and self.span(a, length) == other.span(b, length)

    def common_extension(self, a: int, other: PrefixHashes, b: int) -> int:
        """The largest length for which the spans at ``a`` and at ``b`` of the other text are equal."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, other, b, mid) else (low, mid - 1)
        return low


def sketch(hashes: PrefixHashes, span: int = SPAN) -> np.ndarray:
    """The KEPT smallest distinct mixed hashes of the spans of one length, ascending, as 32-bit numbers."""
    if hashes.n < span:
        return np.zeros(0, np.uint32)
    h = hashes.all_spans(span)
    # the second occurrence of a span counts as another span, the third too, so repetition weighs as in the text
    h.sort()
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0))
    h += (at - first).astype(np.uint64) * _AGAIN
    h ^= h >> np.uint64(29)
    h *= _MIX
    mixed = (h >> np.uint64(32)).astype(np.uint32)
    some = 4 * KEPT
    if len(mixed) > 2 * some:
        least = np.unique(np.partition(mixed, some)[:some])
        if len(least) >= KEPT:
            return least[:KEPT]
    return np.unique(mixed)[:KEPT]


class Print:
    """A text's fingerprint, as numbers and as text."""

    def __init__(self, text: str | None):
        self.hashes = PrefixHashes(text)
        self.n, self.whole = self.hashes.n, self.hashes.span(0, self.hashes.n)
        self.least = {s: sketch(self.hashes, s) for s in (SPANS if self.n < SHORT else SPANS[:1])}

    def __str__(self) -> str:
        return "-".join([f"{self.n:x}", f"{self.whole:016x}", *(x.astype(">u4").tobytes().hex() for x in self.least.values())])


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    read = lambda s: dict(zip(SPANS, (np.frombuffer(bytes.fromhex(x), ">u4") for x in s.split("-")[2:]), strict=False))
    return _alike(int(a.split("-")[0], 16), read(a), int(b.split("-")[0], 16), read(b))


def _alike(n: int, x: dict[int, np.ndarray], m: int, y: dict[int, np.ndarray]) -> float:
    span = next((s for s in SPANS if 4 * s <= min(n, m)), 1)
    span = span if span in x and span in y else SPAN
    return _shared(x[span], y[span])


def _shared(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = np.intersect1d(x, y, assume_unique=True)
    # of the smallest of both, as many as either sketch vouches for
    union = np.union1d(x, y)
    if max(len(x), len(y)) == KEPT:
        union = union[:KEPT]
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def alike(a: Print, b: Print) -> float:
    return 1.0 if (a.n, a.whole) == (b.n, b.whole) else _alike(a.n, a.least, b.n, b.least)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [Print(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.n for p in prints], pa.int64()), pa.array(list(map(str, prints)), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(d).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _with_heads(docs: DataFrame) -> DataFrame:
    """bucket, head (1 for a row that only serves as the last row's next), doc_id, text, each bucket in order."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    parts = min(CUTS, 4 * n)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 16 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # the number of cut points below an id: ids are compared with a constant array by binary halving
    cut = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    place = F.lit(0)
    step = 1
    while step * 2 <= len(cuts):
        step *= 2
    steps = []
    while step and cuts:
        steps.append(step)
        step //= 2
    keyed = docs.withColumn("bucket", place)
    if cuts:
        halve = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(cut, acc + s - 1) < F.col("doc_id")), acc + s).otherwise(acc)
        keyed = docs.withColumn("bucket", F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), place, halve), place))
    # the first row of each bucket: smallest id (null before all), then the smallest text
    first = keyed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).orderBy("bucket").collect()
    heads = [(before["bucket"], row["m"]["doc_id"]) for before, row in zip([*first[-1:], *first[:-1]], first, strict=True)]
    if not heads:
        return keyed.withColumn("head", F.lit(0)).select("bucket", "head", "doc_id", "text")
    heads = F.broadcast(spark.createDataFrame(heads, "of int, head_id long"))  # a row for each bucket, CUTS + 1 at most
    extra = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id"))).groupBy("of", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = keyed.select("bucket", F.lit(0).alias("head"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.union(extra.select("of", F.lit(1), "doc_id", "text"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_chars (the longest common
    extension of text and edited text from their first characters) of every row of docs (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_chars"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()], strict=True)))
        last = None  # bucket, head, doc_id, text, print of the row before
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for bucket, head, doc_id, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                own = Print(text)
                if last is not None and last[0] == bucket and not last[1]:
                    _, _, before, before_text, p = last
                    new = edited(before_text, text)
                    q = Print(new)
                    row = (before, p.n, hashlib.sha256(new.encode()).hexdigest(), str(p), str(q), alike(p, q), alike(p, own), p.hashes.common_extension(0, q.hashes, 0))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                last = (bucket, head, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_chars long"
    return bounded_batches(_with_heads(d)).mapInArrow(run, schema)


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
