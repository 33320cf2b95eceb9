"""Ranked lexical search over an inverted index with Block-Max WAND.

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z
lower-cased. A term's impact in a document with tf of it is (10**9 * tf) div (1000 * tf +
12 * m), m being the document's length measure 100 - 25 + 25 * n * N div L; a document's
score sums weight times impact over the query's terms, repeats included.

Method: each task indexes its own documents in segments, so building the index moves no
text and needs no shuffle. A segment has a row for each of its terms: postings by document
number in blocks of BLOCK, each compressed on its own (differences and counts in as few
bytes as each needs) and described by its last document, its greatest impact and its place.
Over the stretches of documents between block ends the greatest impacts of the terms' current
blocks bound every score. A query first looks at the most promising stretches, then at the
rest in ascending order; a shallow move goes on, without decompressing, past all stretches
whose bound can't reach the query's twentieth score so far; only blocks with documents of
the stretches left are decompressed. Bounds and scores are whole numbers, so nothing is lost.
The threshold a task has reached in one segment holds in its next ones.

Scale: segments have a bounded number of documents and characters (or one text), so neither
a frequent term nor a large group of copies fills a task. Queries are dealt in chunks of
ITEMS; a chunk and a segment meet in one task, with the rows of the terms they share. Each
task hands on K rows a query.

Defined results: rows with a null doc_id or item_id take no part, not even in the counts;
null texts and texts without terms have none; each row of documents is a document of its
own, so repeated rows are ranked each; repeated rows of items are one, and an item_id with
several texts asks for the terms of all; items without terms, or whose terms occur nowhere,
have no results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import bounded_batches, shuffle_partitions, written

K = 20
BLOCK = 128
SEGMENT_DOCS, SEGMENT_BYTES = 8192, 8_000_000
ITEMS = 1024
#: Stretches are scored together, up to so many documents, before the threshold is looked at again.
DOCS_AT_ONCE = 1024
#: Bytes of terms to themselves, A-Z lower-cased, all others to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Stands for the row of a segment that holds its documents; no term is empty.
_DOCS = b""

_INDEX = "segment long, term binary, n long, block_last binary, block_max binary, block_at binary, payload binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def length_measure(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the low ones first, the eighth bit set on all but a value's last byte; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    at = np.flatnonzero(last)
    if len(at) == len(data):
        return data.astype(np.int64)
    first = np.r_[0, at[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, at - first + 1)
    return np.add.reduceat((data.astype(np.int64) & 127) << 7 * place, first)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = [len(terms_of(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["docs", "terms"])

    counts = bounded_batches(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "docs long, terms long")
    found = counts.agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def _segment(number: int, ids: list[int], lists: list[list[bytes]], n_docs: int, n_terms: int):
    """The rows of one segment; documents are numbered by ascending id."""
    import pyarrow as pa

    order = np.argsort(np.array(ids, np.int64), kind="stable")
    ids = np.array(ids, np.int64)[order]
    lengths = np.array([len(lists[i]) for i in order], np.int64)
    m = length_measure(lengths, n_docs, n_terms)
    numbers: dict[bytes, int] = {}
    term = np.array([numbers.setdefault(t, len(numbers)) for i in order for t in lists[i]], np.int64)
    both, tf = np.unique(term * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = both // len(ids), both % len(ids)
    # blocks: BLOCK postings of one term each
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    count = np.diff(np.r_[first, len(term)])
    place = np.arange(len(term)) - np.repeat(first, count)
    opens = place % BLOCK == 0
    starts = np.flatnonzero(opens)
    ends = np.r_[starts[1:], len(term)] - 1
    step = np.where(opens, doc, np.diff(doc, prepend=0))
    data, size = packed(np.column_stack([step, tf]).ravel())
    size = size.reshape(-1, 2).sum(axis=1)
    block_bytes = np.add.reduceat(size, starts)
    blocks = -(-count // BLOCK)
    term_bytes = np.add.reduceat(size, first)
    of_term = np.repeat(np.arange(len(first)), blocks)
    block_at = np.cumsum(block_bytes) - block_bytes - np.repeat(np.cumsum(term_bytes) - term_bytes, blocks)
    most = np.maximum.reduceat(impact(tf, m[doc]), starts)

    def cut(values: np.ndarray, sizes: np.ndarray):
        at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])

    per_term = lambda values: cut(values.astype(np.uint32).view(np.uint8), np.bincount(of_term, minlength=len(first)) * 4)
    rows = [pa.array(np.full(len(first), number)), pa.array(list(numbers), pa.binary()), pa.array(count), per_term(doc[ends]), per_term(most), per_term(block_at), cut(data, term_bytes)]
    names = ["segment", "term", "n", "block_last", "block_max", "block_at", "payload"]
    for k in range(0, len(first), 65536):
        yield pa.RecordBatch.from_arrays([r.slice(k, 65536) for r in rows], names)
    one = [[number], [_DOCS], [len(ids)], [ids.tobytes()], [m.tobytes()], [b""], [b""]]
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if isinstance(v[0], int) else pa.binary()) for v in one], names)


def index_of(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, a row for each term of each segment and one for the segment's documents; to be written before it is read twice."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        lists: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                size = sum(map(len, found)) + len(found)
                if ids and (len(ids) >= SEGMENT_DOCS or held + size > SEGMENT_BYTES):
                    yield from _segment(part << 32 | seen, ids, lists, n_docs, n_terms)
                    ids, lists, held, seen = [], [], 0, seen + 1
                ids.append(doc_id)
                lists.append(found)
                held += size
        if ids:
            yield from _segment(part << 32 | seen, ids, lists, n_docs, n_terms)

    d = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(d).mapInArrow(run, _INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """chunk, term, uses (item, times): which items of a chunk use a term how often."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(i, t, n) for i, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True) for t, n in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "times"])

    chosen = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    used = bounded_batches(chosen).mapInArrow(run, "item long, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    chunks = max(1, -(-chosen.count() // ITEMS))
    used = used.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("long"))
    return used.groupBy("chunk", "term").agg(F.array_sort(F.collect_list(F.struct("item", "times"))).alias("uses"))


class Postings:
    """A term's blocks in one segment; a block is decompressed when it is first read."""

    def __init__(self, row: dict):
        self.last, self.most, self.at = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("block_last", "block_max", "block_at"))
        self.payload, self.opened = np.frombuffer(row["payload"], np.uint8), {}

    def block(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and impacts."""
        if k not in self.opened:
            end = self.at[k + 1] if k + 1 < len(self.at) else len(self.payload)
            values = unpacked(self.payload[self.at[k] : end])
            docs = np.cumsum(values[::2])
            self.opened[k] = docs, impact(values[1::2], m[docs])
        return self.opened[k]

    def add(self, total: np.ndarray, wanted: np.ndarray, weight: int, m: np.ndarray) -> None:
        """Adds to the total of each wanted document what this term gives it; blocks without any stay compressed."""
        for k in np.unique(np.searchsorted(self.last, wanted)).tolist():
            if k < len(self.last):
                docs, impacts = self.block(k, m)
                at = np.minimum(np.searchsorted(wanted, docs), len(wanted) - 1)
                here = wanted[at] == docs
                total[at[here]] += weight * impacts[here]


def search(terms: list[tuple[Postings, int]], m: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best documents of ``best`` and of this segment, highest first, equal ones by ascending id.
    terms: postings with their weight times how often the query has the term."""
    # stretch s holds the documents beyond the end before it, up to ends[s]; in it no term changes its block. A term of one
    # block is read at once: each of its documents is a stretch (a pivot), and between them the term adds nothing to the bound
    single = [(*p.block(0, m), weight) for p, weight in terms if len(p.last) == 1]
    ends = np.unique(np.concatenate([*(p.last for p, _ in terms if len(p.last) > 1), *(d for d, _, _ in single), *(d - 1 for d, _, _ in single)]))
    ends = ends[ends >= 0]
    bound = np.zeros(len(ends), np.int64)
    for p, weight in terms:
        if len(p.last) > 1:
            current = np.searchsorted(p.last, ends)
            inside = current < len(p.last)
            bound[inside] += weight * p.most[current[inside]]
    for docs, impacts, weight in single:
        bound[np.searchsorted(ends, docs)] += weight * impacts
    opens = np.r_[0, ends[:-1] + 1]
    width = ends - opens + 1
    scores, found = best
    primed = False
    while True:
        # shallow move: on to the stretches in which a score of the k-th or more is possible (of equal scores the smaller id stays)
        least = int(scores[k - 1]) if len(scores) >= k else 1
        able = np.flatnonzero(bound >= least)
        if not len(able):
            return scores, found
        if not primed:  # the most promising stretches first, so that there is a threshold to begin with
            able, primed = np.sort(able[np.argsort(-bound[able], kind="stable")[:k]]), True
        able = able[: max(1, int(np.searchsorted(np.cumsum(width[able]), DOCS_AT_ONCE)))]
        bound[able] = -1
        sizes = width[able]
        wanted = np.arange(sizes.sum()) + np.repeat(opens[able] - (np.cumsum(sizes) - sizes), sizes)
        total = np.zeros(len(wanted), np.int64)
        for p, weight in terms:
            p.add(total, wanted, weight, m)
        good = np.flatnonzero(total >= least)
        if len(good):
            scores, found = np.concatenate([scores, total[good]]), np.concatenate([found, ids[wanted[good]]])
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: each task's k best of every item. rows: chunk, segment, term, weight, uses and the index columns."""

    def run(batches):
        import pyarrow as pa

        from foliograph.llm.jaccard_join import _groups

        nothing = np.zeros(0, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in _groups(batches, 2):
            found = t.to_pylist()
            own = next(r for r in found if r["term"] == _DOCS)
            ids, m = np.frombuffer(own["block_last"], np.int64), np.frombuffer(own["block_max"], np.int64)
            queries: dict[int, list[tuple[Postings, int]]] = {}
            for r in found:
                if r["term"] != _DOCS:
                    postings = Postings(r)
                    for use in r["uses"]:
                        queries.setdefault(use["item"], []).append((postings, r["weight"] * use["times"]))
            for item, terms in queries.items():
                best[item] = search(terms, m, ids, best.get(item, (nothing, nothing)), k)
        for item, (scores, docs) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item)), pa.array(docs), pa.array(scores)], ["item", "doc_id", "score"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "chunk", "segment").sortWithinPartitions("chunk", "segment")
    return bounded_batches(dealt).mapInArrow(run, "item long, doc_id long, score long")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of every item (item_id, text) with a score above 0."""
    docs = docs.filter("doc_id IS NOT NULL")
    n_docs, n_terms = corpus_counts(docs)
    index = written(index_of(docs, n_docs, max(1, n_terms)), "postings")
    wanted = written(item_terms(items), "item-terms")
    df = index.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = wanted.join(df, "term").select("chunk", "term", "uses", weight(n_docs, F.col("df")).alias("weight"))
    headers = wanted.select("chunk").distinct().select("chunk", F.lit(_DOCS).alias("term"), F.lit(None).cast(wanted.schema["uses"].dataType).alias("uses"), F.lit(0).cast("long").alias("weight"))
    rows = index.join(weighed.union(headers), "term").select("chunk", "segment", "term", "weight", "uses", "block_last", "block_max", "block_at", "payload")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = _searched(rows, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
uses AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
measures AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM lengths, corpus),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM uses) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM uses JOIN weights USING (term) JOIN postings USING (term) JOIN measures USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
