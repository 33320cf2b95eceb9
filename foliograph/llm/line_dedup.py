"""Line deduplication across documents, native DataFrame operations only.

Method: lines are reduced to 128-bit hashes of their keys, range-partitioned by
hash and sorted by document and position within it; a window streams over each
hash and marks what comes after the first document. Only run-length keep
bitmaps, one per document with drops, leave the operator.

Skew: keys that make up more than 1/HOT_KEYS of all repeated lines (so at most
HOT_KEYS of them exist, which bounds the broadcast) are resolved on the map side
against their first document, which partial aggregation has already found.

Defined results: a null or empty text is one empty line; a null doc_id counts as
one document after all others; repeated rows of one doc_id are one document as
far as dropping goes, and each row gets its bitmap; an empty table gives an
empty table; other columns of the input are ignored, or kept by ``deduplicated``,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import shuffle_partitions, written

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY = 10
HOT_KEYS = 1024
#: Stands for a null doc_id: after every other document.
LAST_ID = 2**63 - 1


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where all characters take one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (never null), row_hash, text, lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def _line_hashes(keyed: DataFrame, min_key: int) -> DataFrame:
    lines = keyed.select("doc", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "row_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    return lines.select("doc", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """One row per document that loses lines: doc, row_hash, n_dropped and ``runs``, an array of (start, length) of dropped lines."""
    spark = docs.sparkSession
    # hashes are written once: counting, sampling for ranges and dealing read these narrow rows, not the texts
    lines = written(_line_hashes(_keyed(docs, id_col, text_col), min_key), "line-hashes")
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    repeated = written(counted.filter("first_doc < last_doc").select("h1", "h2", "n", "first_doc"), "line-keys")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.filter(F.col("n") * HOT_KEYS > total)  # fewer than HOT_KEYS rows, as their n add up to total at most

    tagged = lines.join(F.broadcast(hot.select("h1", "h2", F.col("first_doc").alias("hot_first"))), ["h1", "h2"], "left")
    hot_drops = tagged.filter(F.col("hot_first") < F.col("doc")).select("doc", "row_hash", "pos")
    cold = tagged.filter(F.col("hot_first").isNull()).select("h1", "h2", "doc", "row_hash", "pos")
    cold = cold.repartitionByRange(shuffle_partitions(spark), "h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    cold_drops = cold.withColumn("first_doc", F.first("doc").over(stream)).filter("first_doc < doc").select("doc", "row_hash", "pos")

    drops = hot_drops.union(cold_drops).groupBy("doc", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    runs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(r["s"].alias("start"), (r["e"] - r["s"] + 1).alias("length")))
    return drops.select("doc", "row_hash", F.size("at").alias("n_dropped"), runs.alias("runs"))


def _kept_lines(text: Column, runs: Column) -> Column:
    """The lines of ``text`` outside ``runs``; linear in the number of lines."""
    gap = lambda r, i: r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])
    flags = F.flatten(F.transform(runs, lambda r, i: F.concat(F.array_repeat(F.lit(True), gap(r, i)), F.array_repeat(F.lit(False), r["length"]))))
    numbered = F.arrays_zip(F.split(text, "\n", -1).alias("line"), flags.alias("keep"))
    return F.transform(F.filter(numbered, lambda x: F.coalesce(x["keep"], F.lit(True))), lambda x: x["line"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs``; see the module's rules."""
    rows = _keyed(docs, id_col, text_col)
    maps = drop_bitmaps(docs, id_col, text_col, min_key)
    both = rows.join(maps, ["doc", "row_hash"], "left")
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col("text"), F.col("runs")), "\n"))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return both.select(
        F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def deduplicated(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The rows and columns of ``docs`` (doc_id, text, any others) with repeated lines dropped from text; n_chars follows where it is there."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("row_hash"))
    both = rows.join(drop_bitmaps(docs.select("doc_id", "text"), min_key=min_key).select("doc", "row_hash", "runs"), ["doc", "row_hash"], "left")
    old = F.col("row")["text"]
    both = both.select("row", F.when(F.col("runs").isNull(), old).otherwise(F.array_join(_kept_lines(old, F.col("runs")), "\n")).alias("kept"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
