"""Passages: which segments of a source are missing from a copy, and which texts hold a passage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions import text as tx
from foliograph.workspace import written

#: So many passages' hashes are sent to where texts are.
FEW = 50_000
SPACE = r"[ \t\r\n\x0B\f]+"


def segments(rows: DataFrame, key: str, text: str, least: int = 12) -> DataFrame:
    """key, pos (the line's number from 0), segment: normalised lines of at least ``least`` characters."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.select(key, F.col("pos").cast("long").alias("pos"), tx.prose(F.col("line")).alias("segment")).filter(F.length("segment") >= least)


def missing_segments(source: DataFrame, copy: DataFrame, key: str, text: str) -> DataFrame:
    """Segments (key, pos, segment) that are no part of the copy's text of the same key, normalised; all, if the copy lacks the key."""
    hay = copy.select(key, tx.prose(F.col(text)).alias("hay"))
    # a text meets its segments once, not once for each of them
    rest = [c for c in source.columns if c != key]
    held = source.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("own")).join(hay, key, "left")
    missing = F.when(F.col("hay").isNull(), F.col("own")).otherwise(F.filter("own", lambda s: ~F.contains("hay", s["segment"])))
    return held.select(key, F.explode(missing).alias("s")).select(*[F.col(c) if c == key else F.col("s")[c].alias(c) for c in source.columns])


def _words(column: str):
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), SPACE, " ")), " ")


def holders(rows: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, lead: int = 6) -> DataFrame:
    """key, item: texts that hold a whole passage, compared by lower-case words.

    A passage meets texts on the hash of its first ``lead`` words (or all, if it has fewer), an equi-join on every window of as many
    words of the texts; the pair is then compared in full. Hashes of up to FEW passages, which are counted first, go to where the texts
    are, so windows are cut down before anything moves; then only texts that some passage meets do."""
    p = items.select(item, F.array_join(_words(passage), " ").alias("needle"), _words(passage).alias("w")).filter("needle <> ''")
    p = p.withColumn("n", F.least(F.size("w"), F.lit(lead))).select(item, "needle", "n", F.xxhash64(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")).alias("h"))
    by_size = p.groupBy("n").agg(F.count("*").alias("times")).collect()  # at most ``lead`` rows
    sizes, few = [r["n"] for r in by_size], sum(r["times"] for r in by_size) <= FEW
    t = rows.select(key, _words(text).alias("w"))
    out = None
    for n in sizes:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: i <= F.size("w") - n + 1)  # noqa: B023
        hashes = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))))  # noqa: B023
        starts_of = p.filter(F.col("n") == n).select(item, "h")
        met = t.select(key, F.explode(hashes).alias("h")).join(F.broadcast(starts_of) if few else starts_of, "h").select(key, item)
        out = met if out is None else out.union(met)
    if out is None:
        types = [rows.schema[key], items.schema[item]]
        return rows.sparkSession.createDataFrame([], T.StructType(types))
    out = written(out.distinct(), "met")
    whole = rows.join(out.select(key).distinct(), key, "left_semi").select(key, F.array_join(_words(text), " ").alias("hay"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    both = out.join(whole, key).join(p.select(item, "needle"), item)
    return both.filter(F.contains(pad("hay"), pad("needle"))).select(key, item)


def missing_code(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Code blocks (page_id, code_hash) of a source whose text the copy of the page has nowhere."""
    return source.select("page_id", "code_hash").distinct().join(copy.select("page_id", "code_hash"), ["page_id", "code_hash"], "left_anti")
