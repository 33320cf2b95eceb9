"""Headings: outlines, numbered slugs, and whether one outline follows another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text


def numbered_slugs(headings: DataFrame) -> DataFrame:
    """page_id, pos, slug: repeats on a page get -1, -2 and so on, in order."""
    h = headings.withColumn("slug", text.heading_slug(F.col("heading")))
    again = F.row_number().over(Window.partitionBy("page_id", "slug").orderBy("pos")) - 1
    return h.withColumn("n", again).select("page_id", "pos", F.when(F.col("n") > 0, F.concat_ws("-", "slug", "n")).otherwise(F.col("slug")).alias("slug"))


def outlines(headings: DataFrame) -> DataFrame:
    """page_id, n_headings, outline: level:heading in order, joined by |. A heading equal to the one before it is dropped."""
    before = F.lag(F.struct("level", "heading")).over(Window.partitionBy("page_id").orderBy("pos"))
    kept = headings.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.struct("level", "heading")))
    rows = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "level", "heading").alias("h")))).alias("hs"))
    return rows.select("page_id", F.size("hs").cast("long").alias("n_headings"), F.array_join(F.transform("hs", lambda h: h["h"]), "|").alias("outline"))


def in_order(wanted: Column, shown: Column) -> Column:
    """Whether the array ``wanted`` is a subsequence of ``shown``: each step takes the next match, so it is one pass."""
    reached = F.aggregate(shown, F.lit(0), lambda at, x: F.when((at < F.size(wanted)) & (F.get(wanted, at) == x), at + 1).otherwise(at))
    return reached == F.size(wanted)
