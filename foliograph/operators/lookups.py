"""Rows that look something up by a key which many of them may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import written

#: A table of no more rows is sent to the rows that look things up in it.
SMALL = 10_000


def by_hot_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with what known (each key once) says of their key, or nulls. Keys that many rows share, fewer than 1,024, are looked up by
    broadcast where those rows are, and rows without a key stay there, so that no task gets all rows of one key."""
    most = max(1_000, rows.count() // 1_024)
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > most)
    hot = written(counted.select(key, F.lit(True).alias("__hot")), "hot")
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("__hot", F.col("__hot").isNotNull() | F.col(key).isNull())
    met = marked.filter("NOT __hot").join(known.hint("merge"), key, "left")
    of_hot = known.join(F.broadcast(hot.select(key)), key, "left_semi")
    return met.union(marked.filter("__hot").join(F.broadcast(of_hot), key, "left")).drop("__hot")


def looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """As ``by_hot_keys``; a small table is broadcast as a whole, and then the rows stay where they are."""
    if known.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(known), key, "left")
    return by_hot_keys(rows, known, key)
