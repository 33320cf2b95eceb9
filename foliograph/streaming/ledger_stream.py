"""Streams over append-only tables: incremental ledgers and windowed counts. An extension: the batch operators are the same queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.workspace import shared_dir


def read(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A Parquet folder or file as a stream with the schema it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path}*")  # a glob, as the path may be one file


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """window_start, by, n_events, total_value over tumbling windows; rows later than ``late`` behind the newest are left out."""
    t = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    w = t.groupBy(F.window("__t", width).alias("w"), by).agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
    return w.select(F.col("w.start").alias("window_start"), by, "n_events", "total_value")


def first_seen(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once while it is younger than ``late``."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(key).drop("__t")


def run_once(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Everything there is now through ``stream`` to a table below ``base``, then that table. Called again with the same ``base``, a
    run that broke off goes on from its checkpoint and a finished one reads only what has come since; files are committed once.
    Without ``base`` the run stands alone, in a folder of its own."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        # a complete result replaces the last one under its own epoch, so a repeated epoch writes the same folder again
        def replace(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        q = stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode != "append":
        out = out.filter(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).drop("epoch")
    return out


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events by type, through a stream."""
    counts = windowed_counts(read(spark, f"{sf_dir}/events.parquet"))
    done = run_once(counts, "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n_events", F.round("total_value", 2).alias("total_value"))


QUERIES = {"events_hourly": events_hourly}
ORACLES = {
    "events_hourly": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n_events, round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2"""
}
