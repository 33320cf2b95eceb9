"""Gates: checks that pass if a query finds nothing, and the decision over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gate(name: str, findings: DataFrame, samples: int = 0, detail: str | None = None) -> DataFrame:
    """One row: gate, status, count and, if asked for, the first ``samples`` details in order."""
    counted = findings.agg(F.count("*").alias("count"))
    out = counted.select(F.lit(name).alias("gate"), F.when(F.col("count") > 0, "fail").otherwise("pass").alias("status"), "count")
    if samples and detail:
        some = findings.select(F.col(detail).cast("string").alias("x")).orderBy("x").limit(samples).agg(F.array_sort(F.collect_list("x")).alias("samples"))
        out = out.join(some.withColumn("gate", F.lit(name)), "gate")
    return out


def rollup(spark: SparkSession, found: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """gate, status, count of every required gate; one without findings to look at fails, it never passes."""
    rows = reduce(DataFrame.union, [gate(name, df) for name, df in found.items()])
    asked = spark.createDataFrame([(g,) for g in required], "gate string")
    return asked.join(rows, "gate", "left").select("gate", F.coalesce("status", F.lit("fail")).alias("status"), "count")


def released(gates: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """One row: released and the gates that stand against it, without those that are waived (gate)."""
    against = gates.filter("status <> 'pass'")
    if waivers is not None:
        against = against.join(waivers.select("gate"), "gate", "left_anti")
    return against.agg((F.count("*") == 0).alias("released"), F.array_join(F.array_sort(F.collect_list("gate")), ",").alias("blockers"))


def write(gates: DataFrame, path: str) -> None:
    """The report as JSON lines."""
    gates.coalesce(1).write.mode("overwrite").json(path)


def inapplicable(sites: DataFrame) -> DataFrame:
    """site, gate, reason: gates that can prove nothing about a source (site, kind, publishes_markdown): files have no rendered page to
    compare with and no page furniture, and where no Markdown is published the rendered page is all there is."""
    of_files = F.array(F.struct(F.lit("html-reconciliation").alias("gate"), F.lit("no rendered pages").alias("reason")), F.struct(F.lit("chrome-absent").alias("gate"), F.lit("no page furniture").alias("reason")))
    of_pages = F.array(F.struct(F.lit("source-content-exact").alias("gate"), F.lit("no published Markdown").alias("reason")))
    found = F.when(F.col("kind") != "url", of_files).when(~F.coalesce("publishes_markdown", F.lit(False)), of_pages)
    return sites.select("site", F.explode(found).alias("x")).select("site", "x.*")
