"""Report tables: shortfalls by reason, gaps by tier, decisions to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shortfalls(skipped: DataFrame, reason: str, item: str, examples: int = 3) -> DataFrame:
    """reason, n, examples: how many items each reason keeps back and its first few, in order.

    The examples are found by rank, which Spark cuts to a few rows a task before the shuffle; a reason's items are never gathered."""
    n = skipped.groupBy(reason).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(reason).orderBy(item))
    few = skipped.select(reason, item).withColumn("place", place).filter(F.col("place") <= examples)
    few = few.groupBy(reason).agg(F.array_sort(F.collect_list(F.struct("place", F.col(item).cast("string").alias("item")))).alias("xs"))
    return n.join(few, reason).select(reason, "n", F.array_join(F.transform("xs", lambda x: x["item"]), ",").alias("examples"))


def gaps(decisions: DataFrame) -> DataFrame:
    """tier, rule, n, n_pages of decisions (page_id, tier, rule) that lost something, the widest first by n."""
    return decisions.groupBy("tier", "rule").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def unreviewed(decisions: DataFrame) -> DataFrame:
    """Decisions that ask for a review and have none."""
    return decisions.filter(F.coalesce("needs_review", F.lit(False)) & (F.coalesce("reviewer", F.lit("")) == ""))


def rerun_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """page_id of outputs (page_id, output) that two runs over the same input made differently."""
    from foliograph.operators.reconcile import drift

    sides = [x.select("page_id", F.sha2("output", 256).alias("h")) for x in (first, second)]
    return drift(*sides, "page_id", "h").filter("status <> 'same'")


def canary(searches: DataFrame, pages: DataFrame, checked: int = 5) -> DataFrame:
    """One row: n_checked, n_failed, passed of the first few searches (search_id, page_id, phrase): whether the page holds the phrase.
    Nothing checked is no pass."""
    few = searches.orderBy("search_id").limit(checked)
    hit = few.join(pages.select("page_id", "text"), "page_id", "left").withColumn("ok", F.coalesce(F.col("text").contains(F.col("phrase")), F.lit(False)))
    return hit.agg(F.count("*").alias("n_checked"), F.count_if(~F.col("ok")).alias("n_failed"), ((F.count("*") > 0) & (F.count_if(~F.col("ok")) == 0)).alias("passed"))
