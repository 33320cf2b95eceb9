"""The ledger of dispositions: append-only rows (seq, page_id, node_id, kind, reviewer), of which the last by node counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last(ledger: DataFrame) -> DataFrame:
    """The last row of each (page_id, node_id). An aggregate, not a window: partial results meet, whatever a node's history."""
    rest = [c for c in ledger.columns if c not in ("page_id", "node_id")]
    got = ledger.groupBy("page_id", "node_id").agg(F.max_by(F.struct(*rest), F.struct("seq", "kind")).alias("x"))
    return got.select("page_id", "node_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def coverage(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: how many source nodes (page_id, node_id) have each disposition, or none."""
    both = nodes.select("page_id", "node_id").distinct().join(last(ledger), ["page_id", "node_id"], "left")
    n = lambda condition, name: F.count_if(condition).alias(name)
    kind = F.col("kind")
    return both.agg(
        F.count("*").alias("total"),
        n(kind == "identical", "identical"),
        n(kind == "transformed", "transformed"),
        n(kind == "excluded", "excluded"),
        n((kind == "excluded") & F.col("reviewer").isNull(), "unattributed"),
        n(kind == "quarantined", "quarantined"),
        n(kind.isNull(), "missing"),
    )


def missing(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Source nodes without a disposition."""
    return nodes.select("page_id", "node_id").distinct().join(ledger.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")


def unattributed_exclusions(ledger: DataFrame) -> DataFrame:
    return last(ledger).filter((F.col("kind") == "excluded") & (F.coalesce("reviewer", F.lit("")) == "")).select("page_id", "node_id", "seq")


def effective_exclusions(ledger: DataFrame) -> DataFrame:
    return last(ledger).filter(F.col("kind") == "excluded").select("page_id", "node_id")


def without_subtrees(blocks: DataFrame, excluded: DataFrame) -> DataFrame:
    """blocks (page_id, node_id, path) without excluded nodes and all beneath them: a block meets an exclusion on any prefix of its path."""
    roots = blocks.join(excluded.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi").select("page_id", F.col("path").alias("prefix"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    gone = blocks.select("page_id", "node_id", F.explode(prefixes).alias("prefix")).join(roots, ["page_id", "prefix"], "left_semi")
    return blocks.join(gone.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_anti")


def unmatched_exclusions(blocks: DataFrame, excluded: DataFrame) -> DataFrame:
    return excluded.join(blocks.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")


def quarantine_counts(ledger: DataFrame) -> DataFrame:
    """kind, n: how many nodes each disposition holds now."""
    return last(ledger).groupBy("kind").agg(F.count("*").alias("n"))
