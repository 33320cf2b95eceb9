"""Two navigations of one site merged into one, in which the first keeps its order."""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.operators.trees import with_paths
from foliograph.workspace import bounded_batches, written

#: Stands behind every place among siblings.
_LAST = 2**31 - 1


def _keyed(nodes: DataFrame) -> DataFrame:
    """Nodes with parent ('' at the top), same (what tells a node in both navigations: its page, else its label), pos among siblings, and
    again: whether an earlier sibling is the same."""
    same = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("p:"), "page_id")).otherwise(F.concat(F.lit("g:"), F.coalesce("label", F.lit(""))))
    n = nodes.select("node_id", F.coalesce("parent_id", F.lit("")).alias("parent"), "kind", "label", F.col("page_id").cast("string").alias("page_id"), "ord").withColumn("same", same)
    among = Window.partitionBy("parent").orderBy("ord", "node_id")
    again = F.row_number().over(Window.partitionBy("parent", "same").orderBy("ord", "node_id")) > 1
    return n.withColumns({"pos": F.row_number().over(among), "again": again})


def _matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """first_id, second_id of nodes that are the same beneath parents that are; from the top, one join for each level."""
    a, b = (x.filter("NOT again") for x in (a, b))
    one = lambda x, name: x.select(F.col("node_id").alias(f"{name}_id"), F.col("parent").alias(f"{name}_up"), "same")
    a, b = one(a, "first"), one(b, "second")
    level = a.filter("first_up = ''").join(b.filter("second_up = ''"), "same").select("first_id", "second_id")
    out = None
    while True:
        level = written(level, "nav-level")
        if out is not None and not level.take(1):
            return out
        out = level if out is None else out.union(level)
        ups = level.select(F.col("first_id").alias("first_up"), F.col("second_id").alias("second_up"))
        level = a.join(ups, "first_up").join(b, ["second_up", "same"]).select("first_id", "second_id")


def longest_rising(values: list[int]) -> list[int]:
    """The places of a longest rising run of the values (not of neighbours); of several the one that ends lowest."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _anchors(pairs: DataFrame) -> DataFrame:
    """up, second_pos, first_pos: of the pairs of each parent a longest run that both navigations have in the same order.

    Where the orders agree, that is all pairs, told by a window; only parents whose orders differ are looked at as a whole, two
    numbers a child."""
    falls = F.lag("second_pos").over(Window.partitionBy("up").orderBy("first_pos")) > F.col("second_pos")
    p = written(pairs.withColumn("falls", F.coalesce(falls, F.lit(False))), "pairs")
    mixed = p.filter("falls").select("up").distinct()
    agreed = p.join(mixed, "up", "left_anti").select("up", "second_pos", "first_pos")

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        for up, of in groupby(rows(), key=lambda r: r[0]):
            of = list(of)
            kept = [of[i] for i in longest_rising([r[2] for r in of])]
            yield pa.RecordBatch.from_arrays([pa.array([up] * len(kept)), pa.array([r[2] for r in kept], pa.int32()), pa.array([r[1] for r in kept], pa.int32())], ["up", "second_pos", "first_pos"])

    ordered = p.join(mixed, "up", "left_semi").select("up", "first_pos", "second_pos").repartition("up").sortWithinPartitions("up", "first_pos")
    return agreed.union(bounded_batches(ordered).mapInArrow(run, "up string, second_pos int, first_pos int"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """path, side (both, first, second), kind, label, page_id, first_id, second_id of two navigations (node_id, parent_id, kind, label,
    page_id, ord) of one site.

    Nodes are the same if their parents are and they name one page, or no page and one label; of the same siblings the first counts.
    The first navigation keeps its order, and what it states of a node holds. A node that only the second has stands where the second
    has it: ahead of the next sibling that both have in the same order, behind what else stands there. A page the first navigation
    places anywhere is not placed again, nor one that a new place further up already has. Where one side has a page and the other a
    group that opens it, the node is a group. Node ids are unique in each navigation."""
    a, b = written(_keyed(first), "nav"), written(_keyed(second), "nav")
    pairs = written(_matched(a, b), "nav-pairs")
    ids = b.join(pairs, F.col("node_id") == F.col("second_id"), "left").select("node_id", "parent", "kind", "label", "page_id", "pos", "same", "first_id")
    ups = pairs.select(F.col("second_id").alias("parent"), F.col("first_id").alias("up")).union(pairs.sparkSession.createDataFrame([("", "")], "parent string, up string"))
    ids = written(ids.join(ups, "parent", "left"), "nav-second")
    both = ids.filter("first_id IS NOT NULL").select("up", F.col("pos").alias("second_pos"), "first_id").join(a.select(F.col("node_id").alias("first_id"), F.col("pos").alias("first_pos")), "first_id")
    anchored = ids.filter("up IS NOT NULL").join(_anchors(both.select("up", "first_pos", "second_pos")).withColumnRenamed("second_pos", "pos"), ["up", "pos"], "left")
    following = F.last("first_pos", ignorenulls=True).over(Window.partitionBy("up").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    new = anchored.withColumn("before", F.coalesce(following, F.lit(_LAST))).filter("first_id IS NULL")
    new = new.select("node_id", F.when(F.col("up") == "", "").otherwise(F.concat(F.lit("a:"), "up")).alias("parent"), F.array("before", F.lit(0), "pos").alias("key"), "kind", "label", "page_id")
    beneath = ids.filter("first_id IS NULL AND up IS NULL").select("node_id", F.concat(F.lit("b:"), "parent").alias("parent"), F.array("pos", F.lit(1), F.lit(0)).alias("key"), "kind", "label", "page_id")
    only = new.union(beneath).join(a.filter("page_id IS NOT NULL").select("page_id").distinct().withColumn("placed", F.lit(True)), "page_id", "left")
    only = only.filter("kind <> 'page' OR placed IS NULL").select(F.concat(F.lit("b:"), "node_id").alias("node"), "parent", "key", F.lit("second").alias("side"), "kind", "label", "page_id", F.lit(None).cast("string").alias("first_id"), F.col("node_id").alias("second_id"))
    more = b.select(F.col("node_id").alias("second_id"), F.col("kind").alias("other_kind"), F.col("page_id").alias("other_page"), F.col("label").alias("other_label"))
    kept = a.join(pairs, F.col("node_id") == F.col("first_id"), "left").drop("first_id").join(more, "second_id", "left")
    kept = kept.select(
        F.concat(F.lit("a:"), "node_id").alias("node"), F.when(F.col("parent") == "", "").otherwise(F.concat(F.lit("a:"), "parent")).alias("parent"), F.array("pos", F.lit(1), F.lit(0)).alias("key"),
        F.when(F.col("second_id").isNull(), "first").otherwise("both").alias("side"), F.when((F.col("kind") == "page") & (F.col("other_kind") != "page"), F.col("other_kind")).otherwise(F.col("kind")).alias("kind"),
        F.coalesce("label", "other_label").alias("label"), F.coalesce("page_id", "other_page").alias("page_id"), F.col("node_id").alias("first_id"), "second_id")
    tree = written(with_paths(kept.union(only), []), "nav-merged")
    # of new places of one page the first in reading order stays; pages hold nothing, so only the numbers of what follows change
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("path"))
    again = tree.filter("side = 'second' AND kind = 'page'").withColumn("turn", turn).filter("turn > 1").select("node")
    left = tree.join(again, "node", "left_anti").withColumnRenamed("path", "key")
    return with_paths(left, []).select("path", "side", "kind", "label", "page_id", "first_id", "second_id")
