"""Whether a conversion kept what its source says: declared losses, snapshots, first differences, running order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text

#: Properties that change how a block looks and not what it says.
VISUAL = ("align", "className", "height", "style", "width")

def declared_losses(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """blocks (page_id, seq, path, name, props) without what rules (name, action, dropped) give up, with ``depth``, the blocks still above.

    ``drop`` loses a block with all beneath it, ``unwrap`` the block alone; ``dropped`` names properties that go. Names in rules
    are unique; blocks without a name or a rule stay. Only ids and paths are exploded: a block meets a rule's block on a prefix."""
    ruled = blocks.join(rules.select("name", "action", "dropped"), "name", "left")
    hit = ruled.filter("action IN ('drop', 'unwrap')").select("page_id", F.col("path").alias("prefix"), "action")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    above = blocks.select("page_id", "seq", F.explode(prefixes).alias("prefix")).join(hit, ["page_id", "prefix"])
    lost = above.groupBy("page_id", "seq").agg(F.bool_or(F.col("action") == "drop").alias("gone"), F.count_if(F.col("action") == "unwrap").alias("unwrapped"))
    kept = ruled.join(lost, ["page_id", "seq"], "left").filter("NOT coalesce(gone, false) AND coalesce(action, '') <> 'unwrap'")
    dropped = F.coalesce("dropped", F.array().cast("array<string>"))
    props = F.map_filter("props", lambda k, _: ~F.array_contains(dropped, k))
    return kept.withColumns({"props": props, "depth": (F.size("path") - F.coalesce("unwrapped", F.lit(0))).cast("int")}).drop("action", "dropped", "gone", "unwrapped")


def snapshot(blocks: DataFrame, visual: tuple[str, ...] = VISUAL) -> DataFrame:
    """page_id, place, field, value of blocks (page_id, path, kind, text, props): what each says, in reading order, however deep it lies."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("path")) - 1
    said = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*visual) & v.isNotNull())
    own = F.array(F.struct(F.lit("kind").alias("key"), F.col("kind").alias("value")), F.struct(F.lit("text").alias("key"), text.prose(F.col("text")).alias("value")))
    more = F.transform(F.map_entries(said), lambda e: F.struct(F.concat(F.lit("props."), e["key"]).alias("key"), e["value"].alias("value")))
    rows = blocks.withColumn("place", place).select("page_id", "place", F.explode(F.concat(own, more)).alias("said"))
    return rows.select("page_id", "place", F.col("said.key").alias("field"), F.col("said.value").alias("value")).filter("value IS NOT NULL")


def first_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """page_id, place, field, first, second: where two snapshots of a page begin to differ; equal pages give no row."""
    key = ["page_id", "place", "field"]
    both = first.withColumnRenamed("value", "first").join(second.withColumnRenamed("value", "second"), key, "full_outer")
    differ = both.filter(~F.col("first").eqNullSafe(F.col("second")))
    least = differ.groupBy("page_id").agg(F.min(F.struct("place", "field", "first", "second")).alias("at"))
    return least.select("page_id", "at.*")


def running_order(segments: Column, rendered: Column) -> Column:
    """A struct (in_order, moved, absent, residual): how many of the segments follow one another in the rendered text, how many are
    elsewhere in it, how many nowhere, and how many of its characters lie between them. One pass; null arrays have no segments, null
    texts and null segments no counts. Searches start where the last one ended instead of counting characters from the text's
    beginning. An empty segment is found at the beginning, and the search goes on from there."""

    @F.udf(returnType="struct<in_order:int,moved:int,absent:int,residual:int>", useArrow=True)
    def in_order_of(segments, rendered):
        if not segments:
            return (0, 0, 0, None if rendered is None else len(rendered))
        if rendered is None:
            return (None, None, None, None)
        at = in_order = moved = absent = taken = 0
        for s in segments:
            if s is None:
                continue
            found = rendered.find(s, at) if s else 0
            if found >= 0:
                at, in_order, taken = found + len(s), in_order + 1, taken + len(s)
            elif rendered.find(s, 0, at + len(s) - 1) >= 0:
                moved += 1
            else:
                absent += 1
        counts = (None, None, None) if None in segments else (in_order, moved, absent)
        return (*counts, len(rendered) - taken)

    return in_order_of(segments, rendered)
