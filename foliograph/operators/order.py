"""Order-dependent operators: global places, even samples, runs, states along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from foliograph.workspace import bounded_batches, shuffle_partitions, written


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``place``, from 0, in the order of the given columns, which must be total.

    Rows are range-partitioned and numbered inside partitions; only the partitions' sizes meet. No task sees all rows."""
    parted = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    r = written(parted.withColumn("__id", own), "placed").withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = r.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__start"))
    return r.join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + F.col("__at")).drop("__part", "__id", "__at", "__start")


def placed_by_locale(rows: DataFrame, name: str, *then: str, locale: str = "UNICODE") -> DataFrame:
    """Rows with ``place``, from 0, in a locale's order of the column ``name``, then of others that make it total: accents after plain
    letters, small letters before capitals, digits before letters and one by one. Ranges and sorts compare by the collation."""
    return placed(rows.withColumn("__collated", F.collate(name, locale)), "__collated", *then).drop("__collated")


def even_sample(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """k rows spread evenly over the order: those at round(i * (n - 1) / (k - 1)), halves up; all rows, if they are no more."""
    r = placed(rows, *order)
    n = rows.count()
    if n <= k:
        return r
    wanted = {int((i * (n - 1)) / (k - 1) + 0.5) for i in range(k)} if k > 1 else {0}
    return r.filter(F.col("place").isin(sorted(wanted)))


def runs(rows: DataFrame, group: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Rows with ``run``: neighbours of a group with equal ``same`` columns share a number, from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    now = F.struct(*same)
    new = F.when(F.lag(now).over(w).eqNullSafe(now) | (F.row_number().over(w) == 1), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merged_runs(rows: DataFrame, group: list[str], order: str, same: list[str], text: str, separator: str = "\n") -> DataFrame:
    """One row for each run: first_at, n, and the texts joined in order."""
    r = runs(rows, group, [order], same)
    got = r.groupBy(*group, "run", *same).agg(F.min(order).alias("first_at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("ts"))
    return got.select(*group, "run", *same, "first_at", "n", F.array_join(F.transform("ts", lambda t: t["t"]), separator).alias(text))


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def fence_states(lines: DataFrame, key: str, fence: str = r"^[ ]{0,3}(`{3,}|~{3,})(.*)$") -> DataFrame:
    """lines (key, line_no, line) with ``fenced``: whether a line is inside a code fence or is one.

    A fence closes on the same character, at least as long, with nothing after it; so the state is folded along each text's lines."""
    mark, rest = F.regexp_extract("line", fence, 1), F.trim(F.regexp_extract("line", fence, 2))
    got = lines.withColumns({"mark": mark, "rest": rest}).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "mark", "rest"))).alias("ls"))

    def step(acc, x):
        is_open = acc["open"] != ""
        closes = is_open & (x["mark"] != "") & (x["rest"] == "") & (F.substring(x["mark"], 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(x["mark"]) >= F.length(acc["open"]))
        opens = ~is_open & (x["mark"] != "") & ~(x["mark"].startswith("`") & x["rest"].contains("`"))
        state = F.when(closes, F.lit("")).when(opens, x["mark"]).otherwise(acc["open"])
        return F.struct(state.alias("open"), F.array_append(acc["out"], is_open | opens).alias("out"))

    folded = F.aggregate("ls", F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("out")), step)["out"]
    zipped = got.select(key, F.explode(F.arrays_zip(F.col("ls"), folded.alias("fenced"))).alias("z"))
    return zipped.select(key, F.col("z.ls.line_no").alias("line_no"), F.col("z.ls.line").alias("line"), F.col("z.fenced").alias("fenced"))


def carried(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the last non-null ``value`` at or before each, in order: the agent a robots rule belongs to, the heading above a link."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def parents_by_indent(rows: DataFrame, group: list[str], order: str, indent: str) -> DataFrame:
    """Rows with ``parent``: the order of the nearest earlier row of the group that is indented less, null at the top.

    Groups are dealt to tasks and sorted; a task passes over its rows once with the open levels alone in memory, however deep the
    outline is and however many rows a group has."""
    of = [f"__of{k}" for k in range(len(group))]
    r = rows.withColumns(dict(zip(of, (F.col(c) for c in group), strict=True))).withColumns({"__o": F.col(order).cast("bigint"), "__i": F.col(indent).cast("bigint")})
    parted = r.repartition(shuffle_partitions(rows.sparkSession), *of).sortWithinPartitions(*of, "__o")
    kept = [*group, order, indent, *(c for c in rows.columns if c not in (*group, order, indent))]

    def run(batches):
        import pyarrow as pa

        now, stack = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in of), strict=True)
            parents = []
            for key, o, i in zip(keys, batch.column("__o").to_pylist(), batch.column("__i").to_pylist(), strict=True):
                if key != now:
                    now, stack = key, []
                while stack and (i is None or stack[-1][1] is None or stack[-1][1] >= i):
                    stack.pop()
                parents.append(stack[-1][0] if stack else None)
                stack.append((o, i))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(parents, pa.int64())], [*kept, "parent"])

    schema = StructType([*(rows.schema[c] for c in kept), StructField("parent", LongType())])
    return bounded_batches(parted).mapInArrow(run, schema)
