"""Operators over block tables (see sources.blocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text
from foliograph.workspace import written


def block_texts(blocks: DataFrame) -> DataFrame:
    """page_id, text: each page's block texts in order, one a line."""
    got = blocks.filter("text <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("ts"))
    return got.select("page_id", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("text"))


def outline(blocks: DataFrame) -> DataFrame:
    """page_id, headings: level:text in order."""
    h = blocks.filter("kind = 'heading'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "level", text.prose(F.col("text"))).alias("h")))).alias("hs"))
    return h.select("page_id", F.transform("hs", lambda x: x["h"]).alias("headings"))


def code_blocks(blocks: DataFrame) -> DataFrame:
    """page_id, seq, lang, code, code_hash; common indentation and trailing spaces are gone already."""
    return blocks.filter("kind = 'code'").select("page_id", "seq", "lang", F.col("text").alias("code"), F.sha2(F.trim(F.col("text"), F.lit("\n ")), 256).alias("code_hash"))


def table_signatures(blocks: DataFrame) -> DataFrame:
    """page_id, table_seq, signature: the normalised cells of each table, row by row; empty rows are left out."""
    cells = blocks.filter("kind = 'tableCell'").select("page_id", F.slice("path", F.lit(1), F.size("path") - 2).alias("table"), F.element_at("path", -2).alias("row"), F.element_at("path", -1).alias("cell"), text.prose(F.col("text")).alias("text"))
    rows = cells.groupBy("page_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("cs"))
    rows = rows.select("page_id", "table", "row", F.array_join(F.transform("cs", lambda c: c["text"]), "\x1f").alias("r")).filter(F.replace("r", F.lit("\x1f"), F.lit("")) != "")
    t = rows.groupBy("page_id", "table").agg(F.array_sort(F.collect_list(F.struct("row", "r"))).alias("rs"))
    return t.select("page_id", F.array_join("table", ".").alias("table_seq"), F.sha2(F.array_join(F.transform("rs", lambda r: r["r"]), "\x1e"), 256).alias("signature"))


def titles(blocks: DataFrame) -> DataFrame:
    """page_id, title: the first level-1 heading, else the heading that the page opens with."""
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    h = blocks.withColumn("n", first).filter(F.col("kind") == "heading").filter((F.col("level") == 1) | (F.col("n") == 1))
    return h.groupBy("page_id").agg(F.min_by("text", F.struct((F.col("level") != 1).cast("int"), F.col("seq"))).alias("title"))


def merged_lists(blocks: DataFrame) -> DataFrame:
    """blocks with ``list_run``: lists of one kind that follow one another on one level share it."""
    from foliograph.operators.order import runs

    lists = blocks.withColumn("parent", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), ".")).withColumn("ordered", F.coalesce(F.try_element_at("attrs", F.lit("ordered")), F.lit("")))
    return runs(lists, ["page_id", "parent"], ["seq"], ["kind", "ordered"]).withColumnRenamed("run", "list_run").drop("parent", "ordered")


def subtree(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks at or below the roots (page_id, path): a block meets a root on a prefix of its path."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    hit = blocks.select("page_id", "seq", F.explode(prefixes).alias("prefix")).join(roots.select("page_id", F.col("path").alias("prefix")), ["page_id", "prefix"], "left_semi")
    return blocks.join(hit.select("page_id", "seq").distinct(), ["page_id", "seq"], "left_semi")


def to_mdx(blocks: DataFrame) -> DataFrame:
    """page_id, mdx: blocks written out again; fences are longer than any inside, text is escaped where MDX would read it."""
    ticks = F.regexp_extract_all("text", F.lit("(`{3,})"), F.lit(1))
    fence = F.rpad(F.lit(""), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(ticks, lambda t: F.length(t) + 1)), F.lit(3))), F.lit("`"))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    plain = text.escaped_mdx(F.col("text"))
    out = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), plain))
        .when(F.col("kind") == "code", F.concat(fence, F.coalesce("lang", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n"), fence))
        .when(F.col("kind") == "thematicBreak", "---")
        .when(F.col("kind") == "listItem", F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), F.lit("- "), plain))
        .when(F.col("kind") == "blockquote", F.concat(F.lit("> "), F.replace(plain, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "image", F.concat(F.lit("!["), plain, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")")))
        .when(F.col("kind") == "component", F.concat(F.lit("<"), F.col("name"), attrs, F.lit(" />")))
        .when(F.col("kind") == "tableCell", plain)
        .when(F.col("kind").isin("list", "table", "tableRow"), "")
        .otherwise(plain)
    )
    rows = blocks.withColumn("out", out).filter("out <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "out"))).alias("os"))
    return rows.select("page_id", F.concat(F.array_join(F.transform("os", lambda o: o["out"]), "\n\n"), F.lit("\n")).alias("mdx"))


def with_paths(rows: DataFrame, tree: list[str]) -> DataFrame:
    """rows (tree columns, node, parent, key, ...) that hang beneath a tree's top (parent '') with ``path``, places from 0 at each level,
    in the order of key. One join for each level; rows that the top doesn't reach are gone. Nodes are unique in a tree."""
    place = F.row_number().over(Window.partitionBy(*tree, "parent").orderBy("key", "node")) - 1
    r = written(rows.withColumn("place", place).drop("key"), "tree")
    level = r.filter("parent = ''").withColumn("path", F.array("place"))
    out = None
    while True:
        level = written(level, "tree-level")
        if out is not None and not level.take(1):
            return out.drop("place")
        out = level if out is None else out.union(level)
        up = level.select(*tree, F.col("node").alias("parent"), F.col("path").alias("above"))
        level = r.join(up, [*tree, "parent"]).withColumn("path", F.concat("above", F.array("place"))).select(*level.columns)
