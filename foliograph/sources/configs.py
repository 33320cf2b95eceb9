"""Nested configurations of unknown depth, read level by level as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import written

# The keys under which a configuration divides its navigation, and those that name a container.
DIVISIONS = ("versions", "languages", "tabs", "anchors", "dropdowns", "products", "menus", "menu", "groups", "pages")
LABELS = ("group", "tab", "anchor", "dropdown", "product", "version", "language", "menu", "item")


def defined(text: Column) -> Column:
    """The object that a script hands to ``define``, names and strings as scripts write them; null if there is none."""
    inner = F.regexp_extract(text, r"(?s)^\s*define\s*\((.*)\)\s*;?\s*$", 1)
    return F.from_json(F.nullif(inner, F.lit("")), "variant", {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def contents_nodes(files: DataFrame) -> DataFrame:
    """toc, node, parent, ord, index of files (toc, v): the nested ``n`` beneath ``tree``; node is the place, joined by points."""
    level = files.select("toc", F.lit(None).cast("string").alias("parent"), F.posexplode(F.try_variant_get("v", "$.tree.n", "array<variant>")).alias("ord", "v"))
    out = None
    while True:
        level = level.withColumn("node", F.concat_ws(".", "parent", "ord"))
        level = written(level.select("toc", "node", "parent", "ord", F.try_variant_get("v", "$.i", "int").alias("index"), F.try_variant_get("v", "$.n", "array<variant>").alias("below")), "toc-level")
        if out is not None and not level.take(1):
            return out
        flat = level.drop("below")
        out = flat if out is None else out.union(flat)
        level = level.select("toc", F.col("node").alias("parent"), F.posexplode("below").alias("ord", "v"))


def _shape(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def listed_pages(configs: DataFrame, files: DataFrame) -> DataFrame:
    """config, path, locale, version, groups, hidden, place, status of the pages that configurations (config, json) name.

    A page is what a string beneath ``navigation`` names; language and version are handed down, other labels gather in groups, and all
    beneath something hidden is. One path under two versions or languages is two pages; of the same again the first counts. Status:
    ``listed``, ``missing`` (no such path among files (config, path)), or ``unlisted`` for files that no string names (all else null).
    Places count a configuration's listed pages from 0. Text that is no JSON has no pages."""
    none = F.lit(None).cast("string")
    level = configs.select("config", F.try_variant_get(F.try_parse_json("json"), "$.navigation", "variant").alias("v"), F.array().cast("array<int>").alias("at"), none.alias("locale"), none.alias("version"), F.array().cast("array<string>").alias("groups"), F.lit(False).alias("hidden"))
    inherited = ["locale", "version", "groups", "hidden"]
    out = None
    while True:
        level = written(level.filter("v IS NOT NULL").withColumn("shape", _shape(F.col("v"))), "config-level")
        if out is not None and not level.take(1):
            break
        names = level.filter("shape = 'STRING'").select("config", F.try_variant_get("v", "$", "string").alias("path"), "at", *inherited)
        out = names if out is None else out.union(names)
        lists = level.filter("shape = 'ARRAY'").select("config", "at", *inherited, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "v"))
        o = level.filter("shape = 'OBJECT'")
        text = lambda k: F.when(_shape(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string"))
        label = F.coalesce(*[text(k) for k in LABELS])
        divides = F.coalesce(text("version"), text("language")).isNotNull()
        o = o.withColumns({
            "locale": F.coalesce(text("language"), "locale"), "version": F.coalesce(text("version"), "version"), "groups": F.when(label.isNotNull() & ~divides, F.array_append("groups", label)).otherwise(F.col("groups")),
            "hidden": F.col("hidden") | F.coalesce(F.try_variant_get("v", "$.hidden", "boolean"), F.lit(False))})
        # a menu may be named by a string: that is its label, not a page
        under = lambda k: F.when(text(k).isNull() | F.lit(k not in LABELS), F.try_variant_get("v", f"$.{k}", "variant"))
        parts = F.array(*[F.struct(F.lit(i).alias("n"), under(k).alias("v")) for i, k in enumerate((*DIVISIONS, "global"))])
        objects = o.select("config", "at", *inherited, F.explode(parts).alias("p")).select("config", "at", *inherited, "p.n", "p.v")
        level = lists.union(objects).select("config", "v", F.array_append("at", F.col("n")).alias("at"), *inherited)
    first = out.groupBy("config", "locale", "version", "path").agg(F.min_by(F.struct("at", "groups", "hidden"), "at").alias("x")).select("config", "path", "locale", "version", "x.*")
    have = files.select("config", "path").distinct().withColumn("there", F.lit(True))
    met = first.join(have, ["config", "path"], "left").withColumn("status", F.when(F.col("there"), "listed").otherwise("missing"))
    place = F.when(F.col("there"), F.row_number().over(Window.partitionBy("config", "there").orderBy("at")) - 1)
    met = met.select("config", "path", "locale", "version", "groups", "hidden", place.alias("place"), "status")
    rest = have.join(first, ["config", "path"], "left_anti")
    return met.union(rest.select("config", "path", none, none, F.lit(None).cast("array<string>"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit("unlisted")))
