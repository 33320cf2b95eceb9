"""What a site is: its platform, name, base paths, component clusters, majority language, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import written

SEPARATORS = (" | ", " — ", " – ", " - ", " · ")


def platform_scores(pages: DataFrame, signals: list[tuple[str, str, float]]) -> DataFrame:
    """platform, hit, applicable, confidence over a corpus of html; signals are (platform, pattern, weight): a small table by nature.

    One pass: a signal hits if any page has it. Every signal applies where there is html."""
    hits = pages.agg(F.count("html").alias("n"), *[F.max(F.coalesce(F.col("html").rlike(p), F.lit(False)).cast("int")).alias(f"s{i}") for i, (_, p, _) in enumerate(signals)])
    rows = F.array(*[F.struct(F.lit(name).alias("platform"), F.lit(float(w)).alias("weight"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("hit")) for i, (name, _, w) in enumerate(signals)])
    s = hits.filter("n > 0").select(F.explode(rows).alias("r")).select("r.*")
    got = s.groupBy("platform").agg(F.sum(F.col("weight") * F.col("hit")).alias("hit"), F.sum("weight").alias("applicable"))
    return got.filter("hit > 0").withColumn("confidence", F.col("hit") / F.col("applicable"))


def platform(scores: DataFrame, least: float = 0.6, gap: float = 0.15) -> DataFrame:
    """One row: platform, confidence, ambiguous."""
    top = scores.agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("confidence", "platform")))), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    unsure = first.isNull() | (first["confidence"] < least) | F.coalesce(first["confidence"] - second["confidence"] < gap, F.lit(False))
    return top.select(first["platform"].alias("platform"), first["confidence"].alias("confidence"), unsure.alias("ambiguous"))


def title_suffix(title: Column) -> Column:
    """What follows the last occurrence of the first separator a title has; null if it has none."""
    out = F.lit(None).cast("string")
    for s in reversed(SEPARATORS):
        out = F.when(title.contains(s), F.element_at(F.split(title, s.replace("|", r"\|")), -1)).otherwise(out)
    return F.trim(out)


def site_names(titles: DataFrame, group: str) -> DataFrame:
    """group, site_name: the suffix that all of at least two titles (group, title) agree on, else null; blank titles don't count."""
    t = titles.filter(F.trim("title") != "").withColumn("suffix", title_suffix(F.col("title")))
    agreed = (F.count_if(F.col("suffix").isNull()) == 0) & (F.count("suffix") >= 2) & (F.count_distinct("suffix") == 1)
    return t.groupBy(group).agg(F.when(agreed, F.min("suffix")).alias("site_name"))


def common_bases(paths: DataFrame, group: str) -> DataFrame:
    """group, n_paths, base: the longest run of leading segments that all paths (group, path) share."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    s = paths.select(group, F.posexplode_outer(parts).alias("pos", "segment"))
    n = paths.groupBy(group).agg(F.count("*").alias("n_paths"))
    at = s.filter("segment IS NOT NULL").groupBy(group, "pos").agg(F.min("segment").alias("segment"), F.count("*").alias("n"), F.count_distinct("segment").alias("kinds"))
    agreed = at.join(n, group).filter((F.col("kinds") == 1) & (F.col("n") == F.col("n_paths"))).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("ps"))
    lead = F.filter("ps", lambda p, i: p["pos"] == i)
    base = F.concat(F.lit("/"), F.array_join(F.transform(lead, lambda p: p["segment"]), "/"))
    return n.join(agreed, group, "left").select(group, "n_paths", F.coalesce(base, F.lit("/")).alias("base"))


def prop_bucket(value: Column) -> Column:
    """The kind of a property's value, given as text."""
    return (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(value.isin("true", "false"), "boolean")
        .when(value.rlike("^(https?:)?//|^/"), "url")
        .when(F.length(value) <= 40, "string:short")
        .otherwise("string:long")
    )


def signatures(components: DataFrame) -> DataFrame:
    """components (name, props map, ...) with signature, a 12-digit hash of the name and its properties' kinds in order of name."""
    kinds = F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat_ws("=", k, prop_bucket(F.element_at("props", k))))
    return components.withColumn("signature", F.substring(F.sha2(F.concat_ws("|", "name", F.array_join(kinds, ",")), 256), 1, 12))


def full_signatures(components: DataFrame, enums: tuple[str, ...] = ()) -> DataFrame:
    """components (name, props map, and where there are such columns platform, depth, children, style_deps, definition_hash) with
    signature, a 12-digit hash of all of these: of properties the kinds, of those named in ``enums`` the value, of children and styles
    (arrays of names) what they hold in order of name. What has one signature can be converted by one rule."""
    kind = lambda k: F.when(k.isin(*enums), F.concat(F.lit("enum:"), F.element_at("props", k))).otherwise(prop_bucket(F.element_at("props", k)))
    parts = {"props": F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat_ws("=", k, kind(k)))}
    for c in ("platform", "name", "depth", "definition_hash"):
        if c in components.columns:
            parts[c] = F.col(c).cast("string")
    for c in ("children", "style_deps"):
        if c in components.columns:
            parts[c] = F.array_sort(c)
    return components.withColumn("signature", F.substring(F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(parts.items())])), 256), 1, 12))


def clusters(signed: DataFrame, sample: str, k: int = 5) -> DataFrame:
    """signature, name, count, samples: the k smallest ``sample`` values, found without gathering a cluster."""
    top = F.row_number().over(Window.partitionBy("signature").orderBy(sample))
    few = signed.select("signature", sample).withColumn("__n", top).filter(F.col("__n") <= k)
    few = few.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list(sample)), ",").alias("samples"))
    return signed.groupBy("signature").agg(F.min("name").alias("name"), F.count("*").alias("count")).join(few, "signature")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n: the most frequent value, the smallest of equals."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("x")).select(group, f"x.{value}", "x.n")


def nav_paths(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, parent_id, label) with path, labels from the root joined by /, and depth; one join for each level. A node under
    several parents has a row for each place, but is never placed beneath itself. Nodes that no root reaches (their parents are
    missing or form a cycle) have null in both."""
    level = nodes.filter("parent_id IS NULL").select("node_id", F.col("label").alias("path"), F.lit(0).alias("depth"), F.array("node_id").alias("above"))
    out, depth = level.drop("above"), 0
    while True:
        depth += 1
        parents = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("up"), "above")
        met = nodes.join(parents, "parent_id").filter(~F.array_contains("above", F.col("node_id")))
        level = written(met.select("node_id", F.concat_ws("/", "up", "label").alias("path"), F.lit(depth).alias("depth"), F.array_append("above", F.col("node_id")).alias("above")), "nav-level")
        if not level.take(1):
            break
        out = out.union(level.drop("above"))
    lost = nodes.join(out.select("node_id"), "node_id", "left_anti")
    return out.union(lost.select("node_id", F.lit(None).cast("string"), F.lit(None).cast("int")))


def landing_children(nodes: DataFrame) -> DataFrame:
    """parent_id, node_id of containers whose first child (by ord) carries their own label: it is their landing page."""
    first = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.min_by(F.struct("node_id", "label"), F.struct("ord", "node_id")).alias("c"))
    own = nodes.select(F.col("node_id").alias("parent_id"), F.col("label").alias("own"))
    return first.join(own, "parent_id").filter(F.lower("c.label") == F.lower("own")).select("parent_id", F.col("c.node_id").alias("node_id"))


def unplaced(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pages that no navigation node names."""
    return pages.select("page_id").distinct().join(nodes.filter("page_id IS NOT NULL").select("page_id"), "page_id", "left_anti")


def branding(pages: DataFrame) -> DataFrame:
    """host, color, icon, logo: the most frequent statements of a host's pages (host, html), the smallest of equals."""
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    stated = pages.select(
        "host",
        get(r'(?i)<meta\b[^>]*\bname="theme-color"[^>]*\bcontent="(#[0-9a-f]{3,8})"').alias("color"),
        get(r'(?i)<link\b[^>]*\brel="(?:shortcut )?icon"[^>]*\bhref="([^"]*)"').alias("icon"),
        get(r'(?i)<img\b[^>]*\bclass="[^"]*logo[^"]*"[^>]*\bsrc="([^"]*)"').alias("logo"),
    )
    out = stated.select("host").distinct()
    for field in ("color", "icon", "logo"):
        out = out.join(majority(stated, "host", field).select("host", field), "host", "left")
    return out
