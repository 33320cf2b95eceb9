"""Comparisons of two or more sides: drift, universes, multisets, waivers, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drift(pinned: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: same, changed, added or missing of every key on either side; equal null values are the same."""
    a = pinned.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = now.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("status"))


def universe(manifest: DataFrame, tree: DataFrame, exclusions: DataFrame, written: DataFrame, quarantined: DataFrame) -> DataFrame:
    """page_id, outcome of every page any side knows.

    manifest: page_id, source_id, published; tree: page_id, migrate; exclusions: page_id, source_id; written, quarantined: page_id."""
    m = manifest.select("page_id", "source_id", "published", F.lit(True).alias("stated"))
    t = tree.select("page_id", "migrate", F.lit(True).alias("planned"))
    e = exclusions.select("page_id", F.col("source_id").alias("excluded_as"), F.lit(True).alias("excluded"))
    w = written.select("page_id", F.lit(True).alias("out")).distinct()
    q = quarantined.select("page_id", F.lit(True).alias("held")).distinct()
    u = m.join(t, "page_id", "full_outer").join(e, "page_id", "full_outer").join(w, "page_id", "full_outer").join(q, "page_id", "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(~yes("stated") & yes("planned"), "not-in-source")
        .when(~yes("stated") & yes("excluded"), "excluded-unknown")
        .when(~yes("stated"), "output-without-page")
        .when(yes("migrate") & yes("excluded"), "stale-exclusion")
        .when(yes("migrate") & yes("out"), "migrated")
        .when(yes("migrate") & yes("held"), "quarantined")
        .when(yes("migrate"), "unwritten")
        .when(yes("excluded") & F.col("excluded_as").eqNullSafe(F.col("source_id")), "excluded")
        .when(yes("excluded"), "mismatched-exclusion")
        .when(yes("published"), "undecided")
        .otherwise("unpublished")
    )
    return u.select("page_id", outcome.alias("outcome"))


def multiset_except(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of ``wanted`` beyond those that ``shown`` has as often, with how many are missing; counts meet, not rows."""
    keys = wanted.columns
    a = wanted.groupBy(*keys).agg(F.count("*").alias("n"))
    b = shown.select(*keys).groupBy(*keys).agg(F.count("*").alias("m"))
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    short = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b, on, "left").select(*[a[k] for k in keys], short.alias("missing")).filter("missing > 0")


def accounted(scoped: DataFrame, *handled: DataFrame) -> DataFrame:
    """Pages in scope that no other side has."""
    left = scoped.select("page_id").distinct()
    for side in handled:
        left = left.join(side.select("page_id"), "page_id", "left_anti")
    return left


def waived(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings (gate, route, detail) without those that an accepted difference (gate, route, detail) names and is contained in."""
    a = accepted.select("gate", "route", F.col("detail").alias("part"))
    return findings.join(a, (findings["gate"] == a["gate"]) & (findings["route"] == a["route"]) & findings["detail"].contains(a["part"]), "left_anti")


def merkle_hash(rows: DataFrame, group: str, path: str, sha256: str, buckets: int = 256) -> DataFrame:
    """group, n_files, tree_hash: one hash for a group's files in whatever order they come.

    Files go to buckets by the start of the hash of their path; a bucket's hash covers its sorted path and hash lines, a group's
    hash its buckets'. So a large group is hashed in parts, and only bucket hashes meet."""
    bucket = F.pmod(F.conv(F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 4), 16, 10).cast("long"), F.lit(buckets))
    line = F.concat_ws("\n", F.col(path).cast("string"), sha256)
    parts = rows.groupBy(F.col(group), bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n")
    return parts.groupBy(group).agg(F.sum("n").alias("n_files"), F.sha2(whole, 256).alias("tree_hash"))


def duplicates(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """content_hash, n, first_key of equal contents."""
    return rows.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate with partial results."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return got.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def conflicting(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one combination of values."""
    return rows.groupBy(*key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values])).alias("n_values")).filter("n_values > 1")


def numbered(rows: DataFrame, candidate: str, settled: str, order: list[str]) -> DataFrame:
    """Rows with ``route``: candidates taken more than once get -2, -3 and so on, settled rows first, skipping numbers that other
    candidates already are; ``collides`` says whether the row got a number."""
    taken = rows.select(F.col(candidate).alias("taken")).distinct()
    place = F.row_number().over(Window.partitionBy(candidate).orderBy(F.desc(settled), *order))
    r = rows.withColumn("place", place)
    # numbers of a candidate that are candidates of their own are not free
    base = taken.select(F.regexp_extract("taken", r"^(.*)-([0-9]+)$", 1).alias("base"), F.expr(r"try_cast(regexp_extract(taken, '^(.*)-([0-9]+)$', 2) AS int)").alias("used")).filter("used >= 2")
    used = base.groupBy("base").agg(F.array_sort(F.collect_set("used")).alias("used"))
    r = r.join(used, r[candidate] == used["base"], "left").drop("base")
    number = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("place"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    route = F.when(F.col("place") == 1, F.col(candidate)).otherwise(F.concat_ws("-", candidate, number))
    return r.withColumn("route", route).withColumn("collides", F.col("place") > 1).drop("place", "used")


def known_pages(**evidence: DataFrame) -> DataFrame:
    """route, known_by: every route that any side (route) names, with the names of the sides in order."""
    named = [side.select("route", F.lit(name).alias("by")) for name, side in sorted(evidence.items())]
    every = named[0]
    for side in named[1:]:
        every = every.union(side)
    return every.filter("route IS NOT NULL").groupBy("route").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("known_by"))


def retained(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have."""
    return before.select(key).intersect(now.select(key))


def sorted_keys(document: Column) -> Column:
    """A flat JSON object of texts with its keys in order."""
    entries = F.array_sort(F.map_entries(F.from_json(document, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def sorted_json(json: Column) -> Column:
    """JSON with the keys of every object in order, at every level, and no space between; null for what is no JSON. Arrays keep theirs."""
    return F.to_json(F.try_parse_json(json))
