"""Redirect rules: maps from old to new routes, wildcards, and the problems of a rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import urls
from foliograph.operators.lookups import by_hot_keys
from foliograph.workspace import written


def tidy(route: Column) -> Column:
    """One leading slash, none at the end."""
    return F.concat(F.lit("/"), F.regexp_replace(route, "^/+|/+$", ""))


def exact(plan: DataFrame) -> DataFrame:
    """source, destination, status_code for every page of plan (old_path, new_path) that moves."""
    p = plan.filter("old_path IS NOT NULL AND new_path IS NOT NULL").select(tidy(F.col("old_path")).alias("source"), tidy(F.col("new_path")).alias("destination"))
    return p.filter("source <> destination").distinct().withColumn("status_code", F.lit(308))


def _parent(route: Column) -> Column:
    return F.regexp_replace(route, "/[^/]*$", "")


def _last(route: Column) -> Column:
    return F.regexp_extract(route, "([^/]*)$", 1)


def wildcards(rules: DataFrame, least: int = 3) -> DataFrame:
    """source, destination, covered: old/* -> new/:splat where at least ``least`` rules of one directory move to one other with
    their last segment unchanged, and every rule beneath old/ agrees."""
    r = rules.select("source", "destination", _parent(F.col("source")).alias("old"), _parent(F.col("destination")).alias("new"))
    whole = F.every(_last(F.col("source")) == _last(F.col("destination")))
    found = r.filter("old <> '' AND new <> '' AND old <> new").groupBy("old", "new").agg(F.count("*").alias("covered"), whole.alias("whole")).filter(F.col("whole") & (F.col("covered") >= least))
    # every rule beneath old/ meets the candidate on one of its own prefixes, so the join is on equal keys
    beneath = rules.select("source", "destination", F.explode(urls.section_prefixes(_parent(F.col("source")))).alias("old")).distinct()
    met = beneath.join(found.select("old", "new"), "old")
    rest = F.expr("substring(source, length(old) + 1)")
    against = met.filter(F.concat("new", rest) != F.col("destination")).select("old", "new").distinct()
    kept = found.join(against, ["old", "new"], "left_anti")
    return kept.select(F.concat("old", F.lit("/*")).alias("source"), F.concat("new", F.lit("/:splat")).alias("destination"), "covered")


def conflicts(rules: DataFrame) -> DataFrame:
    """source, n_destinations of sources with more than one destination."""
    return rules.groupBy("source").agg(F.count_distinct("destination").alias("n_destinations")).filter("n_destinations > 1")


def case_collisions(rules: DataFrame) -> DataFrame:
    """lower_source, n_sources of sources that differ in case only."""
    return rules.groupBy(F.lower("source").alias("lower_source")).agg(F.count_distinct("source").alias("n_sources")).filter("n_sources > 1")


def lost_queries(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("source").rlike("[?#]")).select("source", "destination")


def chains(rules: DataFrame) -> DataFrame:
    """source, via, destination: a destination that is redirected on."""
    onward = rules.select(F.col("source").alias("via"), F.col("destination").alias("onward"))
    return rules.withColumnRenamed("destination", "via").join(onward, "via").filter("onward <> via").select("source", "via", F.col("onward").alias("destination"))


def _circular(steps: DataFrame) -> DataFrame:
    """The steps (source, destination; each source once) joined up to jumps, of those sources that lie on cycles.

    All are followed at once, twice as far in each round. A source that nothing leads to any more, or whose path has ended, lies on no
    cycle and moves no further. Once a round loses none, the jumps map what is left onto itself: cycles alone. No number of rounds is
    set; a path of n steps takes log2(n)."""
    jump = written(steps, "steps")
    n = jump.count()
    while n:
        reached = jump.select(F.col("destination").alias("source")).distinct()
        onward = jump.select(F.col("source").alias("destination"), F.col("destination").alias("next"))
        led_to = jump.join(reached.hint("merge"), "source", "left_semi")
        jump = written(led_to.join(onward.hint("merge"), "destination").select("source", F.col("next").alias("destination")), "steps")
        before, n = n, jump.count()
        if n == before:
            break
    return jump


def loops(rules: DataFrame) -> DataFrame:
    """source: routes that lie on a cycle of redirects (one destination each: the smallest)."""
    return _circular(rules.groupBy("source").agg(F.min("destination").alias("destination"))).select("source")


def missing_targets(rules: DataFrame, routes: DataFrame) -> DataFrame:
    """Rules to a route that neither exists, as itself or as route/index, nor is redirected itself; outside and wildcard targets are left alone."""
    inside = rules.filter(~F.col("destination").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//") & ~F.col("destination").contains("*") & ~F.col("destination").contains(":splat"))
    known = routes.select(tidy(F.col("route")).alias("destination"))
    known = known.union(known.select(F.regexp_replace("destination", "/index$", "").alias("destination"))).union(rules.select(F.col("source").alias("destination"))).distinct()
    return inside.join(known, "destination", "left_anti").select("source", "destination")


def shadowed(rules: DataFrame, wildcard_rules: DataFrame) -> DataFrame:
    """source, by: exact rules that a wildcard covers with another outcome."""
    wild = wildcard_rules.select(F.regexp_replace("source", r"/\*$", "").alias("prefix"), F.col("source").alias("by"), F.col("destination").alias("to"))
    under = rules.select("source", "destination", F.explode(urls.section_prefixes(_parent(F.col("source")))).alias("prefix")).distinct()
    met = under.join(wild, "prefix")
    outcome = F.expr("replace(to, '/:splat', substring(source, length(prefix) + 1))")
    return met.filter(outcome != F.col("destination")).select("source", "by")


def aliases_closed(aliases: DataFrame) -> DataFrame:
    """alias, canonical: where each alias ends when aliases of aliases are followed; one that never ends, as it leads into a cycle, has
    the smallest name of that cycle."""
    first = aliases.groupBy("alias").agg(F.min("target").alias("target"))
    # least: the smallest name passed so far, the end of this jump included
    going = written(first.withColumn("least", F.col("target")), "aliases")
    # those that have ended are only looked up from then on, and who meets one of them ends with it
    ended = going.limit(0)
    rounds = max(1, going.count()).bit_length() + 1
    for _ in range(rounds):
        known = going.withColumn("ends", F.lit(False)).union(ended.withColumn("ends", F.lit(True)))
        onward = known.select(F.col("alias").alias("target"), F.col("target").alias("next"), F.col("least").alias("lesser"), "ends")
        moved = by_hot_keys(going, onward, "target").select("alias", F.coalesce("next", "target").alias("target"), F.least("least", "lesser").alias("least"), F.coalesce("ends", F.lit(True)).alias("ends"))
        moved = written(moved, "aliases", by=["ends"])
        ended = ended.union(moved.filter("ends").drop("ends"))
        going = moved.filter("NOT ends").drop("ends")
        if not going.take(1):
            break
    # after more steps than there are aliases the target is on the cycle, and all of its cycle has been passed from there
    of_cycle = by_hot_keys(going.select("alias", "target"), going.select(F.col("alias").alias("target"), F.col("least").alias("canonical")), "target")
    return ended.select("alias", F.col("target").alias("canonical")).union(of_cycle.select("alias", "canonical"))
