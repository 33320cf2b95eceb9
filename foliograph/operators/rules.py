"""Mapping rules for components: which rule is the first to match, and what it makes of the properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators.lookups import looked_up

RULES = "platform string, ord int, name string, class string, props map<string,string>, to_name string, to_props map<string,string>, children string, drop array<string>"


def matched(components: DataFrame, rules: DataFrame) -> DataFrame:
    """components (page_id, node_id, platform, name, props, style_deps) with the first rule that matches, or nulls.

    A rule of the component's own platform comes before one of ``*``; then ``ord`` decides. A rule asks for its name, for a class if
    it has one, and for each property's value; ``any`` takes every value. A component meets all rules of its name at once, first ones
    first, and takes the first that fits: components stay where they are, and neither they nor rules are sorted or moved for it."""
    lowest = F.lit(-(2**31))
    rank = lambda r: F.struct((r["r_platform"] == "*").cast("int"), F.coalesce(r["r_ord"], lowest))
    earlier = lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
    rule = F.struct(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    of_name = rules.filter("name IS NOT NULL").groupBy("name").agg(F.array_sort(F.collect_list(rule), earlier).alias("of_name"))

    def fits(r):
        wants = F.coalesce(F.map_entries(r["r_props"]), F.array().cast("array<struct<key:string,value:string>>"))
        has = F.forall(wants, lambda e: F.map_contains_key("props", e["key"]) & ((e["value"] == "any") | (F.element_at("props", e["key"]) == e["value"])))
        return F.coalesce(((r["r_platform"] == "*") | (r["r_platform"] == F.col("platform"))) & (r["r_class"].isNull() | F.array_contains("style_deps", r["r_class"])) & has, F.lit(False))

    return looked_up(components, of_name, "name").select(*components.columns, F.get(F.filter("of_name", fits), 0).alias("rule"))


def applied(found: DataFrame) -> DataFrame:
    """page_id, node_id, new_name, new_props, lossy: what the matched rule makes of each component.

    A property of the rule's target is a constant, $name (that property) or nothing if the component lacks it. Properties that the
    rule neither uses nor drops are lossy; components without a rule are ``unmapped``."""
    to = F.coalesce(F.col("rule.r_to_props"), F.create_map().cast("map<string,string>"))
    given = F.transform_values(to, lambda k, v: F.when(v.startswith("$"), F.try_element_at("props", F.regexp_replace(v, r"^\$", ""))).otherwise(v))
    new = F.map_filter(given, lambda k, v: v.isNotNull())
    used = F.concat(F.transform(F.map_values(to), lambda v: F.regexp_replace(v, r"^\$", "")), F.coalesce(F.col("rule.r_drop"), F.array().cast("array<string>")), F.coalesce(F.map_keys("rule.r_props"), F.array().cast("array<string>")))
    lossy = F.array_sort(F.array_except(F.map_keys("props"), used))
    mapped = F.col("rule").isNotNull()
    return found.select("page_id", "node_id", F.when(mapped, F.col("rule.r_to_name")).otherwise("unmapped").alias("new_name"), F.when(mapped, new).otherwise(F.col("props")).alias("new_props"), F.when(mapped, lossy).otherwise(F.array().cast("array<string>")).alias("lossy"))
