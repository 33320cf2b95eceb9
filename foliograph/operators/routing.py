"""Plans for pages and components: routes given by a plan, decisions on components, titles, categories, icons, places in navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.operators.order import placed


def with_plan(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """pages (page_id, migrate, reason, ...) with ``route`` of plan (page_id, route, reason): the plan's reason holds for pages that migrate."""
    p = plan.groupBy("page_id").agg(F.min_by(F.struct("route", "reason"), "route").alias("planned"))
    j = pages.join(p, "page_id", "left")
    reason = F.when(F.col("planned").isNotNull() & F.col("migrate"), F.col("planned.reason")).otherwise(F.col("reason"))
    return j.withColumns({"route": F.col("planned.route"), "reason": reason}).drop("planned")


def plan_extended(plan: DataFrame, defaults: DataFrame) -> DataFrame:
    """page_id, route, status, holder: the plan (page_id, route) as ``planned``, and the default routes (page_id, route) of pages it doesn't
    name: ``added``, or ``refused`` where the plan gives the route to another page, the holder. Entries of the plan never change."""
    new = defaults.join(plan.select("page_id").distinct(), "page_id", "left_anti")
    held = plan.groupBy("route").agg(F.min("page_id").alias("holder"))
    status = F.when(F.col("holder").isNull(), "added").otherwise("refused")
    added = new.join(held, "route", "left").select("page_id", "route", status.alias("status"), "holder")
    return plan.select("page_id", "route", F.lit("planned").alias("status"), F.lit(None).cast(added.schema["holder"].dataType).alias("holder")).union(added)


def component_decisions(components: DataFrame, plan: DataFrame, rules: DataFrame, handlers: DataFrame) -> DataFrame:
    """components (component_id, name, signature) with ``decided_by`` and ``outcome``: the plan's entry for the signature (signature,
    status, target) before a rule for the name (name, target) before a handler (name); what none decides is ``unresolved``."""
    p = plan.filter("status <> 'open'").groupBy("signature").agg(F.min_by(F.struct("status", "target"), "status").alias("entry"))
    r = rules.groupBy("name").agg(F.min("target").alias("rule_target"))
    h = handlers.select("name", F.lit(True).alias("handled")).distinct()
    j = components.join(p, "signature", "left").join(r, "name", "left").join(h, "name", "left")
    by = F.when(F.col("entry").isNotNull(), "plan").when(F.col("rule_target").isNotNull(), "rule").when(F.col("handled"), "handler").otherwise("unresolved")
    outcome = F.when(by == "plan", F.coalesce("entry.target", "entry.status")).when(by == "rule", F.col("rule_target"))
    return j.withColumns({"decided_by": by, "outcome": outcome}).drop("entry", "rule_target", "handled")


def titled(pages: DataFrame, sources: list[str], exact: bool = False) -> DataFrame:
    """pages with ``title`` and ``title_source``: the first of the columns ``sources`` that isn't blank; else the last segment of
    ``path`` as a label (path), or with ``exact`` nothing at all (refused)."""
    stated = [F.when(F.trim(c) != "", F.trim(c)) for c in sources]
    source = F.coalesce(*[F.when(s.isNotNull(), F.lit(c)) for c, s in zip(sources, stated, strict=True)], F.lit("refused" if exact else "path"))
    made = F.lit(None).cast("string") if exact else text.label(F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1))
    return pages.withColumns({"title": F.coalesce(*stated, made), "title_source": source})


def path_from_tree(groups: Column, title: Column) -> Column:
    """The route of a page by where it stands: its groups and its title as slugs; groups without a name don't count."""
    named = F.filter(F.coalesce(groups, F.array().cast("array<string>")), lambda g: F.coalesce((g != "") & (g != "(uncategorised)"), F.lit(False)))
    return F.array_join(F.concat(F.transform(named, text.slug), F.array(text.slug(title))), "/")


def categories_of_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """workspace, entry_id, file_id, matched_by of category entries (workspace, entry_id, slug, title) and files (workspace, file_id, slug):
    by slug, else by the title as a slug; entries without a file and files without an entry are rows of their own, matched by null."""
    f = files.groupBy("workspace", "slug").agg(F.min("file_id").alias("file_id"))
    by_title = f.select("workspace", F.col("slug").alias("title_slug"), F.col("file_id").alias("title_file"))
    e = entries.withColumn("title_slug", text.slug(F.col("title"))).join(f, ["workspace", "slug"], "left").join(by_title, ["workspace", "title_slug"], "left")
    by = F.when(F.col("file_id").isNotNull(), "slug").when(F.col("title_file").isNotNull(), "title")
    met = e.select("workspace", "entry_id", F.coalesce("file_id", "title_file").alias("file_id"), by.alias("matched_by"))
    rest = files.join(met.select("workspace", "file_id"), ["workspace", "file_id"], "left_anti")
    return met.union(rest.select("workspace", F.lit(None).cast(met.schema["entry_id"].dataType), "file_id", F.lit(None).cast("string")))


#: Words that name an icon's library or its style and not what it shows.
ICON_LIBRARIES = ("fa", "fab", "fad", "fal", "far", "fas", "fat", "lucide")
ICON_STYLES = ("alt", "duotone", "light", "outline", "regular", "sharp", "solid", "thin")


def _after_last(words: Column, known: tuple[str, ...], end: bool) -> Column:
    """Words without the known ones at one end, one word at least."""
    w = F.reverse(words) if end else words
    skip = F.array_position(F.transform(w, lambda x: ~x.isin(*known)), True)
    left = F.when(skip > 1, F.slice(w, skip.cast("int"), F.size(w))).when(skip == 0, F.slice(w, -1, 1)).otherwise(w)
    return F.reverse(left) if end else left


def icon_words(stated: Column) -> Column:
    """An icon's name as lower-case words, split at changes of case and separators, without the library's; null for addresses and paths."""
    words = F.filter(F.split(F.lower(F.regexp_replace(stated, "(?<=[a-z0-9])(?=[A-Z])", " ")), r"[\s:_-]+"), lambda w: w != "")
    return F.when(~stated.contains("/") & (F.size(words) > 0), _after_last(words, ICON_LIBRARIES, end=False))


def drawable_icons(rows: DataFrame, icon: str, drawable: DataFrame, equivalents: DataFrame) -> DataFrame:
    """rows with ``drawn``: the name in drawable (name) that stands for the column ``icon``, as spelled, by equivalents (name, other), or
    either of both once style words at its end are gone; null where nothing can be drawn."""
    can = drawable.select("name").distinct()
    other = equivalents.groupBy("name").agg(F.min("other").alias("other"))
    known = can.select("name", F.col("name").alias("drawn")).withColumn("rank", F.lit(0))
    known = known.union(other.join(can.select(F.col("name").alias("other")), "other").select("name", F.col("other").alias("drawn"), F.lit(1)))
    one = known.groupBy("name").agg(F.min_by("drawn", "rank").alias("drawn"))
    words = icon_words(F.col(icon))
    j = rows.withColumns({"icon_name": F.array_join(words, "-"), "icon_bare": F.array_join(_after_last(words, ICON_STYLES, end=True), "-")})
    j = j.join(one.withColumnsRenamed({"name": "icon_name", "drawn": "as_spelled"}), "icon_name", "left").join(one.withColumnsRenamed({"name": "icon_bare", "drawn": "as_bare"}), "icon_bare", "left")
    return j.withColumn("drawn", F.coalesce("as_spelled", "as_bare")).drop("icon_name", "icon_bare", "as_spelled", "as_bare")


def _prefixes(route: Column) -> Column:
    """All leading parts of a route, the whole one included, as (prefix, depth)."""
    parts = F.split(route, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"), n.alias("depth")))


def placed_by_route(pages: DataFrame, containers: DataFrame) -> DataFrame:
    """page_id, container, placed_by of pages (page_id, route) among containers' routes (container, route).

    ``folder``: more than half of the container's routes lie in the page's own folder; of several the one with most there, then the
    smaller, then the first by name. Else ``prefix``: the page lies within the folder all of a container's routes share; of several
    the deepest, then the one with most routes, then the first by name. Else null. Every leading part meets its like in an equal
    join, so no page is held against every container."""
    inside = containers.select("container", F.size(F.split("route", "/")).alias("size"), F.explode(_prefixes(F.col("route"))).alias("p")).select("container", "size", "p.*")
    met = inside.groupBy("container", "prefix", "depth").agg(F.count("*").alias("all_routes"), F.count_if(F.col("size") > F.col("depth")).alias("beneath"))
    total = containers.groupBy("container").agg(F.count("*").alias("total"))
    met = met.join(total, "container")
    parts = F.split("route", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    p = pages.select("page_id", "route", folder.alias("folder"), F.size(parts).alias("size"))
    homes = met.filter("beneath * 2 > total").groupBy("prefix").agg(F.min_by("container", F.struct(-F.col("beneath"), "total", "container")).alias("home"))
    shared = met.filter("all_routes = total").groupBy("container").agg(F.max_by(F.struct("prefix", "depth", "total"), "depth").alias("s")).select("container", "s.*")
    widest = shared.groupBy("prefix", "depth").agg(F.min_by("container", F.struct(-F.col("total"), "container")).alias("wide"))
    above = p.select("page_id", "size", F.explode(_prefixes(F.col("route"))).alias("p")).select("page_id", "size", "p.prefix").join(widest, "prefix").filter("depth < size")
    above = above.groupBy("page_id").agg(F.max_by("wide", "depth").alias("wide"))
    j = p.join(homes.withColumnRenamed("prefix", "folder"), "folder", "left").join(above, "page_id", "left")
    by = F.when(F.col("home").isNotNull(), "folder").when(F.col("wide").isNotNull(), "prefix")
    return j.select("page_id", F.coalesce("home", "wide").alias("container"), by.alias("placed_by"))


def navigation_steps(before: DataFrame, after: DataFrame, ratio: float, least: int) -> DataFrame:
    """path, step: in which write each path (path) that only ``before`` has goes, so that no write drops more than ``ratio`` of the paths
    it finds; all in step 1 if before has fewer than ``least`` paths or the loss is small anyway. A step drops one path at the least.

    Only the steps' bounds are worked out ahead, from three counts; their number grows with the logarithm of the paths."""
    b, a = before.select("path").distinct(), after.select("path").distinct()
    stale = b.join(a, "path", "left_anti")
    n_before, n_after, left = b.count(), a.count(), stale.count()
    if n_before < least or left <= ratio * n_before:
        return stale.withColumn("step", F.lit(1))
    bounds, gone = [], 0
    while gone < left:
        total = n_after + left - gone
        gone += total if total < least else max(1, int(total * ratio))
        bounds.append(min(gone, left))
    step = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("place"))) + 1
    return placed(stale, "path").select("path", step.alias("step"))


def archive_problems(entries: DataFrame, most_bytes: int = 200 << 20, most_ratio: int = 1000) -> DataFrame:
    """name, problem of an archive's entries (name, bytes, packed, is_link) that must not be unpacked: link, traversal, size or ratio, the
    first that holds."""
    climbs = F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.col("name").rlike(r"^([/\\]|[A-Za-z]:)") | F.col("name").contains("\x00")
    problem = F.when(F.col("is_link"), "link").when(climbs, "traversal").when(F.col("bytes") > most_bytes, "size").when(F.col("bytes") > F.col("packed") * most_ratio, "ratio")
    return entries.select("name", problem.alias("problem")).filter("problem IS NOT NULL")
