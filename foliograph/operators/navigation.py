"""Navigation: trees from stated groups, their validity, and comparisons of two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.operators.order import placed
from foliograph.workspace import written

#: What a container may hold.
ALLOWED = {"version": ("language", "tab", "group", "page"), "language": ("tab", "group", "page"), "tab": ("group", "page"), "group": ("group", "page"), "product": ("version", "language", "tab", "group", "page")}


def from_groups(pages: DataFrame) -> DataFrame:
    """node_id, parent_id, kind, label, ord, page_id from pages (page_id, title, groups array, ord): a node for each prefix of groups,
    a leaf for each page. A group stands where its first page does."""
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("groups"), F.lit(1))), lambda k: F.slice("groups", F.lit(1), k))
    g = pages.filter(F.size("groups") > 0).select("ord", F.explode(prefixes).alias("p")).groupBy("p").agg(F.min("ord").alias("ord"))
    name = lambda p: F.concat(F.lit("g:"), F.array_join(p, "/"))
    above = F.when(F.size("p") > 1, name(F.slice("p", F.lit(1), F.size("p") - 1)))
    groups = g.select(name(F.col("p")).alias("node_id"), above.alias("parent_id"), F.lit("group").alias("kind"), F.element_at("p", -1).alias("label"), "ord", F.lit(None).cast("string").alias("page_id"))
    leaf = F.when(F.size("groups") > 0, name(F.col("groups")))
    leaves = pages.select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("node_id"), leaf.alias("parent_id"), F.lit("page").alias("kind"), F.col("title").alias("label"), "ord", F.col("page_id").cast("string").alias("page_id"))
    return groups.unionByName(leaves)


def problems(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """node_id, problem: mixed children, children of a kind that the container may not hold, pages without a file (page_id), missing parents."""
    child = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("kind").alias("child"))
    kinds = child.groupBy("node_id").agg(F.collect_set("child").alias("kinds")).join(nodes.select("node_id", "kind"), "node_id", "left")
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mixed = kinds.filter((F.size("kinds") > 1) & (F.col("kind") != "group")).select("node_id", F.lit("mixed children").alias("problem"))
    wrong = kinds.filter(F.col("kind").isNotNull() & (F.size(F.array_except("kinds", F.coalesce(F.try_element_at(allowed, F.col("kind")), F.array().cast("array<string>")))) > 0)).select("node_id", F.lit("child not allowed"))
    orphan = kinds.filter("kind IS NULL").select("node_id", F.lit("missing parent"))
    lost = nodes.filter("page_id IS NOT NULL").join(files.select(F.col("page_id").cast("string").alias("page_id")), "page_id", "left_anti").select("node_id", F.lit("page without a file"))
    return mixed.union(wrong).union(orphan).union(lost)


def sidebar(nodes: DataFrame, hidden: str | None = None) -> DataFrame:
    """path, label, page_id, place of pages in reading order: siblings by ord, parents before children; hidden nodes go with all beneath.
    Unless nodes are hidden, pages that no root reaches come last with a null path. A node under several parents has each of its
    places, but is never placed beneath itself.

    Order keys are joined down the tree, one join a level, so the flat order is one sort."""
    n = nodes.filter(f"NOT coalesce({hidden}, false)") if hidden else nodes
    key = F.concat(F.lpad(F.col("ord").cast("string"), 12, "0"), F.lit("\x01"), "node_id")
    level = n.filter("parent_id IS NULL").select("node_id", "label", "page_id", F.col("label").alias("path"), key.alias("key"), F.array("node_id").alias("above"))
    out = level.drop("above")
    while True:
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"), F.col("key").alias("up_key"), "above")
        met = n.join(up, "parent_id").filter(~F.array_contains("above", F.col("node_id")))
        level = met.select("node_id", "label", "page_id", F.concat_ws("/", "up_path", "label").alias("path"), F.concat("up_key", F.lit("\x02"), key).alias("key"), F.array_append("above", F.col("node_id")).alias("above"))
        level = written(level, "nav-level")
        if not level.take(1):
            break
        out = out.union(level.drop("above"))
    if not hidden:  # beneath a hidden node, nodes are meant to be out of reach
        lost = n.join(out.select("node_id"), "node_id", "left_anti")
        out = out.union(lost.select("node_id", "label", "page_id", F.lit(None).cast("string"), F.concat(F.lit("\x7f"), key)))
    return placed(out.filter("page_id IS NOT NULL").select("path", "label", "page_id", "key"), "key").drop("key")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, path, kind, label, page_id of nodes that only one of two navigations (path, kind, label, page_id, ord) has, icons apart."""
    columns = ["path", "kind", "label", "page_id", "ord"]
    only = lambda x, y, name: x.select(*columns).exceptAll(y.select(*columns)).withColumn("side", F.lit(name))
    return only(a, b, "first").union(only(b, a, "second"))


def unserved(written: DataFrame, nodes: DataFrame, initial: str | None = None) -> DataFrame:
    """Written pages that no navigation node names and that aren't where the site opens."""
    w = written.select(F.col("page_id").cast("string").alias("page_id")).distinct()
    left = w.join(nodes.filter("page_id IS NOT NULL").select("page_id"), "page_id", "left_anti")
    return left.filter(F.col("page_id") != initial) if initial else left


def section_tabs(sections: DataFrame) -> DataFrame:
    """path, label, place of sections (path, label, ord): the first label of each path, the home page first; none, if there are fewer than two."""
    one = sections.groupBy("path").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    # a section is a tab, so this is a handful of rows
    order = F.row_number().over(Window.orderBy((F.col("path") != "/").cast("int"), "ord", "path")) - 1
    return one.withColumns({"place": order, "n": F.count("*").over(Window.partitionBy())}).filter("n >= 2").drop("n", "ord")


def label_shortfalls(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """label, missing: labels (label) that distinct surfaces (surface, label) show less often than wanted."""
    a = wanted.groupBy("label").agg(F.count("*").alias("n"))
    b = shown.dropDuplicates(["surface", "label"]).groupBy("label").agg(F.count("*").alias("m"))
    return a.join(b, "label", "left").select("label", (F.col("n") - F.coalesce("m", F.lit(0))).alias("missing")).filter("missing > 0")


def condition_filter(rows: DataFrame, tags: str, include: list[str], exclude: list[str]) -> DataFrame:
    """rows with ``kept``: kept, dropped or ambiguous by their tags (an array): both lists hit is ambiguous, only exclude drops."""
    has = lambda values: F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, values)).cast("array<string>")) if values else F.lit(False)
    a, b = F.coalesce(has(include), F.lit(False)), F.coalesce(has(exclude), F.lit(False))
    return rows.withColumn("kept", F.when(a & b, "ambiguous").when(b, "dropped").otherwise("kept"))


def parents_by_slug(pages: DataFrame) -> DataFrame:
    """page_id, parent, placed_by of pages (page_id, slug, parent_slug, category): the page with the parent's slug, else the category."""
    p = pages.groupBy("slug").agg(F.min("page_id").alias("parent_page")).withColumnRenamed("slug", "parent_slug")
    j = pages.join(p, "parent_slug", "left")
    own = F.col("parent_page").isNotNull() & (F.col("parent_page") != F.col("page_id"))
    return j.select("page_id", F.when(own, F.concat(F.lit("page:"), F.col("parent_page").cast("string"))).otherwise(F.concat(F.lit("category:"), "category")).alias("parent"), F.when(own, "page").otherwise("category").alias("placed_by"))


def published(pages: DataFrame, hidden: list[str]) -> DataFrame:
    """pages with ``withheld``: the first of the columns ``hidden`` (draft, unlisted and the like) that is true, null for what is published."""
    return pages.withColumn("withheld", F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in hidden]))


def pages_of_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """nodes (node_id, route) with page_id of the page (page_id, route) they lead to, the smallest of several; null where there is none."""
    return nodes.join(pages.groupBy("route").agg(F.min("page_id").alias("page_id")), "route", "left")


def sidebars_observed(items: DataFrame, n_pages: DataFrame, least: int = 2, share: float = 0.02) -> DataFrame:
    """sidebar, n_placed, observed, is_navigation of sidebars' items (sidebar, url): observed with any page twice or more, navigation if
    it places at least ``least`` pages and ``share`` of all (n_pages: one row, n)."""
    each = items.groupBy("sidebar", "url").agg(F.count("*").alias("times"))
    got = each.groupBy("sidebar").agg(F.count("*").alias("n_placed"), F.bool_or(F.col("times") >= 2).alias("observed"))
    all_pages = n_pages.first()["n"]
    return got.withColumn("is_navigation", (F.col("n_placed") >= least) & (F.col("n_placed") >= F.lit(share * all_pages)))


def value_sets(rows: DataFrame, group: str, value: str, default: str) -> DataFrame:
    """group, values: the distinct values of each group, the default first, the others in order. Values are languages or versions, so
    a group has few."""
    found = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("vs"))
    first = F.filter("vs", lambda v: v == default)
    return found.select(group, F.array_join(F.concat(first, F.filter("vs", lambda v: v != default)), ",").alias("values"))
