"""Published indexes of a site: robots.txt, sitemaps, llms.txt, SUMMARY.md."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text, urls
from foliograph.operators import order
from foliograph.workspace import written


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, prefix: what robots.txt files (host, body) disallow for ``agent``: groups that name it, or * where none does.

    User-agent lines that follow one another open one group."""
    lines = order.lines_of(files, "host", "body")
    field = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"#.*$", ""))
    rows = lines.select("host", "line_no", field.alias("field"), value.alias("value")).filter("field IN ('user-agent', 'disallow', 'allow')")
    starts = (F.col("field") == "user-agent") & ~F.coalesce(F.lag("field").over(Window.partitionBy("host").orderBy("line_no")) == "user-agent", F.lit(False))
    rows = order.carried(rows.withColumn("starts", starts), ["host"], ["line_no"], F.when(F.col("starts"), F.col("line_no")), "group")
    named = rows.filter("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    mine = named.filter(F.col("agent").isin("*", agent.lower())).groupBy("host", "group").agg(F.max((F.col("agent") != "*").cast("int")).alias("own"))
    best = mine.groupBy("host").agg(F.max("own").alias("own"))
    rules = rows.filter("field = 'disallow' AND value <> ''").join(mine.join(best, ["host", "own"]), ["host", "group"])
    return rules.select("host", F.regexp_replace("value", r"\*$", "").alias("prefix")).distinct()


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """host, url of Sitemap lines."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return files.select("host", F.explode(found).alias("url")).distinct()


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (url) that no rule's prefix covers. Rules meet paths on equal prefixes, of the lengths that rules have."""
    r = rules.select(F.col("host"), F.col("prefix"), F.length("prefix").alias("n"))
    lengths = r.groupBy("host").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    p = pages.withColumns({"host": urls.host(F.col("url")), "__path": urls.path(F.col("url"))}).join(lengths, "host", "left")
    cut = p.select("url", "host", F.explode("lengths").alias("n"), "__path").select("url", "host", F.substring("__path", F.lit(1), F.col("n")).alias("prefix"))
    hit = cut.join(r.select("host", "prefix"), ["host", "prefix"], "left_semi").select("url").distinct()
    return pages.join(hit, "url", "left_anti")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """file, loc, lastmod, priority, alternates of <url> elements of sitemap files (file, body); the first entry of a loc in a file."""
    each = files.select("file", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))).alias("pos", "x"))
    one = lambda tag: F.nullif(F.trim(text.entities(F.regexp_extract("x", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), F.lit(""))
    alternates = F.regexp_extract_all("x", F.lit(r'(?is)<xhtml:link\b[^>]*href="([^"]*)"'), F.lit(1))
    e = each.select("file", "pos", one("loc").alias("loc"), one("lastmod").alias("lastmod"), one("priority").try_cast("double").alias("priority"), alternates.alias("alternates")).filter("loc IS NOT NULL")
    first = e.groupBy("file", "loc").agg(F.min_by(F.struct("lastmod", "priority", "alternates"), "pos").alias("y"))
    return first.select("file", "loc", "y.lastmod", "y.priority", "y.alternates")


def sitemap_children(files: DataFrame) -> DataFrame:
    """file, child: the sitemaps that index files name."""
    inner = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc>(.*?)</loc>.*?</sitemap>"), F.lit(1)))
    return files.select("file", inner.alias("c")).select("file", F.trim(text.entities(F.col("c"))).alias("child"))


def sitemap_tree(files: DataFrame, roots: DataFrame, most_depth: int = 8) -> DataFrame:
    """file, depth of the sitemap files that ``roots`` (file) reach through index files; one join a level, each file once."""
    edges = written(sitemap_children(files).distinct(), "sitemaps")
    seen = written(roots.select("file").distinct().withColumn("depth", F.lit(0)), "sitemaps")
    level = seen
    for depth in range(1, most_depth + 1):
        level = level.select("file").join(edges, "file").select(F.col("child").alias("file")).distinct().join(seen.select("file"), "file", "left_anti")
        level = written(level.withColumn("depth", F.lit(depth)), "sitemaps")
        if not level.take(1):
            break
        seen = seen.union(level)
    return seen


def llms_entries(files: DataFrame) -> DataFrame:
    """file, line_no, section, title, url, description of the link lines of llms.txt files (file, body)."""
    lines = order.lines_of(files, "file", "body")
    lines = order.carried(lines, ["file"], ["line_no"], F.nullif(F.regexp_extract("line", r"^##+\s+(.*\S)\s*$", 1), F.lit("")), "section")
    link = r"^\s*[-*+]\s+\[([^\]]+)\]\(([^)\s]+)\)(?:\s*:\s*(.*\S))?\s*$"
    e = lines.select("file", "line_no", "section", *[F.regexp_extract("line", link, k).alias(n) for k, n in ((1, "title"), (2, "url"), (3, "description"))])
    return e.filter("url <> ''").withColumn("description", F.nullif("description", F.lit("")))


def llms_conflicts(entries: DataFrame) -> DataFrame:
    """Paths that entries give different titles or descriptions."""
    from foliograph.operators.reconcile import conflicting

    return conflicting(entries.withColumn("path", urls.of_markdown_path(urls.path(F.col("url")))), ["path"], ["title", "description"])


def summary_nodes(files: DataFrame) -> DataFrame:
    """file, line_no, indent, title, target, parent, section of the bullets of SUMMARY files (file, body): parent is the line of the
    nearest bullet above that is indented less; outside links have no target."""
    lines = order.lines_of(files, "file", "body")
    lines = order.carried(lines, ["file"], ["line_no"], F.nullif(F.regexp_extract("line", r"^##+\s+(.*\S)\s*$", 1), F.lit("")), "section")
    bullet = r"^(\s*)[-*+]\s+\[([^\]]*)\]\(([^)]*)\)"
    b = lines.filter(F.col("line").rlike(bullet)).select("file", F.col("line_no").cast("bigint").alias("line_no"), F.length(F.regexp_replace(F.regexp_extract("line", bullet, 1), "\t", "  ")).cast("bigint").alias("indent"), F.regexp_extract("line", bullet, 2).alias("title"), F.regexp_extract("line", bullet, 3).alias("target"), F.coalesce("section", F.lit("")).alias("section"))
    b = b.withColumn("target", F.when(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//"), F.regexp_replace("target", r"[?#].*$", "")))
    return order.parents_by_indent(b, ["file", "section"], "line_no", "indent")


def discovery_order(found: DataFrame) -> DataFrame:
    """url, place, reasons of discovered pages (url, reason, hint): sidebar before sitemap before crawl, then hint, then address."""
    tier = F.when(F.col("reason") == "sidebar", 0).when(F.col("reason") == "sitemap", 1).otherwise(2)
    one = found.groupBy("url").agg(F.min(tier).alias("tier"), F.min("hint").alias("hint"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return order.placed(one.withColumn("hint", F.coalesce("hint", F.lit(2**62))), "tier", "hint", "url").select("url", "place", "reasons")
