"""Links of HTML pages: extraction, resolution, and which of them lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text, urls

#: Addresses in double quotes, single ones or none.
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR = r'<[a-zA-Z][^>]*\s(?:id|name)="([^"]*)"'
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"


def hrefs(html: Column, _: Column) -> Column:
    """Addresses of links as they are written, with their quotes."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))


def links(pages: DataFrame, inside: str | None = None) -> DataFrame:
    """page_id, pos, href in order; ``inside`` narrows to an element, nav for instance. Pages without html have none."""
    if inside:
        html = F.array_join(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rf"(?is)<{inside}\b[^>]*>(.*?)</{inside}>"), F.lit(1)), " ")
        pages = pages.select("page_id", html.alias("html"))
    return text.with_parts(pages, found_hrefs=hrefs).select("page_id", F.posexplode("found_hrefs").alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), text.entities(F.regexp_replace("href", r"""^(["'])(.*)\1$""", "$2")).alias("href"))


def routes(pages: DataFrame) -> DataFrame:
    """page_id, host, route: where each page is, as links are compared."""
    return pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.page_path(urls.path(F.col("url"))).alias("route"))


def resolved(links_: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, pos, href, kind, host, route, fragment: where links of pages lead; host and route are null for what is no page address."""
    own = routes(pages).select("page_id", F.col("host").alias("own_host"), F.col("route").alias("own_route"))
    kind = urls.link_kind(F.col("href"))
    whole = F.when(F.col("kind") == "protocol-relative", F.concat(F.lit("https:"), "href")).when(F.col("kind") == "absolute", F.col("href"))
    bare = F.regexp_replace("href", r"[?#].*$", "")
    beside = F.concat(F.regexp_replace("own_route", "[^/]*$", ""), bare)
    route = (
        F.when(F.col("kind").isin("absolute", "protocol-relative"), urls.page_path(urls.path(whole)))
        .when(F.col("kind") == "root-relative", urls.page_path(urls.without_dots(bare)))
        .when(F.col("kind") == "relative", urls.page_path(urls.without_dots(beside)))
        .when(F.col("kind").isin("fragment", "query"), F.col("own_route"))
    )
    host = F.when(F.col("kind").isin("absolute", "protocol-relative"), urls.host(whole)).when(F.col("kind").isin("root-relative", "relative", "fragment", "query"), F.col("own_host"))
    joined = links_.join(own, "page_id").withColumn("kind", kind)
    return joined.select("page_id", "pos", "href", "kind", host.alias("host"), route.alias("route"), F.regexp_extract("href", "#(.*)$", 1).alias("fragment"))


def broken(resolved_: DataFrame, written: DataFrame, source: DataFrame) -> DataFrame:
    """Links into the site whose target was not written: ``inherited`` if it was no page of the source either, else ``broken``.

    written, source: host, route. Links to hosts outside both are left alone."""
    known = written.select("host").union(source.select("host")).distinct()
    inside = resolved_.filter("route IS NOT NULL AND kind NOT IN ('fragment', 'query')").join(known, "host", "left_semi")
    missing = inside.join(written.select("host", "route").distinct(), ["host", "route"], "left_anti")
    was = source.select("host", "route", F.lit(True).alias("was")).distinct()
    return missing.join(was, ["host", "route"], "left").select("page_id", "pos", "href", "host", "route", F.when(F.col("was"), "broken").otherwise("inherited").alias("status"))


def headed(html: Column, _: Column) -> Column:
    """Headings as they are written, with their tags; a page is read once for level and text."""
    return F.regexp_extract_all(html, F.lit(HEADING), F.lit(0))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, heading of the headings of each page, in order."""
    h = text.with_parts(pages, found_headings=headed).select("page_id", F.posexplode("found_headings").alias("pos", "h"))
    level, inner = (F.regexp_extract("h", HEADING, n) for n in (1, 2))
    return h.select("page_id", F.col("pos").cast("long").alias("pos"), level.cast("long").alias("level"), text.prose(text.entities(F.regexp_replace(inner, "<[^>]*>", ""))).alias("heading"))


def anchors(pages: DataFrame, headings_: DataFrame | None = None) -> DataFrame:
    """page_id, anchor: ids and names of elements, and slugs of headings (of the pages, if not given) with -1, -2 for repeats."""
    from foliograph.operators.headings import numbered_slugs

    named = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(1))).alias("anchor"))
    slugs = numbered_slugs(headings(pages) if headings_ is None else headings_).select("page_id", F.col("slug").alias("anchor"))
    return named.union(slugs).filter("anchor <> ''").distinct()


def lost_fragments(resolved_: DataFrame, page_routes: DataFrame, anchors_: DataFrame) -> DataFrame:
    """Links to a fragment that no anchor of the page they lead to answers; pages that are not known are skipped."""
    to = page_routes.select(F.col("page_id").alias("target_id"), "host", "route")
    asked = resolved_.filter("fragment <> ''").join(to, ["host", "route"])
    have = anchors_.select(F.col("page_id").alias("target_id"), F.col("anchor").alias("fragment"))
    return asked.join(have, ["target_id", "fragment"], "left_anti").select("page_id", "pos", "href", "target_id", "fragment")


def inbound(resolved_: DataFrame) -> DataFrame:
    """host, route, n_links, n_pages: how often pages are linked to."""
    return resolved_.filter("route IS NOT NULL").groupBy("host", "route").agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def unmigrated(resolved_: DataFrame, source: DataFrame, declared: DataFrame, base: str = "/") -> DataFrame:
    """Class of each link to a source host; the first that holds: declared, beside, file, never-published, self, unmigrated.

    source: page_id, host, route of the source's pages; declared: host, route that a rule lets stay."""
    hosts = source.select("host").distinct()
    inside = resolved_.filter("kind IN ('absolute', 'protocol-relative')").join(hosts, "host", "left_semi")
    own = source.select("page_id", F.col("host").alias("own_host"), F.col("route").alias("own_route"))
    named = inside.join(declared.select("host", "route", F.lit(True).alias("declared")).distinct(), ["host", "route"], "left")
    was = named.join(source.select("host", "route", F.lit(True).alias("was")).distinct(), ["host", "route"], "left").join(own, "page_id", "left")
    kind = (
        F.when(F.col("declared"), "declared")
        .when(~urls.within(F.col("route"), F.lit(base)), "beside")
        .when(urls.is_served_file(F.regexp_replace("href", "[?#].*$", "")), "file")
        .when(F.col("was").isNull(), "never-published")
        .when((F.col("host") == F.col("own_host")) & (F.col("route") == F.col("own_route")), "self")
        .otherwise("unmigrated")
    )
    return was.select("page_id", "pos", "href", kind.alias("class"))


def spellings(path: Column, from_filenames: bool = False) -> Column:
    """How a page's path may be spelled, the path itself first: with or without a file's extension and, where paths are made of file
    names, with or without a last segment that stands for its folder."""
    bare = F.regexp_replace(path, r"(?i)\.(?:html?|mdx?)$", "")
    folder = lambda p: F.coalesce(F.nullif(F.regexp_replace(p, r"(?i)/(?:index|readme)$", ""), F.lit("")), F.lit("/"))
    return F.array_distinct(F.array(path, bare, *([folder(path), folder(bare)] if from_filenames else [])))


def site_links(resolved_: DataFrame, routes_: DataFrame, source: DataFrame, hosts: list[str], origin: str | None = None, from_filenames: bool = False) -> DataFrame:
    """page_id, pos, href, target, kind, known: where links of a source lead in the migrated site, with what they had after the path.

    resolved_: see resolved; routes_ (path, route): what became of the source's paths; source (path): all it published; hosts: the
    names the site has, links to which are links of the site. Kinds: ``route`` (a page of any spelling that was migrated, or a route
    as it is written now), ``source`` (not migrated, and the source stays up at ``origin``; for links that name no host), ``kept``, and
    ``outside`` for all other links. known: whether the source published it."""
    inside = F.col("route").isNotNull() & F.when(F.col("kind").isin("absolute", "protocol-relative"), F.col("host").isin(*[h.lower() for h in hosts])).otherwise(F.col("kind").isin("root-relative", "relative"))
    r = resolved_.withColumn("inside", F.coalesce(inside, F.lit(False)))
    tried = r.filter("inside").select("page_id", "pos", F.posexplode(spellings(F.col("route"), from_filenames)).alias("n", "path"))
    led = tried.join(routes_.groupBy("path").agg(F.min("route").alias("to")), "path").groupBy("page_id", "pos").agg(F.min_by("to", "n").alias("to"))
    was = tried.join(source.select("path").distinct(), "path", "left_semi").select("page_id", "pos", F.lit(True).alias("was")).distinct()
    now = routes_.select(F.concat(F.lit("/"), "route").alias("route"), F.lit(True).alias("now")).distinct()
    j = r.join(led, ["page_id", "pos"], "left").join(was, ["page_id", "pos"], "left").join(now, "route", "left")
    named = F.col("kind").isin("absolute", "protocol-relative")
    kind = F.when(~F.col("inside"), "outside").when(F.col("to").isNotNull() | (F.col("now") & ~named), "route").when(~named & F.lit(origin is not None), "source").otherwise("kept")
    after = F.regexp_extract("href", r"^[^?#]*(.*)$", 1)
    path = F.when(F.col("to").isNotNull(), F.when(F.col("to") == "index", "/").otherwise(F.concat(F.lit("/"), "to"))).otherwise(F.col("route"))
    # routes have no file extension any more; the source may need it
    extension = F.regexp_extract(F.regexp_replace("href", r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1)
    there = F.when(F.endswith("route", extension), F.col("route")).otherwise(F.concat("route", extension))
    target = F.when(kind == "route", F.concat(path, after)).when(kind == "source", F.concat(F.lit(origin or ""), there, after)).otherwise(F.col("href"))
    return j.select("page_id", "pos", "href", target.alias("target"), kind.alias("kind"), (F.col("inside") & (F.coalesce("was", F.lit(False)) | F.col("to").isNotNull())).alias("known"))
