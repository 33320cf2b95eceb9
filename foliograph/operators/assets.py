"""Assets: where pages refer to them, which are the same, and what their links become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text, urls

# Elements and attributes of HTML that load media.
MEDIA = (("image", r'(?i)<img\b[^>]*?\ssrc="([^"]*)"'), ("video", r'(?i)<video\b[^>]*?\ssrc="([^"]*)"'), ("audio", r'(?i)<audio\b[^>]*?\ssrc="([^"]*)"'), ("source", r'(?i)<source\b[^>]*?\ssrc="([^"]*)"'), ("poster", r'(?i)\sposter="([^"]*)"'), ("frame", r'(?i)<iframe\b[^>]*?\ssrc="([^"]*)"'), ("social", r'(?i)<meta\b[^>]*property="og:image"[^>]*content="([^"]*)"'))
SRCSET = r'(?i)\ssrcset="([^"]*)"'
#: What a text must have, in lower case, for a pattern to match.
MARKS = {p: {"image": "<img", "poster": 'poster="', "frame": "<iframe", "social": 'property="og:image"'}.get(kind, f"<{kind}") for kind, p in MEDIA} | {SRCSET: 'srcset="'}


def media(html: Column, lower: Column) -> Column:
    """kind, url of what HTML loads, as an array; patterns whose fixed part isn't in it (``lower``: it in lower case) aren't looked for."""
    none = F.array().cast("array<string>")
    found = lambda p: F.coalesce(F.when(F.contains(lower, F.lit(MARKS[p])), F.regexp_extract_all(html, F.lit(p), F.lit(1))), none)
    of = lambda kind, found_: F.transform(found_, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))
    variants = F.flatten(F.transform(found(SRCSET), lambda s: F.transform(F.split(s, r",\s+"), lambda v: F.regexp_extract(F.trim(v), r"^(\S+)", 1))))
    return F.concat(*[of(kind, found(p)) for kind, p in MEDIA], of("srcset", variants))


def references(pages: DataFrame) -> DataFrame:
    """page_id, kind, url: what pages (page_id, html) load; srcset counts each of its variants; data: addresses are left out."""
    # all kinds in one reading of the page
    rows = text.with_parts(pages, found_media=media).select("page_id", F.explode("found_media").alias("x")).select("page_id", "x.kind", text.entities(F.trim("x.url")).alias("url"))
    return rows.filter("url <> '' AND NOT startswith(lower(url), 'data:')")


def missing_alt(pages: DataFrame) -> DataFrame:
    """page_id, n_images, n_without_alt."""
    images = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    alt = F.filter(images, lambda i: ~i.rlike(r'(?i)\salt="[^"]*[^"\s][^"]*"'))
    return pages.select("page_id", F.size(images).cast("long").alias("n_images"), F.size(alt).cast("long").alias("n_without_alt")).filter("n_images > 0")


def manifest(fetched: DataFrame, references_: DataFrame) -> DataFrame:
    """hash, bytes, n_urls, n_pages, first_url: assets by content (fetched: url, content) and how widely they are used.

    Addresses of one content are counted, not gathered, so a picture on every page is one row as any other."""
    f = fetched.select("url", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("bytes"))
    one = f.groupBy("hash").agg(F.min("bytes").alias("bytes"), F.count_distinct("url").alias("n_urls"), F.min("url").alias("first_url"))
    use = references_.select("url", "page_id").distinct().join(f.select("url", "hash").distinct(), "url").groupBy("hash").agg(F.count_distinct("page_id").alias("n_pages"))
    return one.join(use, "hash", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)).cast("long"))


def tally(references_: DataFrame) -> DataFrame:
    return references_.groupBy("kind").agg(F.count("*").alias("n"))


def rewritten(references_: DataFrame, final: DataFrame, excluded: DataFrame) -> DataFrame:
    """page_id, kind, url, final_url, status: hosted, excluded or unhosted, by final (url, final_url) and excluded (url)."""
    e = excluded.select("url", F.lit(True).alias("out")).distinct()
    r = references_.join(e, "url", "left").join(final.dropDuplicates(["url"]), "url", "left")
    status = F.when(F.col("out"), "excluded").when(F.coalesce("final_url", F.lit("")) != "", "hosted").otherwise("unhosted")
    return r.select("page_id", "kind", "url", F.when(~F.coalesce("out", F.lit(False)), F.col("final_url")).alias("final_url"), status.alias("status"))


def stated(html: Column, lower: Column) -> Column:
    """canonical, description, robots, social_title as HTML has them, null or empty if it doesn't, as a struct; see media for ``lower``."""
    found = lambda mark, before, after: F.when(F.contains(lower, F.lit(mark)), F.regexp_extract(html, rf'(?i)<{before}\b[^>]*\b{mark}[^>]*\b{after}="([^"]*)"', 1))
    meta = {name: found(mark, "meta", "content") for name, mark in (("description", 'name="description"'), ("robots", 'name="robots"'), ("social_title", 'property="og:title"'))}
    return F.struct(found('rel="canonical"', "link", "href").alias("canonical"), *[x.alias(name) for name, x in meta.items()])


def seo(pages: DataFrame) -> DataFrame:
    """page_id, canonical, description, robots, social_title: what a page states of itself; a canonical address that is the page's own
    is none."""
    s = text.with_parts(pages, found_statements=stated)
    said = lambda name: F.nullif(text.entities(F.col("found_statements")[name]), F.lit(""))
    canonical = said("canonical")
    whole = F.when(canonical.startswith("/"), F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), canonical)).otherwise(canonical)
    own = F.concat(urls.host(F.col("url")), urls.page_path(urls.path(F.col("url"))))
    same = F.concat(urls.host(whole), urls.page_path(urls.path(whole))) == own
    return s.select("page_id", F.when(~same, whole).alias("canonical"), *[said(name).alias(name) for name in ("description", "robots", "social_title")])


def metadata_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, field, was, now of descriptions and robots lines that differ; a page that lost its row differs in all it had."""
    fields = ["canonical", "description", "robots", "social_title"]
    a = before.select("page_id", *[F.col(f).alias(f"a_{f}") for f in fields])
    both = a.join(after, "page_id", "left")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("was"), F.col(f).alias("now")) for f in fields]))
    return both.select("page_id", rows.alias("r")).select("page_id", "r.*").filter(~F.col("was").eqNullSafe(F.col("now")))
