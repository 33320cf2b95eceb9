"""URLs and paths as column expressions; all stay in generated code on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Query parameters that only track where a reader came from, and extensions of files that are no pages.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid")
SERVED_EXTENSIONS = ("atom", "csv", "json", "md", "mdx", "pdf", "rss", "txt", "xml", "yaml", "yml", "zip")
OTHER_EXTENSIONS = (
    "aac", "avif", "bmp", "css", "csv", "doc", "docx", "eot", "flac", "gif", "ico", "jfif", "jpe", "jpeg", "jpg", "js", "json", "m4a", "m4v", "map", "mcwebhelp", "mov", "mp3", "mp4", "ogg", "ogv", "otf", "pdf", "png",
    "ppt", "pptx", "rss", "svg", "tar", "tgz", "tif", "tiff", "ttf", "txt", "wav", "webm", "webp", "woff", "woff2", "xls", "xlsx", "xml", "zip",
)
SERVED, NOT_PAGES = (rf"(?i)\.({'|'.join(e)})$" for e in (SERVED_EXTENSIONS, OTHER_EXTENSIONS))
SAFE_LINKS, SAFE_RESOURCES = ("http", "https", "mailto", "tel"), ("http", "https")


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return F.regexp_replace(part(url, 4), r"^\?", "")


def fragment(url: Column) -> Column:
    return F.regexp_replace(part(url, 5), "^#", "")


def kept_params(url: Column) -> Column:
    """The parameters that are no tracking, sorted."""
    named = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    return F.array_sort(named)


def normalised(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking, sorted parameters; null if it is no http(s) address."""
    params = kept_params(url)
    query_part = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    whole = F.concat(scheme(url), F.lit("://"), host(url), F.when(path(url) == "", "/").otherwise(path(url)), query_part)
    return F.when(scheme(url).isin("http", "https"), whole)


def page_path(path_: Column) -> Column:
    """A path as links are compared: no .html, .md or /index at the end, no trailing slash, a leading one."""
    bare = F.regexp_replace(path_, r"\.(html?|mdx?)$", "")
    bare = F.regexp_replace(bare, "/index$", "/")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), "/+$", ""), "^/*", "/")
    return bare


def without_dots(path_: Column) -> Column:
    """A path with its . and .. segments resolved, never above the root; a directory keeps its slash."""

    def step(seen: Column, x: Column) -> Column:
        up = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(x.isin("", "."), seen).when(x == "..", up).otherwise(F.array_append(seen, x))

    kept = F.aggregate(F.split(path_, "/"), F.array().cast("array<string>"), step)
    ends = F.when(path_.rlike(r"(^|/)\.{0,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def markdown_path(path_: Column) -> Column:
    """Where the published Markdown of a page is: /x -> /x.md, / -> /index.md."""
    bare = F.regexp_replace(path_, "/+$", "")
    return F.when(bare == "", "/index.md").otherwise(F.concat(bare, F.lit(".md")))


def of_markdown_path(path_: Column) -> Column:
    """The page of a published Markdown path: /x.md -> /x, /index.md -> /."""
    bare = F.regexp_replace(path_, r"\.mdx?$", "")
    bare = F.regexp_replace(bare, "(^|/)index$", "$1")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def within(path_: Column, base: Column) -> Column:
    """Whether a path is the base or lies beneath it."""
    bare = F.regexp_replace(base, "/+$", "")
    return (path_ == bare) | F.startswith(path_, F.concat(bare, F.lit("/")))


def is_served_file(path_: Column) -> Column:
    return path_.rlike(SERVED)


def is_page_candidate(url: Column, site_host: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) == F.lower(site_host)) & ~path(url).rlike(NOT_PAGES)


def is_safe(url: Column, allowed: tuple[str, ...] = SAFE_LINKS) -> Column:
    """Relative or of an allowed scheme, once control characters and spaces are gone."""
    bare = F.regexp_replace(url, r"[\x00-\x20\x7F]+", "")
    named = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (named == "") | named.isin(*allowed)


def is_public_address(ip: Column) -> Column:
    """Whether an IP address (dotted or IPv6 text) is outside the private, loopback, link-local and reserved ranges."""
    private4 = r"^(0|10|127)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^(22[4-9]|2[3-5][0-9])\."
    private6 = r"(?i)^(::1?$|f[cd]|fe[89ab]|ff|2001:db8:|100::)"
    dotted = lambda a: a.rlike(r"^[0-9]+(\.[0-9]+){3}$") & ~a.rlike(private4)
    mapped = F.regexp_extract(ip, r"(?i)^::ffff:([0-9.]+)$", 1)  # an IPv4 address in IPv6 spelling is judged as what it is
    return F.when(mapped != "", dotted(mapped)).when(ip.contains(":"), ~ip.rlike(private6) & ~ip.rlike("(?i)^::ffff:")).otherwise(dotted(ip))


def link_kind(href: Column) -> Column:
    """fragment, query, mail, phone, absolute, protocol-relative, root-relative, other-scheme or relative."""
    return (
        F.when(href.startswith("#"), "fragment")
        .when(href.startswith("?"), "query")
        .when(href.rlike("^(?i)mailto:"), "mail")
        .when(href.rlike("^(?i)tel:"), "phone")
        .when(href.rlike("^(?i)https?://"), "absolute")
        .when(href.startswith("//"), "protocol-relative")
        .when(href.startswith("/"), "root-relative")
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "other-scheme")
        .otherwise("relative")
    )


def site_bases(url: Column, most: int = 3) -> Column:
    """The origin and the deepest ``most`` directories above a page, deepest first."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    origin = F.concat(scheme(url), F.lit("://"), host(url))
    depth = F.size(parts) - 1
    deep = F.transform(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: k < depth), lambda k: F.concat(origin, F.lit("/"), F.array_join(F.slice(parts, 1, depth - k), "/")))
    return F.concat(deep, F.array(origin))


def splat_redirect(source: Column, destination: Column) -> Column:
    """(source, destination, problem) with :name* or * at the end as * and :splat; a wildcard elsewhere is a problem."""
    wild = r"(:[A-Za-z_][A-Za-z0-9_]*\*|\*)"
    at_end = source.rlike(wild + "$")
    inside = F.regexp_replace(source, wild + "$", "").rlike(wild)
    target = F.regexp_replace(destination, wild + "$", ":splat")
    return F.struct(
        F.when(at_end, F.regexp_replace(source, wild + "$", "*")).otherwise(source).alias("source"),
        F.when(at_end, target).otherwise(destination).alias("destination"),
        F.when(inside, "wildcard inside the path").alias("problem"),
    )


def redirect_class(source: Column) -> Column:
    """exact, named-param or wildcard."""
    return F.when(source.contains("*"), "wildcard").when(source.rlike(":[A-Za-z_]"), "named-param").otherwise("exact")


def video_player(url: Column) -> Column:
    """The embeddable address of a video page; null if it is none that is known."""
    video = F.coalesce(
        F.nullif(F.regexp_extract(url, r"^https?://(?:www\.|m\.)?youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"^https?://youtu\.be/([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"^https?://(?:www\.)?youtube(?:-nocookie)?\.com/(?:embed|shorts)/([A-Za-z0-9_-]{6,})", 1), F.lit("")),
    )
    return F.concat(F.lit("https://www.youtube.com/embed/"), video)


def section_prefixes(path_: Column) -> Column:
    """All prefixes of a path, longest first: an equi-join on them finds the longest declared section."""
    parts = F.filter(F.split(path_, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def name_of_target(path_: Column) -> Column:
    """The last segment of a path, for people."""
    last = F.element_at(F.split(F.regexp_replace(path_, "/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), "[-_]+", " "))


def sitemap_hint(file_url: Column) -> Column:
    """(locale, version, groups) that a sitemap's file name states: sitemap-en-v2-guides.xml."""
    stem = F.regexp_replace(F.element_at(F.split(path(file_url), "/"), -1), r"\.xml(\.gz)?$", "")
    tokens = F.filter(F.split(F.lower(stem), "[-_.]+"), lambda t: (t != "") & ~t.isin("sitemap", "sitemaps", "index"))
    is_locale, is_version = lambda t: t.rlike("^[a-z]{2}$"), lambda t: t.rlike(r"^v[0-9]+$")
    return F.struct(
        F.get(F.filter(tokens, is_locale), F.lit(0)).alias("locale"),
        F.get(F.filter(tokens, is_version), F.lit(0)).alias("version"),
        F.filter(tokens, lambda t: ~is_locale(t) & ~is_version(t) & ~t.rlike("^[0-9]+$")).alias("groups"),
    )


def platform_link(href: Column) -> Column:
    """A page path for the link schemes of hosted platforms (doc:slug, ref:slug, page:slug, changelog:slug); null for other links."""
    kind, slug = F.regexp_extract(href, "^(doc|ref|page|changelog):([^#?]+)", 1), F.regexp_extract(href, "^(doc|ref|page|changelog):([^#?]+)", 2)
    folder = F.when(kind == "doc", "/docs/").when(kind == "ref", "/reference/").when(kind == "page", "/page/").when(kind == "changelog", "/changelog/")
    return F.when(slug != "", F.concat(folder, F.trim(slug), F.regexp_extract(href, "([?#].*)$", 1)))


def route_prefix(locale: Column, version: Column, default_locale: str, newest: str, next_name: str = "next") -> Column:
    """/locale/version before a route: nothing for the default locale and the newest version; the version under work is next."""
    v = F.when(version.isNull() | (version == newest), "").when(version == "current", f"/{next_name}").otherwise(F.concat(F.lit("/"), version))
    l = F.when(locale.isNull() | (locale == default_locale), "").otherwise(F.concat(F.lit("/"), locale))
    return F.concat(l, v)


def decoded_path(path_: Column) -> Column:
    """A path with its percent escapes decoded, but for those of reserved characters; slashes forward, one in front, none at the end.
    A path with a malformed escape stays as written, and + is no space."""
    kept = F.replace(F.regexp_replace(path_, "(?i)%(3B|2F|3F|3A|40|26|3D|2B|24|2C|23)", "%25$1"), F.lit("+"), F.lit("%2B"))
    plain = F.try_url_decode(kept)
    sound = F.when(~plain.contains("�") | path_.contains("�"), plain)
    slashed = F.replace(F.coalesce(sound, path_), F.lit("\\"), F.lit("/"))
    return F.concat(F.when(slashed.startswith("/"), "").otherwise("/"), F.regexp_replace(slashed, "(?<!^)/+$|(?<=^/)/+$", ""))


def on_seed(url: Column, seed: str, aliases: list[str]) -> Column:
    """The address on the origin ``seed`` if its host is one of ``aliases``, with any port; else unchanged."""
    named = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/:?#]+)", 1))
    return F.when(named.isin(*[a.lower() for a in aliases]), F.regexp_replace(url, r"^(?i:https?)://[^/?#]+", seed)).otherwise(url)


def unproxied(url: Column) -> Column:
    """What a resizing image proxy points at, if that is an http(s) address; else the address itself."""
    target = F.try_url_decode(F.regexp_extract(url, r"^[^#]*?[?&]url=([^&#]*)", 1))
    proxy = url.rlike(r"^(?i:https?)://[^?#]*/~gitbook/image/?(\?|#|$)")
    return F.when(proxy & target.rlike("^(?i:https?)://"), target).otherwise(url)


def markdown_problem(status: Column, media: Column, body: Column) -> Column:
    """Why an answer can't stand as a page's Markdown: status, media-type, html-document or empty, the first that holds; null if it can."""
    bare = F.regexp_replace(body, "^﻿", "")
    return (
        F.when(~status.eqNullSafe(200), "status")
        .when(~F.coalesce(media.rlike(r"^\s*(?i:text/(markdown|plain|x-markdown))\s*(;|$)"), F.lit(False)), "media-type")
        .when(bare.rlike(r"^\s*(?i:<!doctype html|<html)\b"), "html-document")
        .when(F.coalesce(~bare.rlike(r"\S"), F.lit(True)), "empty")
    )
