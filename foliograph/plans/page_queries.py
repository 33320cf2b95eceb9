"""Queries over pages: addresses, links, headings, text, sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import text, urls
from foliograph.operators import headings, links, order, reconcile, redirects, sites
from foliograph.workspace import table

_TRACK = "', '".join(urls.TRACKING)
#: The address parts of pages, in SQL; other queries build on it.
PARTS = r"""
parts AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS scheme,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS host,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS path,
         regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4), '^\?', '') AS query,
         regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 5), '^#', '') AS fragment FROM pages)"""
ROUTES = r"""
routes AS (
  SELECT page_id, host, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(path, '\.(html?|mdx?)$', ''), '/index$', '/'), '\', '/'), '/+$', ''), '^/*', '/') AS route FROM parts)"""


def sql_entities(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


LINKS = rf"""
links AS (
  SELECT page_id, pos - 1 AS pos, {sql_entities("href")} AS href FROM (
    SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
      SELECT page_id, regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1) AS h FROM pages)))"""
KIND = r"""
CASE WHEN href LIKE '#%' THEN 'fragment' WHEN href LIKE '?%' THEN 'query' WHEN regexp_matches(href, '^(?i)mailto:') THEN 'mail'
     WHEN regexp_matches(href, '^(?i)tel:') THEN 'phone' WHEN regexp_matches(href, '^(?i)https?://') THEN 'absolute' WHEN href LIKE '//%' THEN 'protocol-relative'
     WHEN href LIKE '/%' THEN 'root-relative' WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'other-scheme' ELSE 'relative' END"""


def _page_path(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '\.(html?|mdx?)$', ''), '/index$', '/'), '\', '/'), '/+$', ''), '^/*', '/')"


def sql_without_dots(x: str) -> str:
    """Segments are kept from the end: a .. is owed one segment, which the next other one pays; what is owed at the root is lost."""
    parts = f"list_filter(string_split({x}, '/'), lambda p: p NOT IN ('', '.'))"
    # owed\x01path so far, from the last segment to the first
    fold = f"list_reduce(list_reverse({parts}), lambda a, p: CASE WHEN p = '..' THEN (split_part(a, chr(1), 1)::INT + 1) || chr(1) || split_part(a, chr(1), 2) WHEN split_part(a, chr(1), 1)::INT > 0 THEN (split_part(a, chr(1), 1)::INT - 1) || chr(1) || split_part(a, chr(1), 2) ELSE '0' || chr(1) || '/' || p || split_part(a, chr(1), 2) END, '0' || chr(1))"
    path = f"split_part({fold}, chr(1), 2)"
    return f"(CASE WHEN {path} = '' THEN '/' ELSE {path} || CASE WHEN split_part(reverse({x}), '/', 1) IN ('', '.', '..') THEN '/' ELSE '' END END)"


RESOLVED = rf"""
kinds AS (SELECT l.*, {KIND} AS kind, r.host AS own_host, r.route AS own_route FROM links l JOIN routes r USING (page_id)),
wholes AS (SELECT *, CASE WHEN kind = 'protocol-relative' THEN 'https:' || href WHEN kind = 'absolute' THEN href END AS whole, regexp_replace(href, '[?#].*$', '') AS bare FROM kinds),
resolved AS (
  SELECT page_id, pos, href, kind,
    CASE WHEN kind IN ('absolute', 'protocol-relative') THEN lower(regexp_extract(whole, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2))
         WHEN kind IN ('root-relative', 'relative', 'fragment', 'query') THEN own_host END AS host,
    CASE WHEN kind IN ('absolute', 'protocol-relative') THEN {_page_path("regexp_extract(whole, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3)")}
         WHEN kind = 'root-relative' THEN {_page_path(sql_without_dots("bare"))}
         WHEN kind = 'relative' THEN {_page_path(sql_without_dots("regexp_replace(own_route, '[^/]*$', '') || bare"))}
         WHEN kind IN ('fragment', 'query') THEN own_route END AS route,
    regexp_extract(href, '#(.*)$', 1) AS fragment FROM wholes)"""
SPACES = r"[ \t\r\n\x0B\f]+"


def sql_prose(x: str) -> str:
    plain_marks = text.PLAIN_QUOTES_AND_SPACES.replace("'", "''")
    plain = f"translate(translate({x}, '{text.QUOTES_AND_SPACES}', '{plain_marks}'), '{text.ZERO_WIDTH}', '')"
    return f"trim(regexp_replace({plain}, '{SPACES}', ' ', 'g'))"


HEADINGS = rf"""
heads AS (
  SELECT page_id, pos - 1 AS pos, level::BIGINT AS level, {sql_prose(sql_entities("regexp_replace(inner_, '<[^>]*>', '', 'g')"))} AS heading FROM (
    SELECT page_id, unnest(l) AS level, unnest(h) AS inner_, generate_subscripts(l, 1) AS pos FROM (
      SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS h FROM pages)))"""
SLUGS = r"""
slugs AS (
  SELECT page_id, pos, CASE WHEN n > 0 THEN slug || '-' || n ELSE slug END AS slug FROM (
    SELECT page_id, pos, slug, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) - 1 AS n FROM (
      SELECT page_id, pos, replace(regexp_replace(lower(trim(heading)), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') AS slug FROM heads)))"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
TITLES = rf"""titles AS (SELECT page_id, url, {sql_prose(sql_entities(f"regexp_extract(html, '{TITLE}', 1)"))} AS title FROM pages)"""


def sql_visible(html: str) -> str:
    bare = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    bare = rf"regexp_replace({bare}, '(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</(script|style|noscript|template|svg)>', '', 'g')"
    bare = rf"regexp_replace({bare}, '(?i)<(/?)(p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|main|br|hr|title|blockquote|pre|dd|dt)\b[^>]*>', chr(10), 'g')"
    bare = sql_entities(f"regexp_replace({bare}, '<[^>]*>', '', 'g')")
    bare = f"regexp_replace({bare}, '[ \\t\\r\\x0B\\f ]+', ' ', 'g')"
    return rf"trim(regexp_replace({bare}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def sql_fingerprint(html: str) -> str:
    for pattern, by in text.VOLATILE:
        html = f"regexp_replace({html}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return rf"sha256(trim(regexp_replace({html}, '\s+', ' ', 'g')))"


def pages(spark, d):
    return table(spark, d, "pages")


def url_parts(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


def url_normalise(spark, d):
    return pages(spark, d).select("page_id", urls.normalised(F.col("url")).alias("normal_url"))


NORMAL = rf"""
normal AS (
  SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS normal_url FROM (
    SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ('{_TRACK}'))) AS params FROM parts))"""


def url_host_counts(spark, d):
    return pages(spark, d).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


def url_path_depth(spark, d):
    depth = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda s: s != "")).cast("long")
    return pages(spark, d).groupBy(depth.alias("depth")).agg(F.count("*").alias("n_pages"))


def tracking_params_stripped(spark, d):
    u = F.col("url")
    n = F.size(F.filter(F.split(urls.query(u), "&"), lambda p: p != "")) - F.size(urls.kept_params(u))
    return pages(spark, d).select("page_id", n.cast("long").alias("n_stripped")).filter("n_stripped > 0")


def alias_fold(spark, d):
    p = pages(spark, d).select("page_id", F.regexp_replace(urls.normalised(F.col("url")), "^https?:", "").alias("address"))
    return p.groupBy("address").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_spellings"))


def common_base_paths(spark, d):
    return sites.common_bases(pages(spark, d).select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")), "host")


def outside_base(spark, d):
    """Pages outside the base path of the language most pages of their host have in their path."""
    p = pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    p = p.withColumn("lang", F.get(F.filter(F.split("path", "/"), lambda s: s != ""), F.lit(0)))
    base = sites.majority(p, "host", "lang").select("host", F.concat(F.lit("/"), "lang").alias("base"))
    return p.join(base, "host").filter(~urls.within(F.col("path"), F.col("base"))).select("page_id", "host", "path", "base")


def served_files(spark, d):
    return pages(spark, d).filter(urls.is_served_file(urls.path(F.col("url"))) | ~urls.is_page_candidate(F.col("url"), urls.host(F.col("url")))).select("page_id", "url")


def html_links(spark, d):
    return links.links(pages(spark, d))


def nav_links(spark, d):
    return links.links(pages(spark, d), "nav")


def link_kinds(spark, d):
    kind = urls.link_kind(F.col("href"))
    return links.links(pages(spark, d)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_links"), F.count_if(~urls.is_safe(F.col("href"))).alias("n_unsafe"))


def _resolved(spark, d):
    p = pages(spark, d)
    return links.resolved(links.links(p), p)


def internal_links_broken(spark, d):
    """Links whose target is no page: every third page counts as not written but known to the source."""
    routes = links.routes(pages(spark, d))
    out = links.broken(_resolved(spark, d), routes.filter("page_id % 3 <> 0"), routes)
    return out.select("page_id", "pos", "href", "status")


def inbound_link_counts(spark, d):
    return links.inbound(_resolved(spark, d))


def unmigrated_links(spark, d):
    p = pages(spark, d)
    routes = links.routes(p)
    own = p.select("page_id", F.lit(0).cast("long").alias("pos"), F.col("url").alias("href"))
    return links.unmigrated(links.resolved(own, p), routes.filter("page_id % 4 <> 1"), routes.filter("page_id % 10 = 0"), "/en")


def html_titles(spark, d):
    title = text.prose(text.entities(F.regexp_extract("html", TITLE, 1)))
    return pages(spark, d).select("page_id", title.alias("title"))


def html_lang_counts(spark, d):
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1)
    return pages(spark, d).groupBy(lang.alias("lang")).agg(F.count("*").alias("n_pages"))


def site_name_unanimous(spark, d):
    """Site names by host, over titles to which two pages of three get a suffix."""
    t = html_titles(spark, d).join(links.routes(pages(spark, d)).select("page_id", "host"), "page_id")
    decorated = F.when(F.length("host") % 3 > 0, F.concat("title", F.lit(" | "), "host")).otherwise(F.col("title"))
    return sites.site_names(t.withColumn("title", decorated), "host")


def heading_outline(spark, d):
    return headings.outlines(links.headings(pages(spark, d)))


def heading_slugs(spark, d):
    return headings.numbered_slugs(links.headings(pages(spark, d)))


def anchors_and_fragments(spark, d):
    """Pages' own address fragments that none of their anchors answers."""
    p = pages(spark, d)
    own = links.resolved(p.select("page_id", F.lit(0).cast("long").alias("pos"), F.col("url").alias("href")), p)
    return links.lost_fragments(own, links.routes(p), links.anchors(p)).select("page_id", "href", "target_id", "fragment")


def visible_text(spark, d):
    v = text.visible(F.col("html"))
    return pages(spark, d).select("page_id", F.length(v).cast("long").alias("n_chars"), F.sha2(v, 256).alias("text_sha256"))


def source_fingerprint(spark, d):
    return pages(spark, d).select("page_id", text.fingerprint(F.col("html")).alias("fingerprint"))


def drift_report(spark, d):
    """Pinned pages against a later fetch: some edited, some only with other scripts, some gone, some new."""
    p = pages(spark, d)
    later = p.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<h1>"), F.lit("<h1>New "))).when(F.col("page_id") % 5 == 1, F.regexp_replace("html", r"track\([0-9]+\)", "track(777)")).otherwise(F.col("html")))
    later = later.filter("page_id % 11 <> 3").withColumn("page_id", F.when(F.col("page_id") % 13 == 7, F.col("page_id") + 1_000_000_000).otherwise(F.col("page_id")))
    side = lambda x: x.select("page_id", text.fingerprint(F.col("html")).alias("fingerprint"))
    return reconcile.drift(side(p), side(later), "page_id", "fingerprint")


def chrome_lines(spark, d):
    """Lines of a page's visible text that consist of its navigation labels and separators only."""
    p = pages(spark, d)
    nav = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav>"), F.lit(1)), " ")
    labels = F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), lambda x: text.entities(x))
    lines = p.select("page_id", labels.alias("labels"), F.posexplode(F.split(text.visible(F.col("html")), "\n")).alias("line_no", "line"))
    bare = F.aggregate("labels", F.col("line"), lambda left, x: F.replace(left, x, F.lit("")))
    hit = lines.filter((F.size("labels") > 0) & (F.col("line") != "") & (F.regexp_replace(bare, r"[\s|·•/>»,-]+", "") == ""))
    return hit.select("page_id", F.col("line_no").cast("long").alias("line_no"), "line")


SIGNALS = [("plain-html", "<article>", 2.0), ("plain-html", "<footer>", 1.0), ("plain-html", 'name="generator"', 1.0), ("tracker", "track[(][0-9]+[)]", 1.0), ("tracker", "<noscript>", 1.0), ("framework", "__NEXT_DATA__", 3.0), ("framework", "data-reactroot", 1.0)]


def platform_scores(spark, d):
    return sites.platform_scores(pages(spark, d), SIGNALS)


def route_plan(spark, d):
    """The new route of each page: its path made legal, with numbers where pages collide; settled pages keep theirs."""
    p = pages(spark, d).select("page_id", urls.page_path(urls.path(F.col("url"))).alias("old"))
    p = p.withColumn("candidate", F.coalesce(F.nullif(text.legal_path(F.col("old")), F.lit("")), F.lit("index")))
    p = p.withColumn("settled", F.concat(F.lit("/"), "candidate") == F.col("old"))
    return reconcile.numbered(p, "candidate", "settled", ["page_id"]).select("page_id", "candidate", "route", "collides")


def slug_titles(spark, d):
    return html_titles(spark, d).select("page_id", text.slug(F.col("title")).alias("slug"), text.slug_erased(F.col("title")).alias("erased"))


def _moves(spark, d):
    """Old and new paths: languages move below /docs, every seventh page is renamed as well."""
    p = links.routes(pages(spark, d)).select("page_id", "route")
    last = F.regexp_extract("route", "([^/]*)$", 1)
    new = F.concat(F.lit("/docs"), F.regexp_replace("route", "/[^/]*$", ""), F.lit("/"), F.when(F.col("page_id") % 97 == 0, F.concat(F.lit("page-"), last)).otherwise(last))
    return p.select(F.col("route").alias("old_path"), new.alias("new_path"))


def redirects_exact(spark, d):
    return redirects.exact(_moves(spark, d)).select("source", "destination")


def redirect_wildcards(spark, d):
    return redirects.wildcards(redirects.exact(_moves(spark, d)))


def redirect_conflicts(spark, d):
    return redirects.conflicts(redirects.exact(_moves(spark, d)))


def even_sample(spark, d):
    return order.even_sample(pages(spark, d).select("page_id", "url"), 24, "page_id").select("page_id", "url", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (
    url_parts, url_normalise, url_host_counts, url_path_depth, tracking_params_stripped, alias_fold, common_base_paths, outside_base, served_files, html_links, nav_links, link_kinds,
    internal_links_broken, inbound_link_counts, unmigrated_links, html_titles, html_lang_counts, site_name_unanimous, heading_outline, heading_slugs, anchors_and_fragments, visible_text,
    source_fingerprint, drift_report, chrome_lines, platform_scores, route_plan, slug_titles, redirects_exact, redirect_wildcards, redirect_conflicts, even_sample)}


def sql_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(translate(replace(replace({x}, 'ß', 'ss'), '&', ' and '), '{text.MARKED}', '{text.PLAIN}')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_BASE = f"WITH {PARTS}"
_NET = f"WITH {PARTS}, {ROUTES}, {LINKS}, {RESOLVED}"
_MOVES = rf"""WITH {PARTS}, {ROUTES},
moves AS (SELECT DISTINCT route AS old_path, '/docs' || regexp_replace(route, '/[^/]*$', '') || '/' || CASE WHEN page_id % 97 = 0 THEN 'page-' ELSE '' END || regexp_extract(route, '([^/]*)$', 1) AS new_path FROM routes),
rules AS (SELECT DISTINCT '/' || trim(old_path, '/') AS source, '/' || trim(new_path, '/') AS destination FROM moves WHERE '/' || trim(old_path, '/') <> '/' || trim(new_path, '/'))"""
ORACLES = {
    "url_parts": f"{_BASE} SELECT page_id, scheme, host, path, query, fragment FROM parts",
    "url_normalise": f"{_BASE}, {NORMAL} SELECT page_id, normal_url FROM normal",
    "url_host_counts": f"{_BASE} SELECT host, count(*) AS n_pages FROM parts GROUP BY 1",
    "url_path_depth": f"{_BASE} SELECT len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth, count(*) AS n_pages FROM parts GROUP BY 1",
    "tracking_params_stripped": f"{_BASE} SELECT * FROM (SELECT page_id, len(list_filter(string_split(query, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) IN ('{_TRACK}'))) AS n_stripped FROM parts) WHERE n_stripped > 0",
    "alias_fold": f"{_BASE}, {NORMAL} SELECT regexp_replace(normal_url, '^https?:', '') AS address, min(page_id) AS page_id, count(*) AS n_spellings FROM normal GROUP BY 1",
    "common_base_paths": f"""{_BASE},
      s AS (SELECT page_id, host, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM parts),
      n AS (SELECT host, count(*) AS n_paths, min(len(segs)) AS least FROM s GROUP BY host),
      k AS (SELECT n.host, n_paths, unnest(range(0, least + 1)) AS depth FROM n),
      ok AS (SELECT k.host, k.n_paths, k.depth, min('/' || array_to_string(s.segs[1:k.depth], '/')) AS base FROM k JOIN s USING (host)
             GROUP BY 1, 2, 3 HAVING count(DISTINCT array_to_string(s.segs[1:k.depth], '/')) = 1)
      SELECT host, n_paths, max_by(base, depth) AS base FROM ok GROUP BY host, n_paths""",
    "outside_base": f"""{_BASE},
      l AS (SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda s: s <> '')[1] AS lang FROM parts),
      b AS (SELECT host, lang FROM (SELECT host, lang, count(*) AS n FROM l WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, lang) = 1)
      SELECT page_id, host, path, '/' || b.lang AS base FROM l JOIN b USING (host) WHERE NOT (path = '/' || b.lang OR starts_with(path, '/' || b.lang || '/'))""",
    "served_files": f"{_BASE} SELECT page_id, url FROM parts WHERE regexp_matches(path, '{urls.SERVED}') OR NOT (scheme IN ('http', 'https') AND NOT regexp_matches(path, '{urls.NOT_PAGES}'))",
    "html_links": f"WITH {LINKS} SELECT page_id, pos, href FROM links",
    "nav_links": rf"""WITH n AS (SELECT page_id, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), ' '), '<a\b[^>]*href="([^"]*)"', 1) AS h FROM pages)
      SELECT page_id, pos - 1 AS pos, {sql_entities("href")} AS href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM n)""",
    "link_kinds": rf"""WITH {LINKS}, s AS (SELECT {KIND} AS kind, lower(regexp_extract(regexp_replace(href, '[\x00-\x20\x7F]+', '', 'g'), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM links)
      SELECT kind, count(*) AS n_links, count(*) FILTER (scheme NOT IN ('', 'http', 'https', 'mailto', 'tel')) AS n_unsafe FROM s GROUP BY 1""",
    "internal_links_broken": f"""{_NET}
      SELECT r.page_id, r.pos, r.href, CASE WHEN EXISTS (SELECT 1 FROM routes s WHERE s.host = r.host AND s.route = r.route) THEN 'broken' ELSE 'inherited' END AS status
      FROM resolved r WHERE r.route IS NOT NULL AND r.kind NOT IN ('fragment', 'query') AND r.host IN (SELECT host FROM routes)
        AND NOT EXISTS (SELECT 1 FROM routes w WHERE w.page_id % 3 <> 0 AND w.host = r.host AND w.route = r.route)""",
    "inbound_link_counts": f"{_NET} SELECT host, route, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM resolved WHERE route IS NOT NULL GROUP BY 1, 2",
    "unmigrated_links": rf"""WITH {PARTS}, {ROUTES}, source AS (SELECT * FROM routes WHERE page_id % 4 <> 1)
      SELECT r.page_id, 0::BIGINT AS pos, p.url AS href, CASE
        WHEN EXISTS (SELECT 1 FROM routes x WHERE x.page_id % 10 = 0 AND x.host = r.host AND x.route = r.route) THEN 'declared'
        WHEN NOT (r.route = '/en' OR starts_with(r.route, '/en/')) THEN 'beside'
        WHEN regexp_matches(regexp_replace(p.url, '[?#].*$', ''), '{urls.SERVED}') THEN 'file'
        WHEN NOT EXISTS (SELECT 1 FROM source s WHERE s.host = r.host AND s.route = r.route) THEN 'never-published'
        WHEN r.page_id % 4 <> 1 THEN 'self' ELSE 'unmigrated' END AS class
      FROM routes r JOIN parts p USING (page_id) WHERE r.host IN (SELECT host FROM source)""",
    "html_titles": f"WITH {TITLES} SELECT page_id, title FROM titles",
    "html_lang_counts": r"""SELECT regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, count(*) AS n_pages FROM pages GROUP BY 1""",
    "site_name_unanimous": f"""WITH {PARTS}, {TITLES},
      t AS (SELECT p.host, CASE WHEN length(p.host) % 3 > 0 THEN title || ' | ' || p.host ELSE title END AS title FROM titles JOIN parts p USING (page_id)),
      s AS (SELECT host, CASE WHEN contains(title, ' | ') THEN trim(string_split(title, ' | ')[-1]) WHEN contains(title, ' — ') THEN trim(string_split(title, ' — ')[-1])
              WHEN contains(title, ' – ') THEN trim(string_split(title, ' – ')[-1]) WHEN contains(title, ' - ') THEN trim(string_split(title, ' - ')[-1])
              WHEN contains(title, ' · ') THEN trim(string_split(title, ' · ')[-1]) END AS suffix FROM t WHERE trim(title) <> '')
      SELECT host, CASE WHEN count(*) = count(suffix) AND count(suffix) >= 2 AND count(DISTINCT suffix) = 1 THEN min(suffix) END AS site_name FROM s GROUP BY host""",
    "heading_outline": f"""WITH {HEADINGS},
      k AS (SELECT *, lag(level || ':' || heading) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM heads)
      SELECT page_id, count(*) AS n_headings, string_agg(level || ':' || heading, '|' ORDER BY pos) AS outline FROM k WHERE before IS DISTINCT FROM level || ':' || heading GROUP BY page_id""",
    "heading_slugs": f"WITH {HEADINGS}, {SLUGS} SELECT page_id, pos, slug FROM slugs",
    "anchors_and_fragments": rf"""WITH {PARTS}, {ROUTES}, {HEADINGS}, {SLUGS},
      anchors AS (SELECT page_id, slug AS anchor FROM slugs UNION SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*\s(?:id|name)="([^"]*)"', 1)) FROM pages)
      SELECT p.page_id, p.url AS href, t.page_id AS target_id, p.fragment FROM parts p JOIN routes o USING (page_id) JOIN routes t ON t.host = o.host AND t.route = o.route
      WHERE p.fragment <> '' AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.page_id = t.page_id AND a.anchor = p.fragment AND a.anchor <> '')""",
    "visible_text": f"WITH v AS (SELECT page_id, {sql_visible('html')} AS t FROM pages) SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM v",
    "source_fingerprint": f"SELECT page_id, {sql_fingerprint('html')} AS fingerprint FROM pages",
    "drift_report": rf"""
      WITH later AS (SELECT CASE WHEN page_id % 13 = 7 THEN page_id + 1000000000 ELSE page_id END AS page_id,
          CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h1>New ') WHEN page_id % 5 = 1 THEN regexp_replace(html, 'track\([0-9]+\)', 'track(777)', 'g') ELSE html END AS html
        FROM pages WHERE page_id % 11 <> 3),
      a AS (SELECT page_id, {sql_fingerprint("html")} AS f FROM pages), b AS (SELECT page_id, {sql_fingerprint("html")} AS f FROM later)
      SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'added' WHEN b.page_id IS NULL THEN 'missing' WHEN a.f = b.f THEN 'same' ELSE 'changed' END AS status
      FROM a FULL JOIN b ON a.page_id = b.page_id""",
    "chrome_lines": rf"""
      WITH v AS (SELECT page_id, string_split({sql_visible("html")}, chr(10)) AS ls,
          list_transform(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), ' '), '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: {sql_entities("x")}) AS labels FROM pages),
      l AS (SELECT page_id, labels, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM v),
      b AS (SELECT *, list_reduce(labels, lambda left_, x: replace(left_, x, ''), line) AS bare FROM l WHERE len(labels) > 0)
      SELECT page_id, line_no, line FROM b WHERE line <> '' AND regexp_replace(bare, '[\s|·•/>»,-]+', '', 'g') = ''""",
    "platform_scores": "WITH s(platform, pattern, weight) AS (VALUES " + ", ".join(f"('{n}', '{p}', {w}::DOUBLE)" for n, p, w in SIGNALS) + """),
      h AS (SELECT platform, weight, max(CASE WHEN regexp_matches(html, pattern) THEN 1 ELSE 0 END) AS hit FROM s, pages GROUP BY platform, weight, pattern)
      SELECT platform, sum(weight * hit)::DOUBLE AS hit, sum(weight)::DOUBLE AS applicable, (sum(weight * hit) / sum(weight))::DOUBLE AS confidence FROM h GROUP BY platform HAVING sum(weight * hit) > 0""",
    "route_plan": rf"""WITH {PARTS}, {ROUTES},
      c AS (SELECT page_id, route AS old, coalesce(nullif(array_to_string(list_transform(list_filter(string_split(route, '/'), lambda s: s <> ''), lambda s: {sql_slug("s")}), '/'), ''), 'index') AS candidate FROM routes),
      n AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY '/' || candidate = old DESC, page_id) AS place FROM c),
      used AS (SELECT DISTINCT regexp_extract(candidate, '^(.*)-([0-9]+)$', 1) AS base, try_cast(regexp_extract(candidate, '^(.*)-([0-9]+)$', 2) AS INT) AS u FROM c),
      free AS (SELECT candidate, k, row_number() OVER (PARTITION BY candidate ORDER BY k) + 1 AS place FROM
        (SELECT candidate, unnest(range(2, max(place) + 2 + (SELECT count(*) FROM used u WHERE u.base = n.candidate))) AS k FROM n GROUP BY candidate) x
        WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.base = x.candidate AND u.u = x.k))
      SELECT n.page_id, n.candidate, CASE WHEN n.place = 1 THEN n.candidate ELSE n.candidate || '-' || f.k END AS route, n.place > 1 AS collides
      FROM n LEFT JOIN free f ON f.candidate = n.candidate AND f.place = n.place""",
    "slug_titles": rf"""WITH {TITLES} SELECT page_id, {sql_slug("title")} AS slug,
      regexp_matches(regexp_replace(translate(replace(title, 'ß', 'ss'), '{text.MARKED}', '{text.PLAIN}'), '[A-Za-z]', '', 'g'), '\p{{L}}') AS erased FROM titles""",
    "redirects_exact": f"{_MOVES} SELECT source, destination FROM rules",
    "redirect_wildcards": rf"""{_MOVES},
      r AS (SELECT *, regexp_replace(source, '/[^/]*$', '') AS old, regexp_replace(destination, '/[^/]*$', '') AS new FROM rules),
      f AS (SELECT old, new, count(*) AS covered FROM r WHERE old <> '' AND new <> '' AND old <> new GROUP BY 1, 2
            HAVING count(*) >= 3 AND bool_and(regexp_extract(source, '([^/]*)$', 1) = regexp_extract(destination, '([^/]*)$', 1)))
      SELECT old || '/*' AS source, new || '/:splat' AS destination, covered FROM f
      WHERE NOT EXISTS (SELECT 1 FROM rules x WHERE starts_with(x.source, f.old || '/') AND x.destination <> f.new || substr(x.source, length(f.old) + 1))""",
    "redirect_conflicts": f"{_MOVES} SELECT source, count(DISTINCT destination) AS n_destinations FROM rules GROUP BY 1 HAVING count(DISTINCT destination) > 1",
    "even_sample": """WITH p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS place, count(*) OVER () AS n FROM pages)
      SELECT page_id, url, place FROM p WHERE n <= 24 OR place IN (SELECT floor(i * (n - 1) / 23.0 + 0.5)::BIGINT FROM range(24) t(i))""",
}
