"""Gates over a linked site and two copies of it, one exact, one damaged. The site is the pages with sections, links, pictures and code
of their own at the end, so that links resolve."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import assets, findings, links, passages
from foliograph.plans import gates
from foliograph.plans.page_queries import sql_entities, sql_visible
from foliograph.workspace import table, written


def _site(spark, d, damaged=False):
    """page_id, url, html. A damaged copy lacks and alters things by turns of the page's number."""
    page = F.col("page_id")
    k = lambda n: (page + n).cast("string")
    bad = lambda n, turn: F.lit(damaged) & (page % n == turn)
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://docs.example.com/p/"), k(0)).alias("url"), F.replace("html", F.lit('href="/'), F.lit('href="https://elsewhere.example/')).alias("html"))
    head = F.concat(F.lit('<head><meta name="description" content="D'), k(0), F.when(bad(11, 2), " changed").otherwise(""), F.lit('">'))
    section = F.when(bad(7, 1), F.lit("")).otherwise(F.concat(F.lit('<h2 id="a'), k(0), F.lit('">Part '), k(0), F.lit("</h2>")))
    extra = F.when(bad(7, 2), F.lit("<h2>Extra</h2>")).otherwise("")
    goes = F.concat(F.lit('<a href="/p/'), k(1), F.lit('">n</a> <a href="'), k(2), F.lit("#a"), k(2), F.lit('">m</a> <a href="https://docs.example.com/p/'), k(3), F.lit('">o</a>'))
    code = F.concat(F.lit("<pre><code>run "), k(0), F.when(bad(13, 5), " --fast").otherwise(""), F.lit(" &amp;&amp; stop</code></pre>"))
    held = F.when(bad(17, 4), F.lit("[[held:x]] [[held:y]]")).otherwise("")
    picture = F.concat(F.lit('<img alt="a" src="/i/'), (page % 9).cast("string"), F.lit('.png">'))
    html = F.concat(F.replace("html", F.lit("<head>"), head), section, extra, goes, code, held, picture)
    return p.withColumn("html", html)


def _without_navigation(p):
    return p.withColumn("html", F.regexp_replace("html", r"(?is)<nav\b[^>]*>.*?</nav>", ""))


def _findings(spark, d, damaged):
    source = _site(spark, d)
    copy = _site(spark, d, damaged)
    copy = copy.filter("page_id % 10 <> 3") if damaged else _without_navigation(copy)
    # what gates look at is small beside the pages it is found in; only text and anchors are looked for in the pages themselves
    was = written(findings.parts(source, "found_headings", "found_codes", "found_statements"), "was")
    shown = written(findings.parts(copy), "shown")
    went = written(links.resolved(links.links(shown), shown), "went")
    references = assets.references(shown)
    final = references.select("url").distinct().withColumn("final_url", F.concat(F.lit("https://cdn.example"), "url"))
    final = final.filter("url <> '/i/4.png'") if damaged else final
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("node_id"), "o_orderstatus", "o_orderpriority")
    by_rule, decided = (o.filter(c).select("page_id", "node_id") for c in ("o_orderpriority LIKE '1%'", "o_orderpriority LIKE '2%'"))
    excluded = o.filter("o_orderstatus = 'P'") if damaged else o.filter("o_orderpriority LIKE '1%'")
    nav = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.when(F.lit(damaged) & (F.col("c_custkey") % 8 == 1), F.when(F.col("c_custkey") % 3 > 0, "guessed")).otherwise("dom-sidebar").alias("provenance"))
    return {
        "assets-ready": findings.unhosted(references, final, final.filter("url = '/i/5.png'")),
        "chrome-absent": findings.chrome_lines(copy, source),
        "code-blocks-exact": passages.missing_code(findings.code_of(was).join(shown.select("page_id"), "page_id", "left_semi"), findings.code_of(shown)),
        "fragments-resolve": links.lost_fragments(went, links.routes(shown), links.anchors(copy, links.headings(shown))),
        "headings-sequence": findings.heading_differences(was, shown),
        "html-reconciliation": findings.headings_out_of_order(was, shown),
        "internal-links": links.broken(went, links.routes(shown), links.routes(was)).filter("status = 'broken'"),
        "no-authored-exclusions": findings.authored_exclusions(excluded, by_rule, decided),
        "no-unresolved-blocks": findings.placeholders(shown),
        "source-metadata-exact": assets.metadata_changes(assets.seo(was).join(shown.select("page_id"), "page_id", "left_semi"), assets.seo(shown)),
        "source-navigation-proven": findings.unproven(nav),
    }


def gates_of_an_exact_copy(spark, d):
    found = _findings(spark, d, damaged=False)
    return gates.rollup(spark, found, [*found, "never-looked-at"])


def gates_of_a_damaged_copy(spark, d):
    found = _findings(spark, d, damaged=True)
    return gates.rollup(spark, found, list(found))


def site_links(spark, d):
    """Links of each page in all spellings; three of four pages were migrated."""
    k = lambda n: (F.col("page_id") + n).cast("string")
    a = lambda *parts: F.concat(F.lit("<a href="), *[x if not isinstance(x, str) else F.lit(x) for x in parts], F.lit(">x</a>"))
    html = F.concat(a('"/p/', k(0), '.html#x"'), a("'", k(1), "?y=1'"), a("https://Docs.example.com/p/", k(2), "/index"), a('"//alias.example/p/', k(3), '.md"'), a("#here"), a('"mailto:a@b.example"'), a('"/guide/', k(0), '"'), a('"https://other.example/p/', k(0), '"'), a('"../gone/', k(0), '#z"'))
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://docs.example.com/p/"), k(0)).alias("url"), html.alias("html"))
    path = F.concat(F.lit("/p/"), k(0))
    routes = p.filter("page_id % 4 < 3").select(path.alias("path"), F.concat(F.lit("guide/"), k(0)).alias("route"))
    got = links.site_links(links.resolved(links.links(p), p), routes, p.select(path.alias("path")), ["docs.example.com", "alias.example"], "https://docs.example.com", from_filenames=True)
    return got.select("page_id", "pos", "target", "kind", "known")


QUERIES = {f.__name__: f for f in (gates_of_an_exact_copy, gates_of_a_damaged_copy, site_links)}

_NAMES = ("assets-ready", "chrome-absent", "code-blocks-exact", "fragments-resolve", "headings-sequence", "html-reconciliation", "internal-links", "no-authored-exclusions", "no-unresolved-blocks", "source-metadata-exact", "source-navigation-proven")
ORACLES = {
    "gates_of_an_exact_copy": f"""
      SELECT unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) AS gate, 'pass' AS status, 0::BIGINT AS count UNION ALL SELECT 'never-looked-at', 'fail', NULL""",
    "gates_of_a_damaged_copy": """
      WITH s AS (SELECT page_id AS k FROM pages), c AS (SELECT k FROM s WHERE k % 10 <> 3),
      v AS (SELECT page_id, string_split(""" + sql_visible("html") + r""", chr(10)) AS ls, string_split(""" + sql_visible(r"regexp_replace(html, '(?is)<nav\b[^>]*>.*?</nav>', chr(10), 'g')") + r""", chr(10)) AS own,
        list_transform(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), ' '), '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: """ + sql_entities("x") + r""") AS labels FROM pages WHERE page_id % 10 <> 3),
      l AS (SELECT page_id, labels, own, unnest(ls) AS line FROM v WHERE len(labels) > 0),
      chrome AS (SELECT page_id, line FROM l WHERE line <> '' AND NOT list_contains(own, line) AND regexp_replace(list_reduce(labels, lambda left_, x: replace(left_, x, ''), line), '[\s|·•/>»,-]+', '', 'g') = ''),
      n AS (
        SELECT 'assets-ready' AS gate, count(*) AS count FROM c WHERE k % 9 = 4
        UNION ALL SELECT 'chrome-absent', count(*) FROM chrome
        UNION ALL SELECT 'code-blocks-exact', count(*) FROM c WHERE k % 13 = 5
        UNION ALL SELECT 'fragments-resolve', count(*) FROM c JOIN c t ON t.k = c.k + 2 WHERE t.k % 7 = 1
        UNION ALL SELECT 'headings-sequence', count(*) FROM c WHERE k % 7 IN (1, 2)
        UNION ALL SELECT 'html-reconciliation', count(*) FROM c WHERE k % 7 = 1
        UNION ALL SELECT 'internal-links', count(*) FROM c JOIN s t ON t.k - c.k IN (1, 2, 3) WHERE t.k % 10 = 3
        UNION ALL SELECT 'no-authored-exclusions', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%'
        UNION ALL SELECT 'no-unresolved-blocks', count(*) FROM c WHERE k % 17 = 4
        UNION ALL SELECT 'source-metadata-exact', count(*) FROM c WHERE k % 11 = 2
        UNION ALL SELECT 'source-navigation-proven', count(*) FROM customer WHERE c_custkey % 8 = 1)
      SELECT gate, CASE WHEN count > 0 THEN 'fail' ELSE 'pass' END AS status, count FROM n""",
    "site_links": """
      WITH s AS (SELECT page_id AS k FROM pages), m AS (SELECT k FROM s WHERE k % 4 < 3),
      l(pos, off, spelled, rest, named) AS (VALUES (0, 0, '.html', '#x', false), (1, 1, '', '?y=1', false), (2, 2, '/index', '', true), (3, 3, '.md', '', true)),
      p AS (SELECT s.k AS page_id, pos, s.k + off AS t, spelled, rest, named, EXISTS (SELECT 1 FROM m WHERE m.k = s.k + off) AS moved, EXISTS (SELECT 1 FROM s q WHERE q.k = s.k + off) AS known FROM s, l)
      SELECT page_id, pos::BIGINT AS pos, CASE WHEN moved THEN '/guide/' || t || rest WHEN named THEN CASE pos WHEN 2 THEN 'https://Docs.example.com/p/' ELSE '//alias.example/p/' END || t || spelled ELSE 'https://docs.example.com/p/' || t || spelled || rest END AS target,
        CASE WHEN moved THEN 'route' WHEN named THEN 'kept' ELSE 'source' END AS kind, known FROM p
      UNION ALL SELECT k, 4, '#here', 'outside', false FROM s UNION ALL SELECT k, 5, 'mailto:a@b.example', 'outside', false FROM s
      UNION ALL SELECT k, 6, CASE WHEN k % 4 < 3 THEN '/guide/' || k ELSE 'https://docs.example.com/guide/' || k END, CASE WHEN k % 4 < 3 THEN 'route' ELSE 'source' END, false FROM s
      UNION ALL SELECT k, 7, 'https://other.example/p/' || k, 'outside', false FROM s UNION ALL SELECT k, 8, 'https://docs.example.com/gone/' || k || '#z', 'source', false FROM s""",
}
