"""Queries over the scalar functions: each page gets inputs in which every outcome of the function occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions import text, urls
from foliograph.workspace import table


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _cases(inputs: list[str], function: Callable[[Column], Column]) -> Callable:
    """A query that gives each page one of ``inputs`` in turn, its id in place of #, and what the function makes of it."""

    def query(spark, d):
        p = table(spark, d, "pages").select("page_id")
        chosen = F.element_at(F.array(*map(F.lit, inputs)), (F.col("page_id") % len(inputs) + 1).cast("int"))
        p = p.withColumn("given", F.replace(chosen, F.lit("#"), F.col("page_id").cast("string")))
        return p.select("page_id", "given", function(F.col("given")).alias("result"))

    return query


def _sql(inputs: list[str], result: str) -> str:
    """The same inputs in SQL; ``result`` is an expression over given and page_id."""
    values = ", ".join(map(_quoted, inputs))
    return f"SELECT page_id, given, {result} AS result FROM (SELECT page_id, replace(list_extract([{values}], (page_id % {len(inputs)} + 1)::INT), '#', page_id::VARCHAR) AS given FROM pages)"


def _told(inputs: list[str], results: list[str | None]) -> str:
    """SQL that states the result of every input as a literal, # standing for the page's id."""
    values = ", ".join("NULL" if r is None else _quoted(r) for r in results)
    return _sql(inputs, f"replace(list_extract([{values}], (page_id % {len(inputs)} + 1)::INT), '#', page_id::VARCHAR)")


#: name -> (inputs, function, literal results). The results are written down, not computed by the same expressions again.
TOLD: dict[str, tuple[list[str], Callable[[Column], Column], list[str | None]]] = {
    "markdown_paths": (["/", "/a/#", "/a/#/", "", "//"], urls.markdown_path, ["/index.md", "/a/#.md", "/a/#.md", "/index.md", "/index.md"]),
    "markdown_pages": (["/index.md", "/a/#.md", "/a/index.md", "/a/#.mdx", "/b#"], urls.of_markdown_path, ["/", "/a/#", "/a", "/a/#", "/b#"]),
    "dot_segments": (
        ["/a/b/../../c#", "/../x#", "/a/./b#", "/a/b#/..", "/a/../..", "a//b/../c#", "/a/b/c/../../../../d#/.", "/x#/...", "/#"],
        urls.without_dots,
        ["/c#", "/x#", "/a/b#", "/a/", "/", "/a/c#", "/d#/", "/x#/...", "/#"],
    ),
    "page_paths": (["/a/#.html", "/a/index", "/a/#/", "a/#", "/a\\#", "/index.html", "/"], urls.page_path, ["/a/#", "/a", "/a/#", "/a/#", "/a/#", "/", "/"]),
    "video_players": (
        ["https://www.youtube.com/watch?v=abcdef#", "https://youtu.be/abcdef#", "https://m.youtube.com/watch?t=1&v=abcdef#&x=2", "https://www.youtube.com/shorts/abcdef#", "https://example.org/watch?v=abcdef#", "https://www.youtube.com/watch?v=abc"],
        urls.video_player,
        ["https://www.youtube.com/embed/abcdef#"] * 4 + [None, None],
    ),
    "platform_links": (
        ["doc:start-#", "ref:get-#?x=1", "page:about#", "changelog:v#", "https://e.org/doc:#", "doc:", "/docs/#"],
        urls.platform_link,
        ["/docs/start-#", "/reference/get-#?x=1", "/page/about#", "/changelog/v#", None, None, None],
    ),
    "target_names": (["/guides/getting-started-#", "/a/api_keys.html", "/x-#/", "one"], urls.name_of_target, ["getting started #", "api keys", "x #", "one"]),
    "redirect_classes": (["/a/#", "/a/:id/#", "/a/*", "/a/:rest*", "/:x"], urls.redirect_class, ["exact", "named-param", "wildcard", "wildcard", "named-param"]),
    "route_prefixes": (
        ["en|v#", "de|v#", "fr|current", "en|current", "de|newest", "en|newest"],
        lambda g: urls.route_prefix(F.split(g, r"\|")[0], F.split(g, r"\|")[1], "en", "newest"),
        ["/v#", "/de/v#", "/fr/next", "/next", "/de", ""],
    ),
    "labels": (["getting-started", "rest-api_keys.html", "FAQ", "sso-#", "über uns", "my-URL-list"], text.label, ["Getting started", "Rest API keys", "FAQ", "SSO #", "Über uns", "My URL list"]),
    "heading_slug_cases": (["Hello World #", "What's new?", " A  b ", "x_y-z", "Ünï Cödé!"], text.heading_slug, ["hello-world-#", "whats-new", "a--b", "x_y-z", "ünï-cödé"]),
    "markdown_unescaped": ([r"a \* b #", r"\[x\]\(y\)", r"back\\slash", r"plain \q", r"\<tag\>"], text.unescaped_markdown, ["a * b #", "[x](y)", r"back\slash", r"plain \q", "<tag>"]),
    "mdx_escaped": (["a {b} #", "<i>x</i>", "plain", "{<>}"], text.escaped_mdx, [r"a \{b\} #", r"\<i\>x\</i\>", "plain", r"\{\<\>\}"]),
    "legal_paths": (["Guides/Getting Started #", "/a//B c/", "R&D/#", "Straße/Ünï"], text.legal_path, ["guides/getting-started-#", "a/b-c", "r-and-d/#", "strasse/uni"]),
    "site_base_lists": (
        ["https://E.org/a/b/c/d#", "http://e.org/a#", "https://e.org/", "https://e.org/a/b#"],
        lambda u: F.array_join(urls.site_bases(u), " "),
        ["https://e.org/a/b/c https://e.org/a/b https://e.org/a https://e.org", "http://e.org", "https://e.org", "https://e.org/a https://e.org"],
    ),
    "section_prefix_lists": (["/a/b#", "/", "/x#/y/"], lambda u: F.array_join(urls.section_prefixes(u), " "), ["/a/b# /a /", "/", "/x#/y /x# /"]),
    "sitemap_hints": (
        ["https://e.org/sitemap-en-v2-guides.xml", "https://e.org/sitemap.xml", "https://e.org/de/sitemap_de.xml.gz", "https://e.org/sitemap-#-api.xml"],
        lambda u: F.concat_ws(" ", F.coalesce(urls.sitemap_hint(u)["locale"], F.lit("-")), F.coalesce(urls.sitemap_hint(u)["version"], F.lit("-")), F.array_join(urls.sitemap_hint(u)["groups"], "+")),
        ["en v2 guides", "- - ", "de - ", "- - api"],
    ),
    "splat_redirects": (
        ["/a/:rest*|/b/:rest*", "/a/*|/b/*", "/a/#|/b/#", "/a/*/c|/b", "/:x*/a/:y*|/c/:y*"],
        lambda g: F.concat_ws(" ", *[F.coalesce(urls.splat_redirect(F.split(g, r"\|")[0], F.split(g, r"\|")[1])[c], F.lit("-")) for c in ("source", "destination", "problem")]),
        ["/a/* /b/:splat -", "/a/* /b/:splat -", "/a/# /b/# -", "/a/*/c /b wildcard inside the path", "/:x*/a/* /c/:splat wildcard inside the path"],
    ),
}
_yes_no = lambda test: lambda g: F.when(test(g), "yes").otherwise("no")
TOLD |= {
    "slug_validity": (["abc-#", "Abc", "a--b", "-a", "a-1", ""], _yes_no(text.is_slug), ["yes", "no", "no", "no", "yes", "no"]),
    "served_resources": (["/a/#.xml", "/a/#.PDF", "/a/#", "/a.md/#", "/feed#.rss", "/x.yaml"], _yes_no(urls.is_served_file), ["yes", "yes", "no", "no", "yes", "yes"]),
    "page_candidates": (
        ["https://e.org/a/#", "https://other.org/a", "https://E.org/a#.png", "ftp://e.org/a", "http://e.org/style.css", "http://E.ORG/x"],
        _yes_no(lambda u: urls.is_page_candidate(u, F.lit("e.org"))),
        ["yes", "no", "no", "no", "no", "yes"],
    ),
    "safe_urls": (["https://e.org/#", "javascript:alert(#)", "java\tscript:x", "/a/#", "mailto:a@b.c", "data:text/html,x", "#x", " JavaScript:x"], _yes_no(urls.is_safe), ["yes", "no", "no", "yes", "yes", "no", "yes", "no"]),
    "public_addresses": (
        ["8.8.8.8", "10.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "::1", "2606:4700::1111", "fe80::1", "100::1", "::ffff:10.0.0.1", "::ffff:8.8.4.4", "100.64.0.1", "169.254.169.254", "not an address", "224.0.0.1"],
        _yes_no(urls.is_public_address),
        ["yes", "no", "no", "yes", "no", "no", "yes", "no", "no", "no", "yes", "no", "no", "no", "no"],
    ),
    "pixel_sizes": (["640", "640px", " 12 ", "0", "12.5", "50%", "", "123456789"], lambda g: text.pixels(g).cast("string"), ["640", "640", "12", None, None, None, None, None]),
}
QUERIES = {name: _cases(inputs, function) for name, (inputs, function, _) in TOLD.items()}
ORACLES = {name: _told(inputs, results) for name, (inputs, _, results) in TOLD.items()}
