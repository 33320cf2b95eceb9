"""What gates look for: each function gives the rows that stand against a copy, none if it is as it should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.operators import assets, headings, links

#: Where a navigation may come from.
PROVEN = ("dom-sidebar", "manual", "platform-metadata", "source-config")
#: What stands in a page for a block that is held back.
HELD = r"\[\[held:[^\]]*\]\]"
CODE = r"(?is)<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>"


def parts(pages: DataFrame, *names: str) -> DataFrame:
    """page_id, url and all that is found in pages (page_id, url, html) by itself, or what ``names`` name, in one reading; stands for
    the pages where links, headings, references, statements, code blocks and held blocks are looked at."""
    found = {"found_hrefs": links.hrefs, "found_headings": links.headed, "found_codes": codes, "found_held": held, "found_media": assets.media, "found_statements": assets.stated}
    found = {name: found[name] for name in names or found}
    return text.with_parts(pages, **found).select("page_id", "url", *found)


def codes(html: Column, _: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(CODE), F.lit(1))


def held(html: Column, _: Column) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(HELD)).cast("long")


def heading_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """page_id, wanted, shown: pages (page_id, html) whose outline in the copy is another; a page without headings has none on either side."""
    one = lambda p, name: headings.outlines(links.headings(p)).select("page_id", F.col("outline").alias(name))
    pages = source.select("page_id").join(copy.select("page_id"), "page_id", "left_semi")
    both = pages.join(one(source, "wanted"), "page_id", "left").join(one(copy, "shown"), "page_id", "left")
    return both.filter(~F.col("wanted").eqNullSafe(F.col("shown")))


def headings_out_of_order(source: DataFrame, copy: DataFrame) -> DataFrame:
    """page_id: pages whose headings the copy doesn't show in their order, whatever else it shows between them."""
    def listed(p, name):
        h = links.headings(p).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "heading"))).alias("hs"))
        return h.select("page_id", F.transform("hs", lambda x: x["heading"]).alias(name))

    pages = source.select("page_id").join(copy.select("page_id"), "page_id", "left_semi")
    both = pages.join(listed(source, "wanted"), "page_id").join(listed(copy, "shown"), "page_id", "left")
    shown = F.coalesce("shown", F.array().cast("array<string>"))
    return both.filter(~headings.in_order(F.col("wanted"), shown)).select("page_id")


def code_of(pages: DataFrame) -> DataFrame:
    """page_id, code_hash of the code blocks in pages (page_id, html): references decoded, outer blank lines gone."""
    blocks = text.with_parts(pages, found_codes=codes).select("page_id", F.explode("found_codes").alias("code"))
    return blocks.select("page_id", F.sha2(F.trim(text.entities(F.regexp_replace("code", "<[^>]*>", "")), F.lit("\n\r ")), 256).alias("code_hash"))


def unhosted(references: DataFrame, final: DataFrame, excluded: DataFrame) -> DataFrame:
    """page_id, url of media that neither has an address of its own yet nor is excluded."""
    return assets.rewritten(references, final, excluded).filter("status = 'unhosted'").select("page_id", "url")


def unproven(navigation: DataFrame) -> DataFrame:
    """node_id, provenance of navigation nodes that come from nowhere they may come from."""
    return navigation.filter(~F.coalesce(F.col("provenance").isin(*PROVEN), F.lit(False))).select("node_id", "provenance")


def placeholders(pages: DataFrame) -> DataFrame:
    """page_id, n: how many blocks a page (page_id, html) still holds back."""
    return text.with_parts(pages, found_held=held).select("page_id", F.col("found_held").alias("n")).filter("n > 0")


def authored_exclusions(excluded: DataFrame, by_rule: DataFrame, decided: DataFrame) -> DataFrame:
    """page_id, node_id of exclusions (page_id, node_id) that neither a rule for page furniture made nor a decision on an asset."""
    return excluded.select("page_id", "node_id").distinct().join(by_rule, ["page_id", "node_id"], "left_anti").join(decided, ["page_id", "node_id"], "left_anti")


def chrome_lines(copy: DataFrame, source: DataFrame) -> DataFrame:
    """page_id, line_no, line: lines of a copy's visible text that are made of the source page's navigation labels and separators alone;
    lines that the source has outside its navigation are its author's and stay."""
    inside = r"(?is)<nav\b[^>]*>(.*?)</nav>"
    nav = F.array_join(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(inside), F.lit(1)), " ")
    labels = F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), lambda x: text.entities(x))
    own = F.split(text.visible(F.regexp_replace("html", inside, "\n")), "\n")
    s = source.select("page_id", labels.alias("labels"), own.alias("authored")).filter(F.size("labels") > 0)
    both = copy.select("page_id", F.split(text.visible(F.col("html")), "\n").alias("lines")).join(s, "page_id")
    # nearly all lines are the author's, so each page's others are looked at once, where they are: no line takes its page along
    bare = lambda line: F.aggregate("labels", line, lambda left, x: F.replace(left, x, F.lit("")))
    chrome = F.filter(F.array_except("lines", "authored"), lambda x: (x != "") & (F.regexp_replace(bare(x), r"[\s|·•/>»,-]+", "") == ""))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    hit = both.select("page_id", "lines", chrome.alias("chrome")).select("page_id", F.explode(F.filter(numbered, lambda x: F.array_contains("chrome", x["line"]))).alias("x"))
    return hit.select("page_id", "x.line_no", "x.line")
