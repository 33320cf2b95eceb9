"""What pages carry beside their text: sidebars as trees, data inside scripts, the wrapper of published Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text
from foliograph.operators import masking, order
from foliograph.workspace import written

#: The tokens of a sidebar: lists open and close, links up to the next one or the next list, and what an item says that is no link.
_TOKEN = r"(?is)<(?:ul|ol)\b[^>]*>|</(?:ul|ol)\s*>|<a\b[^>]*+>(?:[^<]++|<(?!/?(?:a|ul|ol|nav)\b))*+|<li\b[^>]*>\s*(?:<(?:span|p|div|h[1-6]|button|strong)\b[^>]*>\s*)?[^<\s][^<]*"
_BADGE = r"(?is)<(?:sup|small|span)\b[^>]*\bclass=[\"'][^\"']*badge[^\"']*[\"'][^>]*>.*?</(?:sup|small|span)>"


def _shown(nodes: DataFrame) -> DataFrame:
    """Nodes that are links or hold one, however deep: what links show is handed up, a level a round."""
    shown = nodes.filter("href IS NOT NULL").select("page_id", "node", "parent")
    level = shown
    while True:
        up = level.filter("parent IS NOT NULL").select("page_id", F.col("parent").alias("node")).distinct()
        level = written(nodes.join(up, ["page_id", "node"]).select("page_id", "node", "parent").join(shown.select("page_id", "node"), ["page_id", "node"], "left_anti"), "sidebar")
        if not level.take(1):
            break
        shown = shown.union(level)
    kept = nodes.join(shown.select("page_id", "node"), ["page_id", "node"], "left_semi")
    holds = kept.filter("parent IS NOT NULL").select("page_id", F.col("parent").alias("node")).distinct().withColumn("holds", F.lit(True))
    return kept.join(holds, ["page_id", "node"], "left").select("page_id", "node", "parent", F.when(F.col("holds"), "group").otherwise("page").alias("kind"), "label", "href")


def sidebar_nodes(pages: DataFrame, inside: str = "nav") -> DataFrame:
    """page_id, node (places of its tokens, from 0), parent, kind, label, href of the sidebars of pages (page_id, html): the first element
    ``inside`` of each.

    A link that a list follows is a group that opens its page; an item's own words are a group if a list follows them and nothing
    otherwise. Badges are no part of labels; links without a label or to a fragment alone are left out, groups without any link
    beneath too. A node's parent is the nearest one before it in a list further out."""
    html = F.regexp_replace(F.regexp_extract(F.coalesce("html", F.lit("")), rf"(?is)<{inside}\b[^>]*>(.*?)</{inside}\s*>", 1), _BADGE, "")
    found = masking.matches(pages.select("page_id", html.alias("__nav")), "page_id", "__nav", _TOKEN)
    is_open, is_close = F.col("found").rlike("(?i)^<(?:ul|ol)"), F.col("found").startswith("</")
    in_order = Window.partitionBy("page_id").orderBy("n")
    depth = F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    f = found.withColumns({"depth": depth, "list": is_open | is_close, "opens": is_open})
    f = f.withColumn("held", F.coalesce(F.lead("opens").over(in_order), F.lit(False)))
    is_link = F.col("found").rlike("(?i)^<a")
    label = F.trim(F.regexp_replace(text.char_references(F.regexp_replace("found", "<[^>]*>", " ")), r"\s+", " "))
    href = F.regexp_replace(F.regexp_extract("found", r"""(?i)^<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), r"""^(["'])(.*)\1$""", "$2")
    n = f.filter("NOT list").select("page_id", F.col("n").cast("long").alias("node"), F.col("depth").cast("long").alias("depth"), "held", label.alias("label"), F.when(is_link, text.char_references(href)).alias("href"))
    n = n.filter((F.col("label") != "") & F.when(F.col("href").isNull(), F.col("held")).otherwise((F.col("href") != "") & ~F.col("href").startswith("#")))
    n = order.parents_by_indent(n, ["page_id"], "node", "depth")
    return _shown(n)


def embedded_json(pages: DataFrame) -> DataFrame:
    """page_id, n, v: the JSON that scripts of pages (page_id, html) hold, as VARIANT: scripts of a JSON type, and strings of JSON that
    scripts push piece by piece, put together again. What is no JSON is left out."""
    html = F.coalesce("html", F.lit(""))
    # no script ends behind the last end tag, so nothing is looked for there
    closed = F.substring(html, F.lit(1), F.length(html) - F.length(F.substring_index(html, "</script", -1)) + 1)
    whole = F.regexp_extract_all(closed, F.lit(r"(?is)<script\b[^>]*\btype=[\"']?application/(?:[a-z.+-]*\+)?json[\"']?[^>]*>(.*?)</script>"), F.lit(1))
    pushed = F.regexp_extract_all(html, F.lit(r'\.push\(\[\s*\d+\s*,\s*("(?:[^"\\]++|\\.)*+")\s*\]\)'), F.lit(1))
    piece = F.transform(pushed, lambda p: F.try_variant_get(F.try_parse_json(p), "$", "string"))
    joined = F.filter(F.split(F.array_join(piece, ""), "\n"), lambda x: x != "")
    lines = F.transform(joined, lambda x: F.regexp_replace(x, r"^[0-9a-f]+:[A-Z]?(?=[\[{\"])", ""))
    rows = pages.select("page_id", F.posexplode(F.concat(whole, lines)).alias("n", "x"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), F.try_parse_json("x").alias("v")).filter("v IS NOT NULL")


def _first(lines: Column, cursor: Column, wanted) -> Column:
    """The place, from 0, of the first line at or after the cursor that is wanted; the number of lines if none is."""
    left = F.slice(lines, (cursor + 1).cast("int"), F.greatest(F.size(lines) - cursor, F.lit(0)).cast("int"))
    at = F.array_position(F.transform(left, wanted), True)
    return F.when(at > 0, cursor + at - 1).otherwise(F.size(lines)).cast("int")


def unwrapped_markdown(rows: DataFrame, body: str, expected: str) -> DataFrame:
    """rows with ``title``, ``description``, ``wrapped`` and ``authored``: Markdown (column ``body``) as a site publishes it, without the
    quotation that points to its index, the heading that is the page's title and the quotation that repeats the description
    (column ``expected``); any other quotation is the author's. Null stays null."""
    blank, quote = (lambda x: F.trim(x, F.lit(" \t\r")) == ""), (lambda x: x.startswith(">"))
    said = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    r = rows.withColumn("__l", F.split(F.regexp_replace(body, "^\ufeff", ""), r"\r?\n", -1))
    past_blank = lambda c: _first(F.col("__l"), F.col(c), lambda x: ~blank(x))
    r = r.withColumn("__a", F.lit(0)).withColumn("__a", past_blank("__a"))
    r = r.withColumn("wrapped", F.coalesce(F.get("__l", F.col("__a")).rlike(r"(?i)^>\s*##\s+documentation index"), F.lit(False)))
    r = r.withColumn("__b", F.when(F.col("wrapped"), _first(F.col("__l"), F.col("__a"), lambda x: ~quote(x))).otherwise(F.col("__a"))).withColumn("__b", past_blank("__b"))
    heading = F.regexp_extract(F.coalesce(F.get("__l", F.col("__b")), F.lit("")), r"^#\s+(.+?)\s*$", 1)
    r = r.withColumn("title", F.when(heading != "", text.unescaped_markdown(heading)))
    r = r.withColumn("__c", F.when(F.col("title").isNotNull(), F.col("__b") + 1).otherwise(F.col("__b"))).withColumn("__c", past_blank("__c"))
    r = r.withColumn("__d", _first(F.col("__l"), F.col("__c"), lambda x: ~quote(x)))
    quoted = said(F.array_join(F.transform(F.slice("__l", F.col("__c") + 1, F.greatest(F.col("__d") - F.col("__c"), F.lit(0))), lambda x: F.regexp_replace(x, r"^>\s?", "")), " "))
    r = r.withColumn("description", F.when((quoted != "") & (quoted == said(F.col(expected))), quoted))
    r = r.withColumn("__e", F.when(F.col("description").isNotNull(), F.col("__d")).otherwise(F.col("__c"))).withColumn("__e", past_blank("__e"))
    rest = F.array_join(F.slice("__l", F.col("__e") + 1, F.greatest(F.size("__l") - F.col("__e"), F.lit(0))), "\n")
    return r.withColumn("authored", F.when(F.col(body).isNotNull(), F.concat(F.regexp_replace(rest, r"\s+$", ""), F.lit("\n")))).drop("__l", "__a", "__b", "__c", "__d", "__e")
