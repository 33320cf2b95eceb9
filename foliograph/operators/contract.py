"""The target's contract for pages: which rules a page breaks, and in which line.

Code is blanked first, so that examples are never judged. What remains is read as tokens:
tags (over several lines if need be) with their attributes, what stands in braces, and
lines. Each kind of token has its own rules; the tables of components and properties meet
tags by name in joins on equal keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.operators import masking
from foliograph.workspace import written

#: editor_only and executable components are never written; kind of a property: enum (one of allowed), tokens (words of allowed), required.
COMPONENTS = "name string, editor_only boolean, executable boolean"
PROPS = "component string, prop string, kind string, allowed array<string>"
# Marks of source dialects that must not be left in a converted page, and components of one that the target lacks.
RESIDUAL = {
    "admonition": r"^:::(?:note|tip|info|warning|danger|caution)\b",
    "liquid": r"\{%\s*(?:hint|tabs|tab|endhint|endtabs|endtab|embed|content-ref|code)\b",
    "snippet": r"\{\{\s*snippet\.",
    "embed": r"@embed\[",
    "glossary": r"<<\s*glossary:",
}
CALLOUT_MARKS = "📘👍🚧❗"
FOREIGN = ("Accordion", "AccordionGroup", "Badge", "Banner", "Check", "Frame", "Icon", "Info", "Note", "Panel", "RequestExample", "ResponseExample", "Tiles", "Tip", "Tooltip", "Tree", "Warning")
#: A quotation mark by character references, by the mark.
QUOTES = {'"': ("&quot;", "&#34;", "&#x22;"), "'": ("&apos;", "&#39;", "&#x27;")}
_OPENING = r"<[A-Za-z][A-Za-z0-9]*\b[^<>]*>"
_ATTRIBUTE = r"""[A-Za-z_][\w-]*=(?:"[^"]*"|'[^']*'|\{[^{}]*\})"""


def _lines(pages: DataFrame) -> DataFrame:
    """page_id, line (from 1), at (its first character's place, from 0), text, scan (without code)."""
    both = F.arrays_zip(F.split("mdx", "\n", -1).alias("text"), F.split("scan", "\n", -1).alias("scan"))
    rows = pages.select("page_id", F.posexplode(both).alias("n", "x"))
    upto = F.sum(F.length("x.scan") + 1).over(Window.partitionBy("page_id").orderBy("n"))
    return rows.select("page_id", (F.col("n") + 1).alias("line"), (upto - F.length("x.scan") - 1).alias("at"), "x.text", "x.scan")


def _with_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found (page_id, start, ...) with the line each place is in: the last line that begins no later, carried along in order."""
    columns = [c for c in found.columns if c not in ("page_id", "start")]
    blank = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns]
    both = found.select("page_id", F.col("start").cast("long").alias("start"), F.lit(1).alias("is"), F.lit(None).cast("int").alias("line"), *columns)
    both = both.union(lines.select("page_id", F.col("at").alias("start"), F.lit(0), "line", *blank))
    so_far = Window.partitionBy("page_id").orderBy("start", "is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.last("line", ignorenulls=True).over(so_far)).filter(F.col("is") == 1).drop("is")


def _front_end(lines: Column) -> Column:
    """How many lines the front matter takes, its marks included; 0 if the page has none."""
    bare = F.transform(lines, lambda x: F.rtrim(x, F.lit("\r")))
    closing = F.array_position(F.slice(bare, F.lit(2), F.size(bare)), "---")
    return F.when((F.element_at(bare, 1) == "---") & (closing > 1), closing + 1).otherwise(0)


def _kind_of(held: Column) -> Column:
    """What stands in braces: nothing, field (of the reader), number, truth, comment, string; null for anything else."""
    inner = F.trim(held, F.lit(" \t\r\n"))
    string = F.regexp_replace(F.substring(inner, F.lit(2), F.length(inner) - 2), r"\\.", "")
    return (
        F.when(inner == "", "nothing")
        .when(inner.rlike(r"^user\.[a-zA-Z_]+$"), "field")
        .when(inner.rlike("^[0-9]+$"), "number")
        .when(inner.isin("true", "false"), "truth")
        .when((F.length(inner) >= 4) & inner.startswith("/*") & inner.endswith("*/"), "comment")
        .when((F.length(inner) >= 2) & inner.startswith('"') & inner.endswith('"') & ~string.contains('"') & ~string.contains("\\"), "string")
    )


def _is_snippet(statement: Column) -> Column:
    """``import Name from "/snippets/..."``: one default import of a file beneath the snippets' folder."""
    words = F.filter(F.split(F.regexp_replace(statement, r"\s*;?\s*$", ""), r"\s+"), lambda w: w != "")
    source = F.coalesce(F.get(words, 3), F.lit(""))
    inner = F.substring(source, F.lit(2), F.length(source) - 2)
    quoted = (F.substring(source, 1, 1) == F.substring(source, -1, 1)) & F.substring(source, 1, 1).isin('"', "'")
    file = inner.startswith("/snippets/") & ~inner.contains("..") & inner.rlike(r"^[\w./-]+$") & (inner.endswith(".md") | inner.endswith(".mdx") | inner.endswith(".jsx"))
    return (F.size(words) == 4) & (F.get(words, 0) == "import") & F.get(words, 1).rlike(r"^[A-Za-z_$][\w$]*$") & (F.get(words, 2) == "from") & quoted & file


def _ends_early(value: Column) -> Column:
    """Whether a quoted value holds its own mark as a character reference: decoded, it would end there."""
    return reduce(lambda a, b: a | b, [value.startswith(mark) & value.contains(r) for mark, names in QUOTES.items() for r in names])


def _fences(lines: DataFrame) -> DataFrame:
    """page_id, line of the first line of backticks that a page's fences can't take: one with words inside a block, or a block never closed.

    Only lines that begin with three backticks are looked at, one after another."""
    bare = F.trim(F.col("text"), F.lit(" \t\r"))
    ticks = F.length(F.regexp_extract(bare, "^`+", 0))
    marks = lines.select("page_id", "line", ticks.alias("ticks"), (F.length(bare) == ticks).alias("bare")).filter("ticks >= 3")
    page = marks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line", "ticks", "bare"))).alias("marks"))

    def step(at: Column, x: Column) -> Column:
        inside = at["ticks"] > 0
        counts = inside & (x["ticks"] >= at["ticks"])
        opens = ~inside & at["bad"].isNull()
        return F.struct(
            F.when(opens, x["ticks"]).when(counts & x["bare"], 0).otherwise(at["ticks"]).alias("ticks"),
            F.when(opens, x["line"]).otherwise(at["opened"]).alias("opened"),
            F.when(counts & ~x["bare"] & at["bad"].isNull(), x["line"]).otherwise(at["bad"]).alias("bad"),
        )

    start = F.struct(F.lit(0).alias("ticks"), F.lit(0).alias("opened"), F.lit(None).cast("int").alias("bad"))
    bad = F.aggregate("marks", start, step, lambda at: F.coalesce(at["bad"], F.when(at["ticks"] > 0, at["opened"])))
    return page.select("page_id", bad.alias("line")).filter("line IS NOT NULL")


def problems(pages: DataFrame, components: DataFrame, props: DataFrame) -> DataFrame:
    """page_id, code, line, detail of pages (page_id, mdx) against components and properties (see COMPONENTS, PROPS): a row for each
    broken rule.

    Codes: frontmatter-missing, frontmatter-title-missing, deployment-code-fence, deployment-attribute-quote, unknown-component,
    editor-only-node (also in lower case), invalid-prop-value, missing-required-prop, executable, esm, expression and
    residual-source-syntax (the first line of each dialect). Null pages count as empty; page_ids are unique. An import counts as one
    line."""
    p = pages.select("page_id", F.coalesce("mdx", F.lit("")).alias("mdx"))
    p = masking.with_masked_code(p, "page_id", "mdx", "masked").withColumn("front", _front_end(F.split("mdx", "\n", -1)))
    # the front matter is no body: its lines are blanked as well, which keeps the places
    raw = F.split("masked", "\n", -1)
    scan = F.array_join(F.transform(raw, lambda x, i: F.when(i < F.col("front"), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n")
    p = p.withColumn("scan", F.when(F.col("front") > 0, scan).otherwise(F.col("masked"))).drop("masked")
    # a dozen rules read pages, lines and tags: these are made once
    p = written(p, "pages-without-code")
    lines = written(_lines(p), "lines")
    row = lambda df, code, detail="": df.select("page_id", F.lit(code).alias("code"), F.col("line").cast("int").alias("line"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))

    head = F.transform(F.slice(F.split("mdx", "\n", -1), F.lit(2), F.greatest(F.col("front") - 2, F.lit(0)).cast("int")), lambda x: F.trim(x, F.lit(" \t\r")))
    stated = F.exists(F.transform(head, lambda x, i: F.when(x.startswith("title:"), F.concat(F.substring(x, 7, 10**9), F.coalesce(F.get(head, i + 1), F.lit("")))).otherwise("")), lambda x: F.trim(x) != "")
    fronted = p.select("page_id", "front", stated.alias("stated"), F.lit(1).alias("line"))
    found = [row(fronted.filter("front = 0"), "frontmatter-missing"), row(fronted.filter("front > 0 AND NOT stated"), "frontmatter-title-missing")]
    fronts = p.select("page_id", "front")
    body = lines.join(fronts, "page_id").filter("line > front").drop("front")
    found.append(row(_fences(body), "deployment-code-fence"))

    values = F.regexp_extract_all("text", F.lit(r"""=("[^"]*"|'[^']*')"""), F.lit(1))
    quoted = lines.filter(F.exists(values, _ends_early)).groupBy("page_id").agg(F.min("line").alias("line"))
    found.append(row(quoted, "deployment-attribute-quote"))

    tags = _with_lines(masking.matches(p, "page_id", "scan", _OPENING), lines)
    tags = tags.select("page_id", "start", "line", F.regexp_extract("found", "^<([A-Za-z][A-Za-z0-9]*)", 1).alias("name"), F.regexp_extract_all("found", F.lit(_ATTRIBUTE), F.lit(0)).alias("attributes"))
    known = components.groupBy("name").agg(F.bool_or("editor_only").alias("editor_only"), F.bool_or("executable").alias("executable"))
    editor = known.filter("editor_only").select(F.col("name").alias("as_editor")).withColumn("is_editor", F.lit(True))
    capital = F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 10**9))
    tags = tags.withColumn("as_editor", capital).join(editor, "as_editor", "left").join(known.drop("editor_only"), "name", "left")
    tags = written(tags, "tags")
    is_component = F.col("name").rlike("^[A-Z]") & F.col("is_editor").isNull()
    found.append(row(tags.filter("is_editor"), "editor-only-node", F.col("name")))
    found.append(row(tags.filter(is_component & F.col("executable").isNull()), "unknown-component", F.col("name")))
    used = tags.filter(is_component & F.col("executable").isNotNull())
    found.append(row(used.filter("executable"), "executable", F.col("name")))
    ruled = used.join(props.withColumnRenamed("component", "name"), "name")
    given = F.get(F.filter("attributes", lambda a: a.startswith(F.concat("prop", F.lit("=")))), 0)
    value = F.regexp_replace(given, r"""(?s)^[^=]*=["'{](.*)["'}]$""", "$1")
    ruled = ruled.withColumn("value", F.when(F.exists("attributes", lambda a: a.startswith(F.concat("prop", F.lit("=")))), value))
    wrong = F.when(F.col("kind") == "enum", ~F.array_contains("allowed", F.col("value"))).when(F.col("kind") == "tokens", F.size(F.array_except(F.filter(F.split("value", r"\s+"), lambda w: w != ""), "allowed")) > 0)
    named = F.concat_ws(".", "name", "prop")
    found.append(row(ruled.filter(wrong), "invalid-prop-value", F.concat(named, F.lit("="), "value")))
    found.append(row(ruled.filter("kind = 'required' AND value IS NULL"), "missing-required-prop", named))

    statement = F.trim(F.col("scan"), F.lit(" \t\r"))
    esm = body.filter(statement.rlike(r"^(?:import|export)\s") & ~_is_snippet(statement))
    found.append(row(esm, "esm", statement))
    braces = _with_lines(masking.matches(p, "page_id", "scan", r"\{[^{}]*\}"), lines)
    inner = F.substring("found", F.lit(2), F.length("found") - 2)
    found.append(row(braces.filter(_kind_of(inner).isNull()), "expression", F.substring(F.trim(inner, F.lit(" \t\r\n")), 1, 40)))

    # a callout is a quotation that opens with its mark; on a later line of a quotation the mark is text
    above = F.lag("scan").over(Window.partitionBy("page_id").orderBy("line"))
    opens = F.col("scan").rlike(rf"^[ \t]*>\s*[{CALLOUT_MARKS}]") & ~F.coalesce(F.col("above").rlike(r"^[ \t]*>"), F.lit(False))
    dialect = body.withColumn("above", above)
    marks = F.array(*[F.when(F.col("scan").rlike(r), F.lit(k)) for k, r in RESIDUAL.items()], F.when(opens, F.lit("callout")))
    dialect = dialect.select("page_id", "line", F.explode(F.array_compact(marks)).alias("dialect"))
    dialect = dialect.union(tags.filter(F.col("name").isin(*FOREIGN)).select("page_id", "line", F.lit("component")))
    found.append(row(dialect.groupBy("page_id", "dialect").agg(F.min("line").alias("line")), "residual-source-syntax", F.col("dialect")))
    return reduce(DataFrame.union, found)
