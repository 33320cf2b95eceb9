"""Rewriting parts of texts and leaving others alone: spans, matches outside of them, and replacement by position.

Positions count characters from 0. Texts are told apart by a key; only spans and matches
become rows, and a text is put together again from its own pieces, so the work is linear in
the text but for one sort of its matches.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import bounded_batches, written

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_TICKS = re.compile(r"`+")
#: An opening, closing or empty tag.
TAG = r"</?[A-Za-z][^<>]*>"
_SHORTCODE = r"(?<![\w:/]):[a-z0-9][a-z0-9_+\\-]*:(?![\w:])"
#: So many characters of texts are blanked at a time.
PART = 1 << 20
_LITERAL = r"(?<!\\)[{}]|(?m:^)(?:import|export)(?=\s)"


def _code_in_line(line: str) -> list[tuple[int, int]]:
    """Code spans: from a run of backticks that isn't escaped to the next run of the same length."""
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(line)]
    following: dict[int, int] = {}
    closes = [0] * len(runs)
    for k in range(len(runs) - 1, -1, -1):
        size = runs[k][1] - runs[k][0]
        closes[k] = following.get(size, 0)
        following[size] = k
    found, k = [], 0
    while k < len(runs):
        start, _ = runs[k]
        if closes[k] and not (start and line[start - 1] == "\\"):
            found.append((start, runs[closes[k]][1]))
            k = closes[k]
        k += 1
    return found


def code_intervals(text: str) -> list[tuple[int, int]]:
    """Fenced blocks (to the end, if never closed) and code spans of a Markdown text; a fence closes on a bare line of its own character that is as long."""
    found, at, fence, opened = [], 0, "", 0
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip(" \t\r"):
                found.append((opened, at + len(line)))
                fence = ""
        elif mark:
            fence, opened = mark[1], at
        elif "`" in line:
            found += [(at + a, at + b) for a, b in _code_in_line(line)]
        at += len(line) + 1
    return [*found, (opened, len(text))] if fence else found


def code_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, end of all code; null texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, a, b) for k, t in enumerate(batch.column(1)) for a, b in code_intervals(t.as_py() or "")]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2))], [key, "start", "end"])

    return bounded_batches(texts.select(key, F.col(text).cast("string"))).mapInArrow(run, f"`{key}` {kind}, start long, end long")


def _pieces(text: Column, pattern: str) -> Column:
    """What lies between matches and the matches themselves, by turns: an array of (gap, found), the last without a match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def matches(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, n (from 0), start, end, found: the leftmost matches of a pattern, which must not match the empty string.

    Gaps and matches take turns, so a running sum of their lengths gives the places; only lengths and matches move."""
    both = texts.filter(F.col(text).rlike(pattern)).select(key, F.posexplode(_pieces(F.col(text), pattern)).alias("n", "x"))
    both = both.select(key, "n", F.length("x.gap").alias("gap"), F.col("x.found").alias("found"))
    upto = F.sum(F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).over(Window.partitionBy(key).orderBy("n"))
    placed = both.select(key, "n", upto.cast("long").alias("end"), "found").filter("found IS NOT NULL")
    return placed.select(key, "n", (F.col("end") - F.length("found")).alias("start"), "end", "found")


def outside(found: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """found (key, start, end, ...) without the rows that share a character with one of the spans (key, start, end)."""
    columns = [c for c in found.columns if c not in (key, "start", "end")]
    blank = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns]
    both = found.select(key, "start", "end", *columns, F.lit(False).alias("__span")).union(spans.select(key, "start", "end", *blank, F.lit(True)))
    # both frames grow from their partition's end: a frame that shrinks is summed up anew for every row
    so_far = lambda *order: Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(F.col("__span"), F.col("end"))).over(so_far("start", "end"))
    after = F.min(F.when(F.col("__span"), F.col("start"))).over(so_far(F.desc("start"), F.desc("end")))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return both.withColumn("__clear", clear).filter("NOT __span AND __clear").drop("__span", "__clear")


def replaced(texts: DataFrame, changes: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """texts in whose column ``text`` matches of the pattern become what changes (key, n, put) say, others stay; keys must be unique."""
    changes = written(changes.select(key, "n", "put"), "changes")
    some = texts.join(changes.select(key).distinct().hint("merge"), key, "left_semi")
    every = some.select(key, F.explode(F.sequence(F.lit(0), F.regexp_count(F.col(text), F.lit(pattern)) - 1)).alias("n")).join(changes.hint("merge"), [key, "n"], "left")
    puts = every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "put"))), lambda x: x["put"]).alias("__puts"))
    made = F.transform(_pieces(F.col(text), pattern), lambda x, i: F.concat(x["gap"], F.coalesce(F.get("__puts", i), x["found"], F.lit(""))))
    return texts.join(puts, key, "left").withColumn(text, F.when(F.col("__puts").isNotNull(), F.array_join(made, "")).otherwise(F.col(text))).drop("__puts")


def with_masked_code(texts: DataFrame, key: str, text: str, masked: str) -> DataFrame:
    """key, text, masked: texts beside what they are with blanks for the characters of code; lines and places stay. Null stays null.

    Texts without marks of code never leave the JVM; of the others as many are blanked at a time as make PART characters, so that a
    worker's memory is that of a batch and a part, however many texts there are."""
    t = texts.select(key, F.col(text).cast("string").alias(text))
    has_marks = F.coalesce(F.col(text).contains("`") | F.col(text).contains("~~~"), F.lit(False))
    kind = texts.schema[key].dataType.simpleString()

    def blanked(t: str) -> str:
        parts, at = [], 0
        for a, b in code_intervals(t):
            parts += [t[at:a], re.sub(r"[^\n]", " ", t[a:b])]
            at = b
        return "".join([*parts, t[at:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done, made, size = 0, [], 0
            for i, t in enumerate(batch.column(1), 1):
                made.append(blanked(t.as_py()))
                size += len(made[-1])
                if size >= PART or i == batch.num_rows:
                    part = batch.slice(done, i - done)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], [key, text, masked])
                    done, made, size = i, [], 0

    coded = bounded_batches(t.filter(has_marks)).mapInArrow(run, f"`{key}` {kind}, `{text}` string, `{masked}` string")
    return coded.union(t.filter(~has_marks).withColumn(masked, F.col(text)))


def masked_code(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: see with_masked_code."""
    return with_masked_code(texts, key, text, "__masked").select(key, F.col("__masked").alias(text))


def _beside_code_and_tags(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    # both are read more than once, and texts are far larger than the places in them
    code = written(code_spans(texts, key, text), "code-spans")
    tags = outside(matches(texts, key, text, TAG), code, key)
    return outside(matches(texts, key, text, pattern), code.union(tags.select(key, "start", "end")), key)


def with_emoji(texts: DataFrame, key: str, text: str, emoji: DataFrame) -> DataFrame:
    """texts whose shortcodes (``:name:``, underscores escaped or not) outside code and tags are the characters of emoji (name, char).

    Names that emoji lacks stay, and so does what stands beside letters, digits or colons: it belongs to something longer."""
    found = _beside_code_and_tags(texts, key, text, _SHORTCODE)
    named = found.withColumn("name", F.replace(F.substring("found", F.lit(2), F.length("found") - 2), F.lit("\\_"), F.lit("_")))
    known = emoji.groupBy("name").agg(F.min("char").alias("put"))
    return replaced(texts, named.join(known, "name"), key, text, _SHORTCODE)


def with_literal_braces(texts: DataFrame, key: str, text: str) -> DataFrame:
    """texts whose braces outside code and tags are escaped, unless they are, and whose lines don't begin with import or export there."""
    found = _beside_code_and_tags(texts, key, text, _LITERAL)
    first = F.concat(F.lit("&#"), F.ascii("found").cast("string"), F.lit(";"), F.substring("found", F.lit(2), F.length("found")))
    put = F.when(F.length("found") == 1, F.concat(F.lit("\\"), F.col("found"))).otherwise(first)
    return replaced(texts, found.withColumn("put", put), key, text, _LITERAL)


#: Blocks of characters that are drawn as pictures.
_PICTURES = ((0x2600, 0x27C0), (0x1F300, 0x1F650), (0x1F680, 0x1F700), (0x1F900, 0x1FA00))


def unicode_emoji(spark: SparkSession) -> DataFrame:
    """name, char: pictures by their Unicode names, in lower case with underscores."""
    named = ((unicodedata.name(chr(c), ""), chr(c)) for a, b in _PICTURES for c in range(a, b))
    return spark.createDataFrame([(re.sub(r"[^a-z0-9]+", "_", n.lower()), c) for n, c in named if n], "name string, char string")
