"""Fill-in-the-middle examples from texts, cut at line ends, as a composition of DataFrame operations.

Method: a text's units (its lines, each with its line feed) become rows by posexplode; a
window adds up their lengths in characters; a document's two cut requests meet the units
on their ordinals; the ends of the units met, one row a document, are the offsets at which
the text is cut with substring.

Partitions: texts are dealt once, by document id, text hash and input partition, and that
one exchange serves the units, the requests and the texts themselves: nothing is dealt
again. As the input partition is part of the key, no key holds more than one partition's
rows, however often a document or a row is repeated. A window spans one text.

Defined results: a null text is the empty text, which stays plain; a null doc_id draws as
the empty string would; repeated rows give repeated results; a doc_id with several texts
gives a row for each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred documents that can be cut, so many are; of a hundred that are cut, so many have their suffix first.
RATE, SUFFIX_FIRST = 100, 50
_KEY = ["doc", "text_hash", "part"]


def draws(doc: Column, seed: int = SEED) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 that depend on the seed and the document's id, in decimal, alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def n_units(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a null id couldn't meet itself in a join; all that read the exchange need its three columns, or it would be made anew for each
    doc = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    return docs.select(doc.alias("doc"), text.alias("text")).select("doc", "text", F.xxhash64("text").alias("text_hash"), F.spark_partition_id().alias("part")).repartition(*_KEY)


def _requests(rows: DataFrame, seed: int) -> DataFrame:
    """cuts: the ordinals of the units after which a document is cut, none for a cut before its first unit."""
    first, second, _, _ = draws(F.col("doc"), seed)
    units = n_units(F.col("text")) + 1
    asked = rows.select(*_KEY, (first % units).alias("a"), (second % units).alias("b")).distinct()
    return asked.select(*_KEY, F.array(F.least("a", "b"), F.greatest("a", "b")).alias("cuts"))


def cut_offsets(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """_KEY, prefix_end, middle_end in characters, of each distinct row that has units."""
    units = rows.select(*_KEY, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("pos", "unit"))
    # repeated rows of one partition have the same units
    units = units.select(*_KEY, (F.col("pos") + 1).cast("long").alias("ordinal"), F.length("unit").alias("chars")).groupBy(*_KEY, "ordinal").agg(F.first("chars").alias("chars"))
    ends = units.withColumn("end", F.sum("chars").over(Window.partitionBy(*_KEY).orderBy("ordinal")))
    asked = _requests(rows, seed)
    same = [ends[c] == asked[c] for c in _KEY]
    # the ordinal is a condition beside the keys, not one of them, so that both sides stay where they are
    met = ends.join(asked, [*same, F.array_contains(asked["cuts"], ends["ordinal"])]).select(*[ends[c] for c in _KEY], "ordinal", "end", "cuts")
    end_of = lambda k: F.coalesce(F.max(F.when(F.col("ordinal") == F.col("cuts")[k], F.col("end"))), F.lit(0)).cast("long")
    return met.groupBy(*_KEY).agg(end_of(0).alias("prefix_end"), end_of(1).alias("middle_end"))


def rearranged(text: Column, form: Column, prefix_end: Column, middle_end: Column) -> Column:
    prefix = F.substring(text, F.lit(1), prefix_end.cast("int"))
    middle = F.substring(text, (prefix_end + 1).cast("int"), (middle_end - prefix_end).cast("int"))
    suffix = F.substring(text, (middle_end + 1).cast("int"), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone. Marks can't overlap what stands before or after them, and no part of a
    text that was cut holds one, so the first of each is the one put in."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    n, at, last = F.lit(len(PREFIX)), F.instr(output, second), F.instr(output, F.lit(MIDDLE))
    one = F.substring(output, n + 1, at - n - 1)
    two = F.substring(output, at + n, last - at - n)
    three = F.substring(output, last + n, F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, for every row of ``docs``."""
    rows = _dealt(docs, id_col, text_col)
    both = rows.join(cut_offsets(rows, seed), _KEY, "left")
    _, _, third, fourth = draws(F.col("doc"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (third % 100 >= rate), "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    none = F.lit(0).cast("long")
    doc_id = F.when(F.col("doc") != "", F.col("doc").cast("long"))
    both = both.select(doc_id.alias("doc_id"), "text", n_units(F.col("text")).alias("n"), form.alias("form"), F.coalesce("prefix_end", none).alias("prefix_end"), F.coalesce("middle_end", none).alias("middle_end"))
    cut = F.col("form") != "plain"
    return both.select(
        "doc_id", "n", "form",
        F.when(cut, F.col("prefix_end")).alias("prefix_chars"),
        F.when(cut, F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"),
        rearranged(F.col("text"), F.col("form"), F.col("prefix_end"), F.col("middle_end")).alias("output"),
    )


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || doc_id) AS digest FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
    ('0x' || digest[25:32])::BIGINT AS h4 FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
