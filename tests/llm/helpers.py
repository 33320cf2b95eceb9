"""Small tables for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def saved(spark, tmp_path, rows, labels=()):
    """A folder with documents.parquet and labels.parquet."""
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(i, 1, t) for i, t in labels], schema).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "ska", "un", "dor", "e", "vi", "pra"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


#: Nulls, empty and odd texts, repeated rows.
ODD = [(None, "a text without an id, long enough to count"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "é😀▁ß x\n\n日本"), (6, "word " * 3000)]


def with_clashes(frame):
    """The table with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["doc", "row_hash", "key", "pos", "size", "score", "rank", "rid", "rep", "bucket", "block", "head", "at", "target", "taken", "held_out", "label", "matches", "base", "node", "pieces", "once", "twice", "runs", "words", "times", "symbols", "share", "u", "m", "n",
        "row", "old", "kept", "copy", "dup", "of_id", "of_hash", "of_dup", "mixed", "text_hash", "keep", "n_dropped", "lines", "source_no", "skip", "class_id", "copy_id", "__score", "__hash", "__doc", "__runs", "__size", "__dup", "__text", "__pieces", "__id", "__h", "__d"]
    return frame.withColumns({n: F.lit(n) for n in names})


def check_stage_keeps_columns(stage, frame):
    """A pipeline stage gives the columns of its input whatever they are called, with their values, and the same rows as without them."""
    clashing = with_clashes(frame)
    got, plain = stage(clashing), stage(frame)
    assert got.columns == clashing.columns and plain.columns == frame.columns
    extra = clashing.columns[len(frame.columns) :]
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in extra)
    order = lambda r: tuple(str(r[c]) for c in frame.columns)
    assert sorted(map(order, rows)) == sorted(map(order, plain.collect()))
