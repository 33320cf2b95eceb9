import hashlib
from collections import defaultdict

import duckdb

from foliograph.llm import line_dedup
from tests.llm.helpers import ODD, check_stage_keeps_columns, docs, prose, saved, with_clashes

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(SPACE).translate(low)
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def collected(frame):
    from pyspark.sql import functions as F

    return [tuple(r) for r in frame.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()]


def test_against_brute_force(spark):
    shared = "  This Line is Shared\t"
    rows = [*ODD, (10, f"{shared}\nown line of ten\nshort\n{shared}"), (11, f"x\nthis line is shared\nÉtats partagés\nshort"), (12, "états partagés\nÉtats partagés\n\nTHIS LINE IS SHARED"), (13, "\n".join(["THIS LINE IS SHARED", "kept here only 13", "this line is shared "] * 40)), (14, "a text without an id, long enough to count")]
    key = lambda r: tuple(map(str, r))
    assert sorted(collected(line_dedup.dedup_lines(with_clashes(docs(spark, rows)))), key=key) == sorted(brute(rows), key=key)


def test_hot_line_and_oracle(spark, tmp_path):
    hot = "the very frequent line of them all"
    rows = [(i, "\n".join([prose(i, 9), hot if i % 3 else prose(i % 7, 9), prose(i % 5, 9)])) for i in range(200)]
    folder = saved(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in line_dedup.op8_line_dedup(spark, folder).collect())
    assert got == sorted(brute(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(line_dedup.ORACLE).fetchall()) == got


def test_columns_stay(spark):
    rows = docs(spark, [(1, "first line here\nB"), (2, "first line here\nC"), (None, None)])
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(with_clashes(rows)).collect()}
    assert got[2]["text"] == "C" and got[2]["n_chars"] == 1 and got[1]["text"] == "first line here\nB" and got[None]["text"] is None
    assert line_dedup.deduplicated(rows).columns == rows.columns


def test_empty(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_columns_of_any_name_stay(spark):
    check_stage_keeps_columns(line_dedup.deduplicated, docs(spark, [(1, "first line here\nB"), (2, "first line here\nC"), (2, "first line here\nC"), (None, None)]))
