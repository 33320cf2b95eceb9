import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from foliograph.llm import fill_in_middle as fim
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes


def brute(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines(seed, n):
    rng = random.Random(seed)
    return "\n".join(rng.choice(["", prose(seed + k, rng.randint(1, 9)), "é😀 ß", "<", "<P", "<<S", "M>", "\r"]) for k in range(n)) + rng.choice(["", "\n", "\n\n"])


ROWS = [*ODD, *[(100 + i, lines(i, i % 12)) for i in range(60)], (300, "a <P> b\nc"), (301, "x\n<M>\ny"), (302, "<S>"), (303, "\n"), (304, "one line"), (305, "line\n" * 40000), (306, "a\nb"), (306, "a\nc"), (306, "a\nb")]
key = str


def test_against_brute_force(spark):
    frame = with_clashes(docs(spark, ROWS)).repartition(3)
    for rate, suffix_first in ((100, 50), (40, 100)):
        got = fim.fill_in_middle(frame, rate=rate, suffix_first=suffix_first).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted((tuple(r[:6]) for r in got), key=key) == sorted((brute(i, t, rate, suffix_first) for i, t in ROWS), key=key)
        assert sorted(r["again"] for r in got) == sorted(t or "" for _, t in ROWS)
    assert {r["form"] for r in got} == {"plain", "spm"}


def test_the_texts_are_dealt_once(spark):
    found = fim.fill_in_middle(docs(spark, ROWS))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") == plan.count("ReusedExchange") + 1 and "ENSURE_REQUIREMENTS" not in plan


def test_query_and_its_sql(spark, tmp_path):
    rows = [(i, t) for i, t in dict((i, (i, t)) for i, t in ROWS if i is not None).values()]
    folder = saved(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = fim.op11_fill_in_middle(spark, folder)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.sql(fim.ORACLE).fetchall(), key=key)
    assert got.columns == [c[0] for c in con.sql(fim.ORACLE).description]


def test_empty(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0
