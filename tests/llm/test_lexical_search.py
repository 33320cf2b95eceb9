import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliograph.llm import lexical_search as ls
from tests.llm.helpers import ODD, docs, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(documents, items, k=20):
    tf = [(i, Counter(terms(t))) for i, t in documents if i is not None]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    asked: dict[int, Counter] = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    for item, query in asked.items():
        scores = []
        for i, c in tf:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in query.items() if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(n=400):
    rng = random.Random(11)
    words = prose(1, 300).split()
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(0, 90)))) for i in range(n)]
    rows += [(1000 + i, t) for i, t in ODD if i is not None] + [(None, words[0])] + [(2000 + i, "The Same text, again") for i in range(90)] + [(7, "another text of seven"), (8, words[9] + " ")] * 2
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "nowhere-else"), (53, "THE same_text the"), (53, "THE same_text the"), (53, "word"), (None, words[0]), (54, "é😀 ß日本"), (55, "0 a-b.c")]
    return rows, items


@pytest.mark.parametrize(("block", "segment"), [(128, 8192), (4, 37)])
def test_against_brute_force(spark, monkeypatch, block, segment):
    for name, value in (("BLOCK", block), ("SEGMENT_DOCS", segment), ("ITEMS", segment), ("DOCS_AT_ONCE", block)):
        monkeypatch.setattr(ls, name, value)
    rows, items = corpus()
    got = ls.ranked(with_clashes(docs(spark, rows)).repartition(3), with_clashes(items_of(spark, items)))
    assert sorted(map(tuple, got.collect())) == brute(rows, items)


def test_query_and_its_sql(spark, tmp_path):
    rows, items = corpus(150)
    rows, items = list({i: (i, t) for i, t in rows if i is not None}.values()), list({i: (i, t) for i, t in items if i is not None}.values())
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    items_of(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, ls.op13_lexical_search(spark, str(tmp_path)).collect())) == sorted(con.sql(ls.ORACLE).fetchall()) == brute(rows, items)


def test_packing():
    rng = np.random.default_rng(2)
    values = np.concatenate([[0, 127, 128, 16383, 16384, 2**31, 2**40], rng.integers(0, 300, 500)]).astype(np.int64)
    data, size = ls.packed(values)
    assert size.sum() == len(data) and (ls.unpacked(data) == values).all()
    assert len(ls.unpacked(ls.packed(np.zeros(0, np.int64))[0])) == 0


def test_blocks_below_the_threshold_stay_compressed(monkeypatch):
    """A rare term settles the best documents; of a frequent one most blocks are never opened."""
    monkeypatch.setattr(ls, "BLOCK", 16)
    monkeypatch.setattr(ls, "DOCS_AT_ONCE", 16)
    texts = [["common"] * (9 if 40 <= i < 60 else 1) + (["rare"] if i % 500 == 3 else []) + ["x"] * (i % 7) for i in range(3000)]
    rows = [r for b in ls._segment(0, list(range(3000)), [[w.encode() for w in t] for t in texts], 3000, sum(map(len, texts))) for r in b.to_pylist()]
    own = next(r for r in rows if r["term"] == b"")
    ids, m = np.frombuffer(own["block_last"], np.int64), np.frombuffer(own["block_max"], np.int64)
    common, rare = (ls.Postings(next(r for r in rows if r["term"] == t)) for t in (b"common", b"rare"))
    nothing = np.zeros(0, np.int64)
    scores, found = ls.search([(common, 10), (rare, 6000)], m, ids, (nothing, nothing), 5)
    count = np.array([t.count("common") for t in texts])
    every = 10 * ls.impact(count, m) + 6000 * ls.impact(np.array([t.count("rare") for t in texts]), m)
    assert scores.tolist() == sorted(every.tolist(), reverse=True)[:5] and (every[found] == scores).all()
    assert len(common.opened) < len(common.last) / 4


def test_empty(spark):
    none, some = docs(spark, []), items_of(spark, [(1, "word")])
    assert ls.ranked(none, some).count() == 0 and ls.ranked(docs(spark, [(1, "word")]), items_of(spark, [])).count() == 0
    assert ls.ranked(docs(spark, [(1, None), (2, " . ")]), some).count() == 0
