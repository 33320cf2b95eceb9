import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from foliograph.llm import jaccard_join as jj
from foliograph.llm.components import components
from tests.llm.helpers import ODD, check_stage_keeps_columns, docs, prose, saved, with_clashes


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = defaultdict(int), defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                if sets[i] != sets[j]:
                    texts[i].add(sets[j])
                    texts[j].add(sets[i])
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, least[find(i)] if doc_id is not None else None, links[i], len(texts[i])) for i, (doc_id, _) in enumerate(rows) if doc_id is not None)


def near_copies(seed, n, edits, words=120):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 99))
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)
    texts = [*near_copies(1, 40, 5), *near_copies(2, 30, 3, 60), *near_copies(3, 12, 9), *[prose(50 + i, 80) for i in range(40)], *[prose(7, 70)] * 9, "just four words here", "Just  four words HERE", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in ODD if i is not None and i != 4] + [(None, texts[0])]
    random.Random(4).shuffle(rows)
    got = jj.near_duplicates(with_clashes(docs(spark, rows)))
    assert got.count() == len(rows)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got.collect() if r["doc_id"] is not None) == brute(rows)


def test_query_and_its_sql(spark, tmp_path):
    rows = [*enumerate([*near_copies(1, 20, 6), *[prose(50 + i, 40) for i in range(20)], *[prose(7, 70)] * 3, "a b c", "A  b c", "", " "])]
    folder = saved(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in jj.op9_jaccard_join(spark, folder).collect()) == sorted(con.sql(jj.ORACLE).fetchall())


def test_one_of_each_stays(spark):
    rows = [(5, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (9, ""), (8, None), (None, "one two three four five six"), (4, prose(1, 30))]
    frame = with_clashes(docs(spark, rows))
    kept = jj.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "8", "9", "None"]


def test_least_matches_is_the_posterior():
    for n in (32, 64, 128):
        m = jj.least_matches(n)
        s = np.linspace(0, 1, 20001)
        for k, under in ((m, False), (m - 1, True)):
            density = s**k * (1 - s) ** (n - k)
            posterior = density[s >= 0.8].sum() / density.sum()
            assert (posterior < jj.TOLERANCE) == under or posterior == pytest.approx(jj.TOLERANCE, rel=0.05)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + rng.randint(0, 30), 200 + rng.randint(0, 30)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {i: i for e in edges for i in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {i: p for i, p in parent.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_empty(spark):
    assert jj.near_duplicates(docs(spark, [])).count() == 0 and jj.one_of_each(docs(spark, [])).count() == 0


def test_columns_of_any_name_stay(spark):
    check_stage_keeps_columns(jj.one_of_each, docs(spark, [(1, prose(1, 50)), (2, prose(1, 50)), (2, prose(1, 50)), (3, prose(3, 40)), (None, "x"), (4, None)]))
