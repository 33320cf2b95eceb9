import random
import re

import duckdb
import numpy as np
import pytest

from foliograph.llm import tensor_dedup as td
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes
from tests.llm.test_jaccard_join import near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j] or 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j]):
                continue
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return [(i, len(s), least[g] if i is not None else None, i is None or i == least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def chain(seed, n, step=4, words=150):
    """Each text near the one before it, the first and the last far apart: no partner serves all."""
    w, out, rng = prose(seed, words).split(), [], random.Random(seed)
    for k in range(n):
        for _ in range(step):
            w[rng.randrange(len(w))] = f"new{k}"
        out.append(" ".join(w))
    return out


TEXTS = [*near_copies(1, 40, 5), *near_copies(2, 30, 3, 60), *near_copies(3, 25, 12), *chain(9, 30), *[prose(50 + i, 80) for i in range(30)], *[prose(7, 70)] * 9, "just four words here", "Just  four words HERE", "just\x0bfour words HERE", "a b", "A\tb", "a b c", "É b", "é b",
    # one passage in many texts, which are no near copies of each other
    *[prose(77, 40) + " " + prose(200 + i, 60) for i in range(25)]]


def checked(spark, rows):
    got = td.near_duplicates(with_clashes(docs(spark, rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(td, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, t) for i, t in ODD if i is not None] + [(None, TEXTS[0]), (5000, TEXTS[0]), (5000, TEXTS[45])]
    random.Random(4).shuffle(rows)
    checked(spark, rows)


def test_query_and_its_sql(spark, tmp_path):
    folder = saved(spark, tmp_path, [*enumerate(TEXTS[::3]), (900, ""), (901, None), (902, " \n")])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, td.op12_tensor_dedup(spark, folder).collect())) == sorted(con.sql(td.ORACLE).fetchall())


def test_sets_at_the_threshold_are_found(spark):
    """Pairs of 4 in 5 exactly: linked, and one shingle less is not."""
    sets, rng = td.WordSets(), np.random.default_rng(3)
    for n in (5, 50, 500):
        words = [f"w{k}" for k in rng.permutation(n + 3)]
        a = sets(" ".join(words))
        assert len(a) == n
        assert td.linked(a, a[: n * 4 // 5]) and not td.linked(a, a[: n * 4 // 5 - 1])


def test_misses_of_the_tables():
    """Random sets at the threshold share a table as often as stated; they are sets of numbers, not texts."""
    rng, family, missed = np.random.default_rng(5), td.hash_family(), 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = (td.min_hashes(np.sort(s), family).view(np.uint32).reshape(2, td.HALVES) for s in (x[:81], np.r_[x[9:81], x[81:]]))
        missed += not (a == b).any(axis=1).all()
    assert missed == 0
    assert 2 * (1 - 0.8**td.VALUES) ** td.HALVES < 2e-6


def test_bins_tell_sets_apart():
    rng, family = np.random.default_rng(6), td.hash_family()
    sketch = lambda s: td.bin_minima(np.sort(s))
    for n in (3, 60, 2000):
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        for share in (0.0, 0.5, 0.9):
            m = int(n * share)
            a, b = sketch(x[:n]), sketch(np.r_[x[:m], x[n : 2 * n - m]])
            looked, equal = ((a | b) > 0).sum(), ((a == b) & (a > 0)).sum()
            assert abs(equal / looked - m / (2 * n - m)) < 0.2 if n > 3 else looked <= 6
    assert len(family[0]) == td.HASHES


def test_only_partners_and_open_buckets_move(spark, monkeypatch):
    """A large group of near copies is settled by partners; its texts are not needed in blocks."""
    asked = []
    monkeypatch.setattr(td, "_verified_blocks", lambda rows, threshold, f=td._verified_blocks: asked.append(rows.count()) or f(rows, threshold))
    checked(spark, list(enumerate(near_copies(5, 150, 1, 200))))
    assert asked == [0]


def test_empty(spark):
    assert td.near_duplicates(docs(spark, [])).count() == 0
