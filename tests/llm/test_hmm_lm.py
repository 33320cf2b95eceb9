import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliograph.llm import hmm_lm
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def check_base(rows, got, held):
    counts = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            counts.update(toks(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(toks(t)), sum(counts[w] > 0 for w in toks(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hmm_lm, "KNOWN", 150)  # so that most words meet the counts in the join
    # two languages that share no word
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).upper().translate(str.maketrans("AEIO", "ÄËÏÖ"))) for i in range(150)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = hmm_lm.op5_hmm_lm(spark, saved(spark, tmp_path, rows)).collect()
    check_base(rows, got, held)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(2)
    k, m = hmm_lm.STATES, 5
    emit, move, start = rng.random((m, k)), rng.random((k, k)), rng.random(k)
    model = hmm_lm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), start)
    texts = [np.array(t, np.uint16) for t in ([1], [0, 4, 2], [3, 3], [2, 1, 0])]
    for text, got in zip(texts, hmm_lm.forward(model, texts), strict=True):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            total += p
        assert got == pytest.approx(math.log10(total))


def test_steps_do_not_lower_the_likelihood():
    rng = np.random.default_rng(4)
    texts = [np.array(rng.integers(0, 6, 40) + (0 if i % 2 else 6), np.uint16) for i in range(60)]
    symbols = np.bincount(np.concatenate(texts), minlength=12) + 0.1
    model, last = hmm_lm.Model.first(symbols), -math.inf
    for _ in range(8):
        now = hmm_lm.forward(model, texts).sum()
        assert now > last - 0.5  # the prior may cost a little
        last = now
        got = hmm_lm.Expected(model)
        got.add(texts)
        got.flush()
        assert got.emit.sum() == pytest.approx(60 * 40, rel=1e-4) and got.start.sum() == pytest.approx(60, rel=1e-4)
        model = hmm_lm.Model.counted(got.emit, got.move, got.start, symbols)


def test_expected_counts_against_all_paths(monkeypatch):
    """Sums over every state path, of texts shorter than a stretch; and longer ones cut into stretches come near uncut ones."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(hmm_lm, "STATES", 2)
    k, m = 2, 4
    emit, move, start = rng.random((m, k)), rng.random((k, k)), rng.random(k)
    model = hmm_lm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), start / start.sum())
    texts = [np.array(t, np.uint16) for t in ([1], [0, 3, 2, 2, 1, 0, 3], [3, 3], [2, 1, 0, 0, 1])]
    want_emit, want_move, want_start, likelihood = np.zeros((m, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for text in texts:
        weighed = []
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            weighed.append((path, p))
        total = sum(p for _, p in weighed)
        likelihood += math.log(total)
        for path, p in weighed:
            want_start[path[0]] += p / total
            for t, s in enumerate(path):
                want_emit[text[t], s] += p / total
                if t:
                    want_move[path[t - 1], s] += p / total

    def counted(texts):
        got = hmm_lm.Expected(model)
        got.add(texts)
        got.flush()
        return got

    got = counted(texts)
    assert got.log_likelihood == pytest.approx(likelihood, rel=1e-5)
    for a, b in ((got.emit, want_emit), (got.move, want_move), (got.start, want_start)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)
    long = [np.array(rng.integers(0, m, n), np.uint16) for n in (700, 193, 192, 208, 1)]
    cut = counted(long)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 10_000)
    whole = counted(long)
    assert cut.move.sum() == pytest.approx(sum(len(t) - 1 for t in long), rel=1e-4)
    assert cut.log_likelihood == pytest.approx(whole.log_likelihood, rel=1e-6)
    for a, b in ((cut.emit, whole.emit), (cut.move, whole.move), (cut.start, whole.start)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("rare", [1e-3, 1e-6, 1e-9])
def test_improbable_transitions(monkeypatch, rare):
    """Texts that change state at every step, by transitions and emissions that hardly ever occur, against double precision."""
    monkeypatch.setattr(hmm_lm, "STATES", 2)
    move = np.array([[1 - rare, rare], [rare, 1 - rare]])
    emit = np.array([[1 - rare, rare], [rare, 1 - rare]])
    model = hmm_lm.Model(np.array([0.5, 0.5]), move, emit, np.array([0.5, 0.5]))
    texts = [np.array([k % 2 for k in range(n)], np.uint16) for n in (1, 2, 40, 300)]
    got = hmm_lm.Expected(model)
    got.add(texts)
    got.flush()
    want_emit, want_move, want_start = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros(2)
    for text in texts:
        alphas, betas = [model.start * emit[text[0]]], [np.ones(2)]
        alphas[0] = alphas[0] / alphas[0].sum()
        for x in text[1:]:
            a = alphas[-1] @ move * emit[x]
            alphas.append(a / a.sum())
        for x in text[:0:-1]:
            b = move @ (emit[x] * betas[0])
            betas.insert(0, b / b.sum())
        for t, x in enumerate(text):
            g = alphas[t] * betas[t]
            want_emit[x] += g / g.sum()
            want_start += g / g.sum() if t == 0 else 0
            if t:
                pair = alphas[t - 1][:, None] * move * (emit[x] * betas[t])
                want_move += pair / pair.sum()
    assert got.log_likelihood == pytest.approx(math.log(10) * hmm_lm.forward(model, texts).sum(), rel=1e-4)
    for a, b in ((got.emit, want_emit), (got.move, want_move), (got.start, want_start)):
        assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-3, atol=1e-3)


def test_known_words_whatever_the_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "KNOWN", 300)
    words = [(f"w{k}".encode(), 1) for k in range(1000)] + [(f"v{k}".encode(), 5 + k % 3) for k in range(120)]
    v = hmm_lm.Vocabulary(spark.createDataFrame(words, "word binary, n long"), 3)
    assert len(v.rank) == 300 and all(f"v{k}".encode() in v.rank for k in range(120))
    assert len(hmm_lm.Vocabulary(spark.createDataFrame(words[:300], "word binary, n long"), 3).rank) == 300


def test_all_words_of_a_class_share_its_probability(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in Counter(prose(1, 400).split()).items()], "word binary, n long")
    v = hmm_lm.Vocabulary(counts, 3)
    words = {bytes(r["word"]): r["n"] for r in counts.collect()}
    share = Counter()
    for w, n in words.items():
        if v.rank[w] >= hmm_lm.TOP:
            share[hmm_lm.class_of(w)] += (n + 0.1) / 10 ** v.class_log[hmm_lm.class_of(w)]
    unseen = 0.1 / 10**v.class_log
    assert all(s + unseen[c] == pytest.approx(1) for c, s in share.items())
    assert v.tokens == sum(words.values()) + 3 and v.distinct == len(words) + 1


def test_odd_rows(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = hmm_lm.language_scores(with_clashes(docs(spark, ODD))).collect()
    check_base(ODD, got, held)
    assert all(math.isfinite(r["score"]) for r in got)
    assert hmm_lm.language_scores(docs(spark, [])).count() == 0
    alone = hmm_lm.language_scores(docs(spark, [(None, "never learned from")])).collect()[0]
    assert alone["train_tokens"] == 0 and alone["base_score"] == 0 and alone["n_known"] == 0


def test_every_step_sees_all_texts_until_the_likelihood_settles(spark, tmp_path, monkeypatch):
    seen, step = [], hmm_lm.baum_welch

    def watched(rows, model, symbols):
        found = step(rows, model, symbols)
        seen.append((rows.count(), found[1]))
        return found

    monkeypatch.setattr(hmm_lm, "baum_welch", watched)
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30).translate(str.maketrans("aeio", "äëïö"))) for i in range(60)]
    got = hmm_lm.op5_hmm_lm(spark, saved(spark, tmp_path, rows)).collect()
    texts, tokens = sum(not r["held_out"] for r in got), got[0]["train_tokens"]
    gains = [(b - a) / tokens for (_, a), (_, b) in zip(seen, seen[1:], strict=False)]
    assert len(seen) > 3 and all(n == texts for n, _ in seen)
    assert max(gains[-2:]) < hmm_lm.SETTLED and all(max(pair) >= hmm_lm.SETTLED for pair in zip(gains[:-2], gains[1:-1], strict=True))
