import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import fingerprint as fp
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_extension_and_equality(x, y, a, b):
    a, b = min(a, len(x)), min(b, len(y))
    hx, hy = fp.PrefixHashes(x), fp.PrefixHashes(y)
    want = 0
    while a + want < len(x) and b + want < len(y) and x[a + want] == y[b + want]:
        want += 1
    assert hx.common_extension(a, hy, b) == want
    for n in (0, want, want + 1):
        assert hx.equal(a, hy, b, n) == (a + n <= len(x) and b + n <= len(y) and x[a : a + n] == y[b : b + n])


def test_long_text_and_likeness():
    letters = random.Random(1).choices("abcdefghijklmnopqrstuvwxyz ", k=900_000)
    text = "".join(letters[:450_000])
    p = fp.Print(text)
    assert p.n == len(text) and fp.likeness(str(p), str(fp.Print(text))) == 1.0
    changed = fp.Print(text[: len(text) // 2] + "".join(letters[450_000:675_000]))
    assert 0.15 < fp.likeness(str(p), str(changed)) < 0.55
    assert fp.likeness(str(fp.Print("")), str(p)) == 0.0 and fp.likeness(str(fp.Print(None)), str(fp.Print(""))) == 1.0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 7 - 50, prose(i, rng.randint(0, 200)) if i % 9 else "same text " * 5) for i in range(120)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fp.op1_fingerprint(spark, saved(spark, tmp_path, rows)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following, r = rows[(k + 1) % len(rows)][1], got[i]
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == str(fp.Print(text)) and r["edited_fingerprint"] == str(fp.Print(new))
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fp.likeness(r["fingerprint"], str(fp.Print(following)))
        same = next((j for j, (a, b) in enumerate(zip(text, new, strict=False)) if a != b), min(len(text), len(new)))
        assert r["kept_chars"] == same
    assert len({r["fingerprint"] for i, r in got.items() if dict(rows)[i].startswith("same text")}) == 1


def test_odd_rows(spark):
    frame = with_clashes(docs(spark, ODD))
    got = fp.neighbour_fingerprints(frame).collect()
    assert len(got) == len(ODD) and fp.fingerprints(frame).count() == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in ODD)
    null = next(r for r in got if r["doc_id"] is None)
    assert null["edited_sha256"] == hashlib.sha256(fp.edited(order[0][1], order[1][1] or "").encode()).hexdigest()
    assert fp.neighbour_fingerprints(docs(spark, [])).count() == 0
    alone = fp.neighbour_fingerprints(docs(spark, [(1, "abcdefgh")])).collect()
    assert len(alone) == 1 and alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def counted_spans(text, span):
    """Each span with the number of its occurrence, found by slicing."""
    seen, out = Counter(), set()
    for k in range(len(text) - span + 1):
        piece = text[k : k + span]
        seen[piece] += 1
        out.add((piece, seen[piece]))
    return out


def jaccard(a, b):
    span = next((s for s in (8, 4, 2, 1) if 4 * s <= min(len(a), len(b))), 1)
    x, y = counted_spans(a, span), counted_spans(b, span)
    return len(x & y) / len(x | y)


def test_likeness_against_plain_sets():
    """Short texts exactly, long ones within the sketch's error; one character less never makes texts unlike."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    for n in range(2, 81):
        text = letters(n)
        for other in (text[:-1], text[1:], letters(rng.randint(1, 60)), text[: n // 2] + letters(5)):
            got, want = fp.likeness(str(fp.Print(text)), str(fp.Print(other))), jaccard(text, other)
            assert abs(got - want) < (1e-9 if max(n, len(other)) <= 40 else 0.25), (text, other)
            assert got == fp.alike(fp.Print(text), fp.Print(other))
        if n >= 8:
            assert fp.likeness(str(fp.Print(text)), str(fp.Print(text[:-1]))) > 0.8
    errors = []
    for _ in range(60):
        text = letters(rng.randint(100, 900))
        other = text[: rng.randint(0, len(text))] + letters(rng.randint(0, 300))
        errors.append(fp.likeness(str(fp.Print(text)), str(fp.Print(other))) - jaccard(text, other))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03
    assert fp.likeness(str(fp.Print("ab")), str(fp.Print(letters(500)))) == 0.0
    assert fp.likeness(str(fp.Print("")), str(fp.Print("a"))) == 0.0
