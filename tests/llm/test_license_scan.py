import re

import duckdb

from foliograph.llm import license_scan as ls
from tests.llm.helpers import ODD, docs, prose, saved, with_clashes


def grams(unit):
    w = re.sub(r"[\W_]+", " ", unit.lower()).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def windows(text):
    """All windows at a probe that match, the best first, each unless a better one that stays overlaps it: places are crossed off."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = set()
    for name, template in ls.TEMPLATES.items():
        size, theirs = len(ls.template_words(template)), grams(template)
        for gram, at in ls.probe_bigrams(template, ls.THRESHOLD):
            for i in range(len(words) - 1):
                if f"{words[i]} {words[i + 1]}" == gram:
                    start = max(0, i - at)
                    own = words[start : start + size]
                    dice = 2 * len(grams(" ".join(own)) & theirs) / (len(grams(" ".join(own))) + len(theirs))
                    if dice >= ls.THRESHOLD:
                        found.add((-dice, -len(own), name, start))
    out, used = [], set()
    for minus, less, name, start in sorted(found):
        places = set(range(start, start - less))
        if not places & used:
            used |= places
            out.append((minus, name, " ".join(words[start : start - less])))
    return out


def brute(text):
    text = text or ""
    units = {" ".join(re.sub(r"[\W_]+", " ", u.lower()).split()): grams(u) for u in [*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text]}
    found, read = [], set()
    for unit, g in units.items():
        scores = [(-2 * len(g & set(ls.template_bigrams(t))) / (len(g) + len(ls.template_bigrams(t))), k) for k, t in ls.TEMPLATES.items()]
        if g and -min(scores)[0] >= ls.THRESHOLD:
            found.append(min(scores))
            read.add(unit)
    found += [(m, k) for m, k, unit in windows(text) if unit not in read]
    return len(found), ",".join(sorted({k for _, k in found})), max([-s for s, _ in found], default=0.0)


def test_against_brute_force_and_oracle(spark, tmp_path):
    texts = [prose(i, 60) for i in range(30)]
    for i, (k, t) in enumerate(ls.TEMPLATES.items()):
        texts.append(f"{prose(i, 9)}\n{t}\n{prose(i, 9)}")
        texts.append("\n\n".join([prose(i, 9), "\n".join(re.findall(r".{1,60}(?:\s|$)", t)), prose(i, 9)]))
        words = t.split()
        words[len(words) // 2] = "other"
        texts.append(" ".join(words).upper())
        texts.append(f"{prose(i, 9)} {t} {prose(i + 1, 30)}")  # inside a running paragraph
        texts.append("import os\n" + "\n".join(f"// {x}" for x in re.findall(r".{1,50}(?:\s|$)", t)) + "\nint main() {}")  # wrapped over comment lines
        texts.append(f"{t} {t}\n{words[0]} {t}")
    bsd, apache = ls.TEMPLATES["bsd-2-clause"], ls.TEMPLATES["apache-2.0"]
    several = [f"{ls.TEMPLATES['mit']} {prose(1, 20)} {ls.TEMPLATES['mit']}", f"{ls.TEMPLATES['bsd-2-clause-body']} {prose(2, 40)} {bsd}", f"{ls.TEMPLATES['apache-2.0-header']} {prose(3, 60)} {apache}", f"{bsd} {prose(4, 9)} {bsd} {prose(5, 9)} {bsd}"]
    texts = [*several, *texts]
    texts += ["Copyright 2019 Foo. Released under the MIT License. See LICENSE.", "under the License. " * 40, ""]
    rows = list(enumerate(texts))
    folder = saved(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in ls.op3_license_scan(spark, folder).collect())
    assert [(i, n, k, round(d, 12)) for i, n, k, d in got] == [(i, n, k, round(d, 12)) for i, (n, k, d) in ((i, brute(t)) for i, t in rows)]
    found = {i: set(k.split(",")) for i, _, k, _ in got}
    for i, k in enumerate(ls.TEMPLATES):  # each in every setting but the altered one; a body holds its shorter notice
        for setting in (0, 1, 3, 4, 5):
            assert any(k == f or f.startswith(k.split("-")[0]) for f in found[34 + 6 * i + setting]), (k, setting)
    assert found[34 + 6 * len(ls.TEMPLATES)] == {"mit"} and found[len(rows) - 1] == {""}
    # separate notices of one template or beside another count each
    assert got[0][1] >= 2 and {"bsd-2-clause", "bsd-2-clause-body"} <= found[1] and {"apache-2.0", "apache-2.0-header"} <= found[2] and got[3][1] >= 3
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ls.ORACLE).fetchall()) == got


def test_every_match_holds_a_probe():
    probes = ls.probes(ls.TEMPLATES, ls.THRESHOLD)
    for text in ls.TEMPLATES.values():
        g = ls.template_bigrams(text)
        bare = [x for x in g if not any(p in x if len(p) >= ls.LONG_WORD else p in x.split() for p in probes)]
        assert len(bare) < ls.THRESHOLD / (2 - ls.THRESHOLD) * len(g)


def test_odd_rows(spark):
    got = ls.scan(with_clashes(docs(spark, ODD))).collect()
    assert len(got) == len(ODD) and all(r["matches"] == [] for r in got)
    assert ls.scan(docs(spark, [])).count() == 0
