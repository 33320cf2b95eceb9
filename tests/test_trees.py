"""Merged navigations, numbered tables of contents and configurations against recursive walks."""

import itertools
import json
import random

import pytest

from foliograph.operators import contents, merging
from foliograph.sources import configs
from pyspark.sql import functions as F

NAV = "node_id string, parent_id string, kind string, label string, page_id string, ord int"


def forest(rng, depth=0, names="abcdefghij"):
    """Nested navigation nodes with siblings of different names."""
    out = []
    for x in rng.sample(names, rng.randint(0 if depth else 3, 6)):
        group = depth < 3 and rng.random() < 0.4
        out.append({"kind": "group" if group else "page", "label": x, "page": None if group and rng.random() < 0.7 else f"{x}{rng.randint(0, 3)}", "kids": forest(rng, depth + 1, names) if group else []})
    return out


def nav_rows(nodes, name, parent=None):
    for k, n in enumerate(nodes):
        n["id"] = f"{parent or name}.{k}"
        yield n["id"], parent, n["kind"], n["label"], n["page"], k
        yield from nav_rows(n["kids"], name, n["id"])


def same(n):
    return f"p:{n['page']}" if n["page"] is not None else f"g:{n['label']}"


def rising(values):
    """A longest rising run by trying all, from the longest: of several the one that ends lowest (patience sorting ends there too)."""
    best = merging.longest_rising(values)
    n = next(n for n in range(len(values), -1, -1) if any(list(c) == sorted(c) for c in itertools.combinations(values, n)))
    assert len(best) == n and [values[i] for i in best] == sorted(values[i] for i in best)
    return best


def merge(a, b, placed):
    first = {}
    for n in a:
        first.setdefault(same(n), n)
    pairs, used = [], set()
    for n in b:
        if same(n) in first and same(n) not in used:
            used.add(same(n))
            pairs.append((a.index(first[same(n)]), n))
    by_a = sorted(pairs, key=lambda p: p[0])
    anchors = {id(by_a[i][1]): by_a[i][0] for i in rising([b.index(p[1]) for p in by_a])}
    partner = {p[0]: p[1] for p in pairs}
    out = [((i, 1, 0), {**n, "side": "both" if i in partner else "first", "kids": merge(n["kids"], partner[i]["kids"], placed) if i in partner else n["kids"], **({"kind": "group"} if i in partner and partner[i]["kind"] == "group" else {}), "label": n["label"], "page": n["page"] if n["page"] is not None else (partner[i]["page"] if i in partner else None)}) for i, n in enumerate(a)]
    before = 10**9
    for k in range(len(b) - 1, -1, -1):
        before = anchors.get(id(b[k]), before)
        if not any(b[k] is p[1] for p in pairs):
            out.append(((before, 0, k), {**b[k], "side": "second"}))
    return [n for _, n in sorted(out, key=lambda x: x[0])]


def pages_of(nodes):
    return {n["page"] for n in nodes if n["page"] is not None}.union(*(pages_of(n["kids"]) for n in nodes))


def pruned(nodes, placed, seen, side=None):
    """Without pages of the second side that are placed already, or again."""
    out = []
    for n in nodes:
        s = n.get("side", side)
        if s == "second" and n["kind"] == "page" and n["page"] is not None and (n["page"] in placed or n["page"] in seen):
            continue
        if s == "second" and n["kind"] == "page":
            seen.add(n["page"])
        out.append({**n, "side": s, "kids": pruned(n["kids"], placed, seen, "second" if s == "second" else "first")})
    return out


def flat_nav(nodes, above=()):
    for k, n in enumerate(nodes):
        yield (*above, k), n["side"], n["kind"], n["label"], n["page"]
        yield from flat_nav(n["kids"], (*above, k))


def test_merged_navigations(spark):
    for seed in range(6):
        rng = random.Random(seed)
        a, b = forest(rng), forest(rng)
        ra, rb = list(nav_rows(a, "x")), list(nav_rows(b, "y"))
        got = merging.merged(spark.createDataFrame(ra, NAV), spark.createDataFrame(rb, NAV)).collect()
        want = list(flat_nav(pruned(merge(a, b, None), pages_of(a), set())))
        assert sorted((tuple(r["path"]), r["side"], r["kind"], r["label"], r["page_id"]) for r in got) == sorted(want), seed


def test_merging_with_nothing_and_with_itself(spark):
    a = forest(random.Random(3))
    rows = spark.createDataFrame(list(nav_rows(a, "x")), NAV)
    none = rows.limit(0)
    shape = lambda df: sorted((tuple(r["path"]), r["label"]) for r in df.collect())
    assert merging.merged(none, none).count() == 0
    assert shape(merging.merged(rows, none)) == shape(merging.merged(rows, rows)) == sorted((tuple(p), label) for p, _, _, label, _ in flat_nav(pruned(a, set(), set(), "first")))
    assert {r["side"] for r in merging.merged(rows, rows).collect()} == {"both"}


def test_longest_rising():
    rng = random.Random(1)
    for _ in range(200):
        rising(rng.sample(range(9), rng.randint(0, 8)))


TOC = "toc string, node string, parent string, ord int, index int"
ENTRIES = "toc string, index int, link string, title string, bookmark string"


def toc_rows(rng, toc, n):
    """A random tree with long chains: nodes in no order."""
    rows = [(toc, "0", None, 0, 0)]
    for k in range(1, n):
        rows.append((toc, str(k), rng.choice([None, str(k - 1), str(k - 1), str(rng.randrange(k))]), rng.randint(0, 3), k))
    rng.shuffle(rows)
    return rows


def walk(rows, entries):
    """pre, size and depth of each node; what is shown; what is unresolved."""
    kids = {}
    for _, node, parent, ord_, index in rows:
        kids.setdefault(parent, []).append((ord_, node, index))
    numbers, shown, unresolved = {}, [], []

    def visit(parent, depth, hidden):
        total, any_shown = 0, False
        for _, node, index in sorted(kids.get(parent, []), key=lambda x: (x[0], x[1])):
            pre = len(numbers)
            numbers[node] = None
            e = entries.get(index)
            if e is None and not hidden:
                unresolved.append(node)
            place = len(shown)
            shown.append(None)
            size, below = visit(node, depth + 1, hidden or e is None)
            numbers[node] = (pre, size + 1, depth)
            page = e is not None and e[0] not in ("", "___")
            if not hidden and e is not None and (page or below):
                url = e[0].lstrip("/") + ("#" + e[2].removeprefix("#") if e[2] and "#" not in e[0] else "") if page else None
                shown[place] = (node, depth, "group" if below else "page", (e[1] or "Untitled") if below else (e[1] or None), url)
                any_shown = True
            total += size + 1
        return total, any_shown

    visit(None, 0, False)
    return numbers, [s for s in shown if s], unresolved


def test_tables_of_contents(spark):
    rng = random.Random(5)
    tocs = {f"t{k}": toc_rows(rng, f"t{k}", n) for k, n in enumerate([1, 2, 7, 40, 150])}
    entries = {t: {r[4]: (rng.choice(["/a/b", "c#x", "", "___", "//d"]), rng.choice(["", "T"]), rng.choice(["", "#m", "m"])) for r in rows if rng.random() < 0.85} for t, rows in tocs.items()}
    broken = [("bad", "a", "b", 0, 1), ("bad", "b", "a", 0, 2), ("bad", "c", "b", 0, 3), ("bad", "top", None, 0, 4), ("bad", "lost", "nowhere", 0, 5), ("bad", "under", "lost", 0, 6)]
    nodes = spark.createDataFrame([r for rows in tocs.values() for r in rows] + broken, TOC)
    table = spark.createDataFrame([(t, i, *e) for t, es in entries.items() for i, e in es.items()] + [("bad", 4, "x", "", "")], ENTRIES)
    got = {(r["toc"], r["node"]): (r["pre"], r["size"], r["depth"]) for r in contents.numbered(nodes).collect()}
    shown, problems = (df.collect() for df in contents.drawn(nodes, table))
    for t, rows in tocs.items():
        numbers, want, unresolved = walk(rows, entries[t])
        assert {n: v for (toc, n), v in got.items() if toc == t} == numbers
        assert [tuple(r[k] for k in ("node", "depth", "kind", "label", "url")) for r in sorted((r for r in shown if r["toc"] == t), key=lambda r: r["place"])] == want
        assert sorted(r["node"] for r in problems if r["toc"] == t) == sorted(unresolved)
    assert sorted(r["node"] for r in problems if r["toc"] == "bad" and r["problem"] == "unreached") == ["a", "b", "c", "lost", "under"]
    assert got[("bad", "top")] == (0, 1, 0) and got[("bad", "a")] == (None, None, None)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, written = [], contents.written
    monkeypatch.setattr(contents, "written", lambda df, name, **kw: rounds.append(name) or written(df, name, **kw))
    rows = [("t", str(k), str(k - 1) if k else None, 0, k) for k in range(900)]
    got = contents.numbered(spark.createDataFrame(rows, TOC)).collect()
    assert all((r["pre"], r["size"], r["depth"]) == (int(r["node"]), 900 - int(r["node"]), int(r["node"])) for r in got)
    assert rounds.count("tour") <= 13


def test_chunks_and_scripts(spark):
    text = "define({numchunks:2,prefix:'C',tree:{n:[{i:0,n:[{i:1},{i:2,n:[{i:3}]}]},{i:4}]}});"
    files = spark.createDataFrame([("t", text), ("none", "nothing here"), ("null", None), ("flat", "define({tree:{}})")], "toc string, text string")
    nodes = configs.contents_nodes(files.select("toc", configs.defined(F.col("text")).alias("v"))).collect()
    assert sorted((r["toc"], r["node"], r["parent"], r["ord"], r["index"]) for r in nodes) == [("t", "0", None, 0, 0), ("t", "0.0", "0", 0, 1), ("t", "0.1", "0", 1, 2), ("t", "0.1.0", "0.1", 0, 3), ("t", "1", None, 1, 4)]
    chunks = spark.createDataFrame([("t", 0, "/a", [0, 1], ["A", "B"], ["", "m"]), ("t", 1, "/b", [1, 2, None], ["C"], None)], "toc string, chunk int, link string, i array<int>, t array<string>, b array<string>")
    assert sorted(map(tuple, contents.chunk_entries(chunks).collect())) == [("t", 0, "/a", "A", ""), ("t", 1, "/b", "C", ""), ("t", 2, "/b", "", "")]


def config_walk(node, ctx, out):
    if isinstance(node, str):
        out.append((node, *ctx))
    elif isinstance(node, list):
        for n in node:
            config_walk(n, ctx, out)
    elif isinstance(node, dict):
        locale, version, groups, hidden = ctx
        get = lambda k: node[k] if isinstance(node.get(k), str) else None
        label = next((get(k) for k in configs.LABELS if get(k) is not None), None)
        if label is not None and get("version") is None and get("language") is None:
            groups = (*groups, label)
        new = (get("language") or locale, get("version") or version, groups, hidden or node.get("hidden") is True)
        for k in (*configs.DIVISIONS, "global"):
            if k in node and not (k in configs.LABELS and isinstance(node[k], str)):
                config_walk(node[k], new, out)


def config(rng, depth=0):
    r = rng.random()
    if r < 0.4 or depth > 4:
        return f"p{rng.randint(0, 8)}"
    if r < 0.6:
        return [config(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if r < 0.65:
        return rng.choice([7, None, True])
    node = {k: [config(rng, depth + 2) for _ in range(rng.randint(0, 3))] for k in rng.sample(configs.DIVISIONS, 2)}
    node |= {rng.choice(configs.LABELS): rng.choice(["L", "en", 5])}
    return node | ({"hidden": rng.choice([True, False])} if rng.random() < 0.3 else {}) | ({"global": config(rng, depth + 2)} if rng.random() < 0.2 else {})


def test_configurations(spark):
    rng = random.Random(2)
    made = {k: {"navigation": config(rng) if k else {"versions": [{"version": "1", "pages": ["p1", "p1"]}, {"version": "2", "pages": ["p1"]}]}} for k in range(40)}
    rows = [(k, json.dumps(c)) for k, c in made.items()] + [(100, "no json"), (101, None), (102, '{"other": 1}')]
    files = [(k, f"p{i}") for k in (*made, 100) for i in range(5)]
    got = configs.listed_pages(spark.createDataFrame(rows, "config int, json string"), spark.createDataFrame(files, "config int, path string")).collect()
    for k, c in made.items():
        out = []
        config_walk(c["navigation"], (None, None, (), False), out)
        first = {}
        for path, locale, version, groups, hidden in out:
            first.setdefault((path, locale, version), (groups, hidden))
        there = [key for key in first if key[0] in {f"p{i}" for i in range(5)}]
        want = [(*key, list(g), h, there.index(key) if key in there else None, "listed" if key in there else "missing") for key, (g, h) in first.items()]
        want += [(f"p{i}", None, None, None, None, None, "unlisted") for i in range(5) if f"p{i}" not in {key[0] for key in first}]
        assert sorted((tuple(r[1:]) for r in got if r["config"] == k), key=str) == sorted(want, key=str)
    assert sum(r["config"] == 0 and r["status"] == "listed" for r in got) == 2 and all(r["status"] == "unlisted" for r in got if r["config"] == 100)


@pytest.mark.parametrize("kind", ["toc", "config"])
def test_empty(spark, kind):
    if kind == "toc":
        none, entries = spark.createDataFrame([], TOC), spark.createDataFrame([], ENTRIES)
        assert contents.numbered(none).count() == 0 and all(df.count() == 0 for df in contents.drawn(none, entries))
    else:
        assert configs.listed_pages(spark.createDataFrame([], "config int, json string"), spark.createDataFrame([], "config int, path string")).count() == 0
