import random
import re

import pytest

from foliograph.operators import masking as mk

CASES = [
    ("plain :boom: text", "plain 💥 text"), ("`:boom:` and :boom:", "`:boom:` and 💥"), ("``a ` :boom:`` :boom: `", "``a ` :boom:`` 💥 `"), ("````\n```\n:boom:\n```\n````\n:boom:", "````\n```\n:boom:\n```\n````\n💥"),
    ("~~~\n:boom:\n```\n~~~\n:boom:", "~~~\n:boom:\n```\n~~~\n💥"), ("```\nnever closed :boom:", "```\nnever closed :boom:"), ("\\`:boom: `x`", "\\`💥 `x`"), ('<a title=":boom:">:boom:</a>', '<a title=":boom:">💥</a>'),
    ("`<a` :boom: `>`", "`<a` 💥 `>`"), ("a:boom:b x::boom: :unknown: :frame\\_photo:", "a:boom:b x::boom: :unknown: 🖼"), ("", ""), (None, None), (":boom::boom:", ":boom::boom:"), ("é😀 :boom:\n    ```\n:boom:", "é😀 💥\n    ```\n💥"),
    ("   ```js\n:boom:\n   ``` \n:boom:", "   ```js\n:boom:\n   ``` \n💥"),
]


def test_emoji_outside_code_and_tags(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    emoji = spark.createDataFrame([("boom", "💥"), ("frame_photo", "🖼"), ("boom", "💥")], "name string, char string")
    assert [r["text"] for r in mk.with_emoji(texts, "id", "text", emoji).orderBy("id").collect()] == [w for _, w in CASES]


def test_literal_braces(spark):
    cases = [("a {b} `{c}` <T x={1}> \\{d", "a \\{b\\} `{c}` <T x={1}> \\{d"), ("import x\n import y\nexported\nexport z", "&#105;mport x\n import y\nexported\n&#101;xport z"), ("```\nimport {x}\n```", "```\nimport {x}\n```")]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    assert [r["text"] for r in mk.with_literal_braces(texts, "id", "text").orderBy("id").collect()] == [w for _, w in cases]


def test_spans_and_replacement_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["`", "``", "```", "~~~", "\n", "\n", " ", "ab", "é", "😀", "\\", "x{y}", "   "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spans = {}
    for r in mk.code_spans(rows, "id", "text").collect():
        spans.setdefault(r["id"], []).append((r["start"], r["end"]))
    for i, t in enumerate(texts):
        assert sorted(spans.get(i, [])) == mk.code_intervals(t)
        inside = [(a, b) for a, b in spans.get(i, [])]
        for m in re.finditer(r"[{}]|😀", t):
            free = all(m.end() <= a or m.start() >= b for a, b in inside)
            spans.setdefault(("out", i), []).extend([(m.start(), m.end(), m[0])] if free else [])
    found = mk.outside(mk.matches(rows, "id", "text", "[{}]|😀"), mk.code_spans(rows, "id", "text"), "id").collect()
    assert sorted((r["id"], r["start"], r["end"], r["found"]) for r in found) == sorted((i, *m) for i in range(len(texts)) for m in spans.get(("out", i), []))
    blank = {r["id"]: r["text"] for r in mk.masked_code(rows, "id", "text").collect()}
    for i, t in enumerate(texts):
        want = list(t)
        for a, b in mk.code_intervals(t):
            want[a:b] = [c if c == "\n" else " " for c in t[a:b]]
        assert blank[i] == "".join(want)


@pytest.mark.parametrize("text", ["`" * 1_000_000, "` `` " * 200_000, "```\n" * 250_000, "<a " * 300_000 + "{" * 100_000])
def test_very_long_texts(spark, text):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    assert len(mk.masked_code(rows, "id", "text").first()["text"]) == len(text)
    assert len(mk.with_literal_braces(rows, "id", "text").first()["text"]) >= len(text)


def test_names_of_pictures(spark):
    named = {r["name"]: r["char"] for r in mk.unicode_emoji(spark).collect()}
    assert named["rocket"] == "🚀" and named["frame_with_picture"] == "🖼"


def test_code_is_looked_for_once(spark):
    """Places of code are needed for tags, for matches and for what they become, and each time are the same."""
    looked = spark.sparkContext.accumulator(0)
    before = mk.code_intervals

    def counted(text):
        looked.add(1)
        return before(text)

    mk.code_intervals = counted
    try:
        texts = spark.createDataFrame([(i, f"a {{x}} `{{y}}` <T a={{{i}}}> {{") for i in range(40)], "id long, text string")
        got = [r["text"] for r in mk.with_literal_braces(texts, "id", "text").orderBy("id").collect()]
    finally:
        mk.code_intervals = before
    assert got == [f"a \\{{x\\}} `{{y}}` <T a={{{i}}}> \\{{" for i in range(40)]
    assert looked.value == 40


def test_only_texts_with_code_are_masked_in_python(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "plain ~~ text"), (4, "a `b` ü🚧\n~~~\nc\n~~~"), *[(k, f"`{'x' * 300_000}`y{k}") for k in range(5, 15)]]
    spark.createDataFrame(texts, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    got = mk.with_masked_code(spark.read.parquet(str(tmp_path / "texts")), "id", "text", "masked")
    want = {1: None, 2: "", 3: "plain ~~ text", 4: "a     ü🚧\n   \n \n   ", **{k: " " * 300_002 + f"y{k}" for k in range(5, 15)}}
    rows = got.collect()
    assert {r["id"]: r["masked"] for r in rows} == want and {r["id"]: r["text"] for r in rows} == dict(texts)
    steps = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(steps) == 2 and "Contains(text" in steps[1] and "Exchange" not in "".join(steps)
