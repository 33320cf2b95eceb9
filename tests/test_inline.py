import itertools
import random

from foliograph.operators import inline

ROWS = "root int, node string, parent string, ord int, kind string, text string, url string"
T, B, I, L = (lambda x: ("text", x)), (lambda *k: ("bold", *k)), (lambda *k: ("italic", *k)), (lambda u, *k: ("link", u, *k))

#: Content, and what it reads as; the first of each list is the plainest.
CASES = [
    ("**a**b", [B(T("a")), T("b")], [B(T("a")), T(""), T("b")]),
    ("ab c", [T("ab c")], [T("a"), T("b"), T("\n\t c")], [T("ab"), T("&nbsp;"), T("c")]),
    ("a & b", [T("a &amp; b")], [T("a "), T("&#38;"), T(" b")]),
    ("**_x_**", [B(I(T("x")))], [I(B(T("x")))], [I(B(B(T("x"))))], [I(I(B(T("x"))))], [B(I(B(T("x"))))]),
    ("https://a.example/b", [T("https://a.example/b")], [L("https://a.example/b", T("https://a.example/b"))], [L("https://a.example/b", T("https://a."), T("example/b"))]),
    ("a@b.c", [L("mailto:a@b.c", T("a@b.c"))]),
    ("[here](https://a.example)", [L("https://a.example", T("here"))], [L("https://a.example", T("he")), L("https://a.example", T("re"))]),
    ("[x](/a)[y](/b)", [L("/a", T("x")), L("/b", T("y"))]),
    ("**ab**", [B(T("ab"))], [B(T("a")), B(T("b"))], [B(T("a")), B(), B(T("b"))], [B(B(T("a")), T("b"))]),
    ("_a_**b**", [I(T("a")), B(T("b"))]),
    ("_a**b**_", [I(T("a"), B(T("b")))]),
    ("x", [T("x")], [("html", '<a id="here"></a>'), T("x"), L("/y"), B(T(""))], [T("x"), ("html", "<a name='n' />")]),
    ("`a  &amp; b`", [("code", "a  &amp; b")]),
    ("a\nb![p](/i.png)", [T("a"), ("break", None), T("b"), ("image", "p", "/i.png")]),
    ("", [T("")], [B(I(T("")))], []),
]


def rows_of(root, content, parent=None):
    for k, n in enumerate(content):
        node = f"{parent or 'n'}.{k}"
        kind = n[0]
        if kind in ("bold", "italic"):
            yield root, node, parent, k, kind, None, None
            yield from rows_of(root, n[1:], node)
        elif kind == "link":
            yield root, node, parent, k, kind, None, n[1]
            yield from rows_of(root, n[2:], node)
        else:
            yield root, node, parent, k, kind, n[1], n[2] if len(n) > 2 else None


def test_each_rule_and_their_order(spark):
    made = [(want, c) for want, *contents in CASES for c in contents]
    rows = spark.createDataFrame([r for i, (_, c) in enumerate(made) for r in rows_of(i, c)], ROWS)
    orders = [inline.RULES, *random.Random(2).sample(list(itertools.permutations(inline.RULES)), 1)]
    for rules in orders:
        got = {r["root"]: r["said"] for r in inline.as_text(inline.normalised(rows, rules)).collect()}
        for i, (want, c) in enumerate(made):
            assert got.get(i, "") == want, c


def test_marks_nest_to_any_depth(spark):
    deep = T("x")
    for k in range(12):
        deep = I(deep) if k % 2 else B(deep)
    rows = spark.createDataFrame(list(rows_of(1, [deep])), ROWS)
    assert inline.as_text(inline.normalised(rows)).first()["said"] == "**_x_**"
    assert inline.normalised(rows.limit(0)).count() == 0 and inline.as_text(inline.normalised(rows.limit(0))).count() == 0


def test_pieces_are_dealt_once_however_many_rounds(spark, monkeypatch):
    """One written table whatever the nesting; places tell siblings' order, and pieces that a batch cuts in two stay whole."""
    deep = T("x")
    for k in range(9):
        deep = B(deep) if k % 3 else I(deep)
    rows = spark.createDataFrame([r for i in range(40) for r in rows_of(i, [T("a"), deep, T("b"), T("c")])], ROWS)
    calls = []
    keep = inline.written
    monkeypatch.setattr(inline, "written", lambda df, name: calls.append(name) or keep(df, name))
    monkeypatch.setitem(inline.normalised.__globals__, "bounded_batches", lambda df: df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = inline.normalised(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls == ["inline"]
    tops = [(r["root"], r["key"], r["kind"], r["text"]) for r in got.filter("parent = ''").orderBy("root", "key").collect()]
    assert tops == [x for i in range(40) for x in ((i, [0], "text", "a"), (i, [1], "bold", None), (i, [2], "text", "bc"))]
