import pytest
from pyspark.sql import functions as F

from foliograph.operators import reconcile, routing, sidebars
from foliograph.plans import gates


def test_sidebars(spark):
    html = """<p><a href="/no">no</a></p><nav><div><ul><li><a href="/a">A <sup class="badge x">9</sup></a></li><li>Words alone</li><li><strong>Head</strong><ul><li><a href='b'>B</a><ol><li><a href=/c>C &amp; D</a></li></ol></li>
        <li>Deep<ul><li>Deeper<ul><li><a href="#x">x</a></li></ul></li></ul></li></ul></li><li><a href="/e"><img></a></li><li><a href="/f">F</a></ul></div></nav><nav><a href="/second">S</a></nav>"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<nav></nav>"), (4, "<nav><a href='/x'>X</a>")], "page_id int, html string")
    got = sidebars.sidebar_nodes(rows).orderBy("node").collect()
    name = {r["node"]: r["label"] for r in got}
    assert [(r["kind"], r["label"], r["href"], name.get(r["parent"])) for r in got] == [("page", "A", "/a", None), ("group", "Head", None, None), ("group", "B", "b", "Head"), ("page", "C & D", "/c", "B"), ("page", "F", "/f", None)]
    assert sidebars.sidebar_nodes(rows.limit(0)).count() == 0


def test_data_in_scripts(spark):
    html = ["<script type='application/json'>{\"a\": [1, 2]}</script><script type=application/json>no</script><script>var x = {}</script>", 'f.push([1,"0:[\\"x\\",{\\"y\\":"]) f.push([1, "2}]\\n"])', None, ""]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    assert sorted((r["page_id"], r["j"]) for r in sidebars.embedded_json(rows).select("page_id", F.to_json("v").alias("j")).collect()) == [(0, '{"a":[1,2]}'), (1, '["x",{"y":2}]')]


@pytest.mark.parametrize("html", ['f.push([1,"' + "\\n" * 300_000 + '"])', 'f.push([1,"' + "x" * 1_000_000, "<nav>" + "<ul><li>" * 60_000 + "</nav>", "<script type=application/json>" * 30_000])
def test_very_long_pages(spark, html):
    rows = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert sidebars.embedded_json(rows).count() == 0 and sidebars.sidebar_nodes(rows).count() == 0


def test_published_markdown(spark):
    cases = [("> ## Documentation Index\n> x\n\n# T\n\n> d  e\n\nbody\n\n", "d e", (True, "T", "d e", "body\n")), ("# T \n> other\nbody", "d", (False, "T", None, "> other\nbody\n")), ("\n\nplain", None, (False, None, None, "plain\n")), ("", "d", (False, None, None, "\n")), (None, "d", (False, None, None, None)), ("# T", "", (False, "T", None, "\n")), ("> q", "q", (False, None, "q", "\n"))]
    rows = spark.createDataFrame([(i, b, e) for i, (b, e, _) in enumerate(cases)], "id int, b string, e string")
    got = sidebars.unwrapped_markdown(rows, "b", "e").orderBy("id").collect()
    assert [(r["wrapped"], r["title"], r["description"], r["authored"]) for r in got] == [w for _, _, w in cases]


def test_paths_json_and_proofs(spark):
    rows = spark.createDataFrame([(1, ["A b", "", None, "(uncategorised)"], "C d"), (2, None, "x"), (3, [], "Y")], "id int, g array<string>, t string")
    assert [r["p"] for r in rows.select(routing.path_from_tree(F.col("g"), F.col("t")).alias("p"), "id").orderBy("id").collect()] == ["a-b/c-d", "x", "y"]
    json = spark.createDataFrame([('{"b":{"d":[{"z":1,"y":2}],"c":null},"a":1.50}',), ("no",), (None,), ("[]",)], "j string")
    assert [r[0] for r in json.select(reconcile.sorted_json(F.col("j"))).collect()] == ['{"a":1.5,"b":{"c":null,"d":[{"y":2,"z":1}]}}', None, None, "[]"]
    sites = spark.createDataFrame([("a", "url", True), ("b", "url", None), ("c", "archive", True)], "site string, kind string, publishes_markdown boolean")
    assert sorted((r["site"], r["gate"]) for r in gates.inapplicable(sites).collect()) == [("b", "source-content-exact"), ("c", "chrome-absent"), ("c", "html-reconciliation")]
