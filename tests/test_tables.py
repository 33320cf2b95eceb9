import random

from foliograph.operators import tables

CELLS = "page long, t int, row int, cell int, rowspan string, colspan string, is_header boolean, align string, text string"


def brute(rows, most):
    """Every place a cell covers, by a table of places."""
    covering = {}
    for r, cells in enumerate(rows):
        column = 0
        for cell, (down, across) in enumerate(cells):
            while (r, column) in covering:
                column += 1
            down, across = (int(s) if (s or "").isdigit() and int(s) > 1 else 1 for s in (down, across))
            down, across = min(down, len(rows) - r), max(1, min(across, most - column))
            for y in range(down):
                for x in range(across):
                    covering[r + y, column + x] = (r, cell)
            column += across
    return covering


def test_grids_against_a_table_of_places(spark):
    rng = random.Random(4)
    made = {(p, t): [[(rng.choice([None, "1", "2", "3", "9", "0", "x", "-2"]), rng.choice([None, "1", "2", "4", "99", ""])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 7))] for p in range(40) for t in range(3)}
    rows = [(p, t, r, 100 * r + c, down, across, r == 0, None, "x") for (p, t), table in made.items() for r, cells in enumerate(table) for c, (down, across) in enumerate(cells)]
    rng.shuffle(rows)
    got = {}
    for x in tables.grid(spark.createDataFrame(rows, CELLS), ["page", "t"], max_columns=12).collect():
        got.setdefault((x["page"], x["t"]), {})[x["row"], x["col"]] = (x["cell"] // 100, x["cell"] % 100)
    assert got == {k: brute(table, 12) for k, table in made.items()}


def test_headings_alignment_and_long_spans(spark):
    rows = [(1, 0, 0, 0, None, "2", True, " Left ", "a"), (1, 0, 0, 1, None, None, True, "odd", "b"), (1, 0, 0, 2, None, None, True, "right", "c"), (1, 0, 1, 0, None, None, True, None, "d"), (1, 0, 1, 1, None, None, False, None, "e")]
    cells = spark.createDataFrame(rows, CELLS)
    assert sorted((r["col"], r["align"]) for r in tables.alignments(cells, ["page", "t"]).collect()) == [(0, "left"), (1, "left"), (3, "right")]
    assert [r["row"] for r in tables.header_rows(cells, ["page", "t"]).collect()] == [0]
    tall = spark.createDataFrame([(1, 0, k, 0, "65000" if k == 0 else None, None, False, None, "x") for k in range(3000)], CELLS)
    got = tables.grid(tall, ["page", "t"])
    assert got.count() == 5999 and got.filter("col = 1").count() == 2999
    assert tables.grid(tall.limit(0), ["page", "t"]).count() == 0
