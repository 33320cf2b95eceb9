"""Tables with spanning cells as plain grids."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import bounded_batches, shuffle_partitions

MAX_COLUMNS = 1000


class Grid:
    """One table, row by row: which cell covers which column. Of what earlier rows reserve only a stack for each column is kept: the
    latest cell on top, until its last row."""

    def __init__(self, n_rows: int, max_columns: int):
        self.n_rows, self.max_columns, self.reserved = n_rows, max_columns, {}

    def row(self, number: int, cells: list[tuple[int, int, int]]) -> dict[int, int]:
        """column to cell, for cells (cell, rowspan, colspan) in order."""
        here = {}
        for column, stack in list(self.reserved.items()):
            while stack and stack[-1][0] <= number:
                stack.pop()
            if stack:
                here[column] = stack[-1][1]
            else:
                del self.reserved[column]
        column = 0
        for cell, down, across in cells:
            while column in here:
                column += 1
            down, across = (max(1, min(span or 1, most)) for span, most in ((down, self.n_rows - number), (across, self.max_columns - column)))
            for c in range(column, column + across):
                here[c] = cell
                if down > 1:
                    self.reserved.setdefault(c, []).append((number + down, cell))
            column += across
        return here


def _rows(batches) -> Iterator[tuple[tuple, int, int, list[tuple[int, int, int]]]]:
    """table, rows it has, row, its cells, in order."""
    held, cells = None, []
    for batch in batches:
        for *table, n_rows, row, cell, down, across in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (tuple(table), n_rows, row)
            if now != held:
                if held:
                    yield *held, cells
                held, cells = now, []
            cells.append((cell, down, across))
    if held:
        yield *held, cells


def grid(cells: DataFrame, table: list[str], max_columns: int = MAX_COLUMNS) -> DataFrame:
    """table columns, row, col, cell: which cell of cells (table columns, row, cell, rowspan, colspan) covers which place.

    A cell takes the next free column of its row, and the columns and rows it spans; spans that are missing, no number or below one
    count as one, rows end with the table's last row, columns with max_columns. Where spans overlap the later cell shows. Places that
    nothing covers have no row here. Rows of a table come in order, and only what they reserve is kept, whatever a table's length."""
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in table)

    def run(batches):
        import pyarrow as pa

        types = None
        held: Grid | None = None
        last = None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*table, "row", "col", "cell"])

        def seen():
            nonlocal types
            for batch in batches:
                types = [*(batch.schema.types[: len(table)]), pa.int32(), pa.int32(), pa.int32()]
                yield batch

        made = []
        for name, n_rows, row, of in _rows(seen()):
            if name != last:
                held, last = Grid(n_rows, max_columns), name
            made += [(*name, row, column, cell) for column, cell in sorted(held.row(row, of).items())]
            if len(made) > 50_000:
                yield out(made)
                made = []
        if made:
            yield out(made)

    # rows without cells of their own still show what is reserved for them
    n = cells.groupBy(*table).agg((F.max("row") + 1).cast("int").alias("__n"))
    number = lambda c: F.col(c).try_cast("int")
    c = cells.join(n, table).select(*table, "__n", F.col("row").cast("int").alias("row"), F.col("cell").cast("int").alias("cell"), number("rowspan").alias("rowspan"), number("colspan").alias("colspan"))
    c = c.repartition(shuffle_partitions(cells.sparkSession), *table).sortWithinPartitions(*table, "row", "cell")
    return bounded_batches(c).mapInArrow(run, f"{kinds}, row int, col int, cell int")


def header_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """table columns, row: rows all of whose cells are headings (is_header)."""
    return cells.groupBy(*table, "row").agg(F.bool_and(F.coalesce("is_header", F.lit(False))).alias("all")).filter("all").select(*table, "row")


def alignments(cells: DataFrame, table: list[str]) -> DataFrame:
    """table columns, col, align: what the first row's cells state (left, center or right), for every column they span."""
    first = cells.filter("row = 0").select(*table, "cell", F.greatest(F.lit(1), F.least(F.coalesce(F.col("colspan").try_cast("int"), F.lit(1)), F.lit(MAX_COLUMNS))).alias("span"), F.lower(F.trim("align")).alias("align"))
    upto = F.sum("span").over(Window.partitionBy(*table).orderBy("cell"))
    placed = first.withColumn("from", upto - F.col("span")).select(*table, "align", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("span") - 1)).alias("col"))
    return placed.filter(F.col("align").isin("left", "center", "right")).select(*table, F.col("col").cast("int").alias("col"), "align")
