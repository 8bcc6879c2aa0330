"""Running values over ordered rows, with one long group spread over many tasks.

Rows go in cells by a whole number of their order (a time or an index): each cell is a window of its own, a summary of each cell (its sum, last value and last
row) is carried over the group's cells, one row a cell, and the carry goes into the next cell's window as its first row, so rows move once and nothing is joined
back.  Groups of one cell pay nothing but the summary.  A cell holds all rows of its stretch: rows of one single instant stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_MS = 600_000
CELL_ROWS = 4096


def scan(rows: DataFrame, keys: list[str], order: list[str], width: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """rows with running values over the rows of equal keys (null is a key like others) in ascending order, nulls first, of the columns order.

    The first of order is the whole number that is cut into cells of width.  sums: the sum up to the row, peers of equal order included.  lasts: the last value
    that isn't null, up to the row and its peers.  previous: the value of the row before (null for the first); rows of equal order should not differ in it.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    cell = "_cell"
    values = {f"_sum_{n}": c for n, c in sums.items()} | {f"_last_{n}": c for n, c in lasts.items()}
    if previous:
        values["_row"] = F.struct(F.lit(True).alias("_any"), *[c.alias(n) for n, c in previous.items()])
    base = rows.withColumn(cell, F.floor(F.col(order[0]) / width)).withColumns(values)
    over, place = Window.partitionBy(*keys).orderBy(cell), F.struct(*order)
    before = over.rowsBetween(Window.unboundedPreceding, -1)

    summary = [F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums] + [F.max_by(f"_last_{n}", F.when(F.col(f"_last_{n}").isNotNull(), place)).alias(f"_last_{n}") for n in lasts]
    carried = [F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums] + [F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in lasts]
    if previous:
        summary, carried = [*summary, F.max_by("_row", place).alias("_row")], [*carried, F.lag("_row").over(over).alias("_row")]
    carry = base.groupBy(*keys, cell).agg(*summary).select(*keys, cell, F.row_number().over(over).alias("_nth"), *carried).filter("_nth > 1")
    there = {*keys, cell, *values}
    carry = carry.select(*[F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema], F.lit(False).alias("_is_row"))

    # the carry is first in its cell: a null adds nothing, a row after it hides it
    one = Window.partitionBy(*keys, cell).orderBy("_is_row", *order)
    out = {n: F.sum(f"_sum_{n}").over(one) for n in sums} | {n: F.last(f"_last_{n}", ignorenulls=True).over(one) for n in lasts}
    # rows that lie by key already are dealt anew too, and the carry apart from them: else a long item stays one task's work, and one task sorts or writes the rows
    # while the carry is still to be sorted, which then finds no memory
    dealt = base.withColumn("_is_row", F.lit(True)).unionByName(carry.repartition(*keys, cell)).repartition(*keys, cell)
    seen = dealt.select("*", *[c.alias(f"_out_{n}") for n, c in out.items()], *[F.lag("_row").over(one).alias("_before")] * bool(previous)).filter("_is_row")
    out = {n: F.col(f"_out_{n}") for n in out} | {n: F.col("_before").getField(n) for n in previous}
    return seen.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])
