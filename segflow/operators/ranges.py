"""Intervals that overlap, by places in order instead of by buckets of time.

Starts are numbered in order by a segmented scan that the intervals' ends pass too, so an interval learns the places of the first and last start within it.  Places
are cut into cells of equal depth; a start is in one cell, an interval in those it reaches into.  However dense the intervals lie, one is compared with at most two
cells more starts than lie within it, and a long media item is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CELL_MS, scan

#: Starts in a cell: each is compared with the spans that reach its cell, and a long span is copied to each cell it reaches.
DEPTH = 64


def in_cells(rows: DataFrame, sides: int, depth: int, cell_ms: int) -> tuple[DataFrame, DataFrame]:
    """The starts (media_id, of, point, place, cell) and the spans (media_id, of, span, past, last, cell) that reach past one place up to another, once per cell.

    of is the side of the starts, which is the span's other side if there are two.

    rows (media_id, side, s, e, x) with s < e.  In a time, ends sort before starts, and starts of side 0 before those of side 1; with one side, starts of one time
    go by x, and a span meets only what comes after it.
    """
    ends = F.explode(F.array(F.struct(F.col("s").alias("t"), (F.col("side") + 1).alias("kind")), F.struct(F.col("e").alias("t"), F.lit(0).alias("kind")))).alias("p")
    events = rows.filter("s < e AND media_id IS NOT NULL").select("media_id", "side", "s", "e", "x", ends).select("media_id", "side", "s", "e", "x", "p.*")
    counts = {f"place{k}": (F.col("kind") == k + 1).cast("int") for k in range(sides)}
    placed = scan(events, ["media_id"], ["t", "kind", "x"], cell_ms, sums=counts)
    mine, theirs = (F.when(F.col("side") == 0, F.col("place0")).otherwise(F.col("place1")), F.when(F.col("side") == 0, F.col("place1")).otherwise(F.col("place0"))) if sides == 2 else (F.col("place0"), F.col("place0"))
    start = F.col("kind") > 0
    found = placed.groupBy("media_id", "side", "s", "e", "x").agg(F.max(F.when(start, mine)).alias("place"), F.max(F.when(start, theirs)).alias("past"), F.max(F.when(~start, theirs)).alias("last"), F.count_if(start).alias("n"))
    # true of every row; both sides of the join then need all of these, so that one exchange serves both
    found = found.filter("place IS NOT NULL AND past IS NOT NULL AND last IS NOT NULL AND n > 0")
    side, other = (F.col("side"), (F.col("side") + 1) % sides) if sides == 2 else (F.lit(0), F.lit(0))
    there = found.select("media_id", side.alias("of"), F.col("x").alias("point"), "place", F.col("n").alias("n_points"), F.floor(F.col("place") / depth).alias("cell"))
    cells = F.sequence(F.floor((F.col("past") + 1) / depth), F.floor(F.col("last") / depth))
    reach = found.filter("past < last").select("media_id", other.alias("of"), F.col("x").alias("span"), "past", "last", "n", F.explode(cells).alias("cell"))
    return there, reach


def met(rows: DataFrame, sides: int, depth: int, cell_ms: int) -> DataFrame:
    """(media_id, of, span, point, n): each span with each point that starts in it, n times."""
    there, reach = in_cells(rows, sides, depth, cell_ms)
    pairs = there.join(reach, ["media_id", "of", "cell"]).filter("place > past AND place <= last")
    return pairs.select("media_id", "of", "span", "point", (F.col("n") * F.col("n_points")).alias("n"))


def repeated(pairs: DataFrame) -> DataFrame:
    return pairs.select("media_id", "a", "b", F.explode(F.when(F.col("n") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "n"))).alias("_")).drop("_")


def started_within(rows: DataFrame, depth: int = DEPTH, cell_ms: int = CELL_MS) -> DataFrame:
    """(media_id, a, b): every two of rows (media_id, s, e, x) of which b starts in [s, e) of a, and not before a; starts of one time go by x.

    Repeated rows pair as often as they are there, but not with each other.  Rows with a null time or media item, or s >= e, are in no pair.
    """
    found = met(rows.select("media_id", F.lit(0).alias("side"), "s", "e", "x"), 1, depth, cell_ms)
    return repeated(found.select("media_id", F.col("span").alias("a"), F.col("point").alias("b"), "n"))


def overlapping(left: DataFrame, right: DataFrame, depth: int = DEPTH, cell_ms: int = CELL_MS) -> DataFrame:
    """(media_id, a, b): every a of left and b of right, both (media_id, s, e, x) with structs x of one type, that share more than an end.

    Repeated rows pair as often as they are there.  Rows with a null time or media item, or s >= e, are in no pair.
    """
    side = lambda df, k: df.select("media_id", F.lit(k).alias("side"), "s", "e", "x")
    found = met(side(right, 0).unionByName(side(left, 1)), 2, depth, cell_ms)
    of_right = F.col("of") == 0
    return repeated(found.select("media_id", F.when(of_right, F.col("span")).otherwise(F.col("point")).alias("a"), F.when(of_right, F.col("point")).otherwise(F.col("span")).alias("b"), "n"))


def last_point(points: DataFrame, spans: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """Each span (media_id, hi, span) with the time of the last point (media_id, t) at or before hi as last_t: an as-of look-up in one scan, no pairs."""
    at = points.filter("t IS NOT NULL").select("media_id", "t", F.lit(0).alias("kind"))
    asked = spans.select("media_id", F.col("hi").alias("t"), F.lit(1).alias("kind"), "span")
    seen = scan(at.unionByName(asked, allowMissingColumns=True), ["media_id"], ["t", "kind"], cell_ms, lasts={"last_t": F.when(F.col("kind") == 0, F.col("t"))})
    return seen.filter("kind = 1").select("media_id", "span", "last_t")
