"""Laying synthesized speech out on the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CELL_MS, scan

RATIO = (0.5, 1.15)


def place_in_groups(rows: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """WN4: rows (media_id, speaker, grp, seg_idx, start_ms, end_ms, spoken_ms) with their place inside the group.

    Pieces follow each other with the positive pauses of the original between them; without speech (null) the slot's length stands in.
    """
    group, order = ["media_id", "speaker", "grp"], ["start_ms", "seg_idx"]
    pause = F.greatest(F.lit(0), F.coalesce(F.col("start_ms") - F.col("_end"), F.lit(0)))
    spoken = F.coalesce("spoken_ms", F.col("end_ms") - F.col("start_ms"))
    after = scan(rows, group, order, cell_ms, previous={"_end": F.col("end_ms")})
    put = after.withColumn("len_ms", spoken).withColumn("pause_ms", pause).drop("_end")
    put = scan(put, group, order, cell_ms, sums={"in_end_ms": F.col("len_ms") + F.col("pause_ms")})
    return put.withColumn("in_start_ms", F.col("in_end_ms") - F.col("len_ms"))


def real_positions(placed: DataFrame, overflow: float = 1.0, low: float = RATIO[0], high: float = RATIO[1]) -> DataFrame:
    """WN5: final start and end of every piece.

    A group's ratio is target / actual, clamped to [low, high]; positions scale with it; the group's length changes only if the ratio is off
    by more than 1 %, and of what exceeds the target the share overflow is kept.  Order by new_start_ms for the timeline.
    """
    g = ["media_id", "speaker", "grp"]
    sums = placed.groupBy(*g).agg(F.min("start_ms").alias("g_start"), (F.max_by("end_ms", F.struct("start_ms", "seg_idx")) - F.min("start_ms")).alias("target"), F.max("in_end_ms").alias("actual"))
    ratio = F.when(F.col("actual") > 0, F.greatest(F.lit(low), F.least(F.lit(high), F.col("target") / F.col("actual")))).otherwise(F.lit(1.0))
    sums = sums.withColumn("ratio", F.round(ratio, 9))
    length = F.when(F.abs(F.col("ratio") - 1) > 0.01, F.col("actual") * F.col("ratio")).otherwise(F.col("actual").cast("double"))
    sums = sums.withColumn("len", F.least(length, F.when(length > F.col("target"), F.col("target") + F.floor((length - F.col("target")) * max(0.0, min(1.0, overflow)))).otherwise(length)))
    out = placed.join(sums, g)
    scaled = lambda c: F.round(F.col("g_start") + F.least(F.col(c) * F.col("ratio"), F.col("len")), 3)
    return out.select("media_id", "speaker", "grp", "seg_idx", "start_ms", "end_ms", F.round("ratio", 6).alias("ratio"), scaled("in_start_ms").alias("new_start_ms"), scaled("in_end_ms").alias("new_end_ms"))


def merge_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """AG11: per media rows before and after, and the reduction in percent."""
    a, b = before.groupBy("media_id").agg(F.count("*").alias("n_before")), after.groupBy("media_id").agg(F.count("*").alias("n_after"))
    return a.join(b, "media_id", "left").select("media_id", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"), F.round((F.col("n_before") - F.coalesce("n_after", F.lit(0))) * 100.0 / F.col("n_before"), 6).alias("reduction"))


def media_extent(segments: DataFrame, pad_ms: int = 1000) -> DataFrame:
    """AG12: padded end and sorted speakers of each media item."""
    return segments.groupBy("media_id").agg((F.max("end_ms") + pad_ms).alias("duration_ms"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))
