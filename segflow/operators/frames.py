"""Quality of synthesized audio from its frame energies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 1.01


def log_bin(v: Column) -> Column:
    """The bin of a value in a sketch whose bins are a GAMMA apart: 0 and less in the lowest, NaN (above all others) in the highest."""
    return F.when(F.isnan(v) | (v == float("inf")), F.lit(1 << 30)).when(v > 0, F.floor(F.log(v) / F.log(F.lit(GAMMA))).cast("int")).otherwise(F.lit(-(1 << 30)))


def quantile_sketch(frames: DataFrame, value: str = "rms") -> DataFrame:
    """(media_id, bin, n): numbers of values by logarithmic bin.  Sketches of parts of a media item merge by adding n; a rank's bin tells its value within GAMMA - 1."""
    return frames.filter(F.col(value).isNotNull()).groupBy("media_id", log_bin(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("media_id", "bin").agg(F.sum("n").alias("n"))


def quantile(frames: DataFrame, q: float, sketch: DataFrame | None = None, value: str = "rms") -> DataFrame:
    """(media_id, quantile): each media item's q-quantile with linear interpolation, exactly, null values left out.

    The sketch tells which bins hold the one or two ranks; only the values of those bins are ordered, so no task holds a media item's values.
    """
    counts = quantile_sketch(frames, value) if sketch is None else sketch
    over = Window.partitionBy("media_id")
    upto = counts.withColumn("total", F.sum("n").over(over)).withColumn("below", F.sum("n").over(over.orderBy("bin")) - F.col("n"))
    place = F.lit(float(q)) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)
    wanted = upto.filter((F.col("below") <= high) & (F.col("below") + F.col("n") > low)).select(F.struct("media_id", "bin").alias("of"), "below", place.alias("place"))
    at = F.struct(F.col("media_id"), log_bin(F.col(value)).alias("bin"))
    inside = frames.filter(F.col(value).isNotNull()).select("media_id", F.col(value).cast("double").alias("v"), at.alias("of")).groupBy("media_id", "of", "v").agg(F.count("*").alias("n"))
    # a null media item is one like others
    values = inside.alias("i").join(wanted.alias("w"), F.col("i.of.media_id").eqNullSafe(F.col("w.of.media_id")) & (F.col("i.of.bin") == F.col("w.of.bin"))).select("i.media_id", "i.of", "v", "n", "below", "place")
    last = F.col("below") + F.sum("n").over(Window.partitionBy("of").orderBy("v"))
    ranked = values.withColumn("last", last)
    holds = lambda rank: F.max(F.when((F.col("last") > rank) & (F.col("last") - F.col("n") <= rank), F.col("v")))
    found = ranked.groupBy("media_id", "place").agg(holds(F.floor("place")).alias("lo"), holds(F.ceil("place")).alias("hi"))
    part = F.col("place") - F.floor("place")
    return found.select("media_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - part) * F.col("lo") + part * F.col("hi")).alias("quantile"))


def trailing_silence(frames: DataFrame, limit: float = 0.03, frame_ms: int = 100, least_ms: int = 1000, sketch: DataFrame | None = None) -> DataFrame:
    """AG8: per media of frames (media_id, frame_idx, rms) the share of trailing silence, and why it is invalid (null if valid).

    The reference is the 90th percentile of rms (the maximum if that is 0).  In dB below it, a frame is silent under the threshold
    min + 1 if the range is under 6 dB, else max(-40, min + 0.1 * range).  A sketch kept from before (of all the frames) saves one pass over them.
    """
    by = frames.groupBy("media_id").agg(F.max("rms").alias("peak"), F.min("rms").alias("low"), F.stddev_pop("rms").alias("sd"), F.count("*").alias("n"))
    by = by.join(quantile(frames, 0.9, sketch).withColumnRenamed("quantile", "p90"), "media_id", "left")
    by = by.withColumn("ref", F.when(F.col("p90") > 0, F.col("p90")).otherwise(F.col("peak")))
    db = lambda c: 20 * F.log10(F.greatest(c, F.lit(1e-10)) / F.col("ref"))
    by = by.withColumn("min_db", F.when(F.col("ref") > 0, db(F.col("low")))).withColumn("range_db", F.when(F.col("ref") > 0, db(F.col("peak"))) - F.col("min_db"))
    by = by.withColumn("limit_db", F.when(F.col("range_db") < 6, F.col("min_db") + 1).otherwise(F.greatest(F.lit(-40.0), F.col("min_db") + 0.1 * F.col("range_db"))))
    # the limit as a linear value, so each frame is compared without a logarithm
    loud = frames.join(by.select("media_id", (F.col("ref") * F.pow(F.lit(10.0), F.col("limit_db") / 20)).alias("floor")), "media_id").filter("rms >= floor").groupBy("media_id").agg(F.max("frame_idx").alias("last"))
    first = frames.groupBy("media_id").agg(F.min("frame_idx").alias("first"))
    out = by.join(loud, "media_id", "left").join(first, "media_id")
    tail = F.when(F.col("last").isNull(), F.col("n")).otherwise(F.col("n") - (F.col("last") - F.col("first") + 1))
    out = out.withColumn("silence_ratio", F.round(tail / F.col("n"), 6))
    reason = F.when(F.col("n") * frame_ms < least_ms, "short").when(~(F.col("peak") > 0), "no energy").when(F.col("sd") < 1e-6, "flat").when(F.col("silence_ratio") > limit, "silence")
    return out.select("media_id", "n", "silence_ratio", reason.alias("reason"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """AG9: per segment the first valid attempt, else the one with least silence; the main model (lower rank) wins ties."""
    valid = F.coalesce("valid", F.lit(False))
    key = F.struct((~valid).alias("a"), F.when(valid, 0.0).otherwise(F.coalesce("silence_ratio", F.lit(1.0))).alias("b"), F.col("model_rank").alias("c"), F.col("attempt_no").alias("d"))
    best = attempts.groupBy("media_id", "seg_idx").agg(F.min_by(F.struct("model_rank", "attempt_no", valid.alias("valid"), "silence_ratio"), key).alias("b"))
    return best.select("media_id", "seg_idx", "b.*")
