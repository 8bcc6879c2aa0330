"""Choosing the text variant that fits a time slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMFORT = (0.75, 1.15)


def deviation(ratio: Column, low: float = COMFORT[0], high: float = COMFORT[1]) -> Column:
    """SC6: 0 inside [low, high]; below, the share by which it is too small; above, minus the share by which it is too large."""
    return F.when(ratio < low, (low - ratio) / low).when(ratio > high, -(ratio - high) / high).otherwise(F.lit(0.0))


def target_chars(text: Column, slot_ms: Column, spoken_ms: Column) -> Column:
    """SC10: characters that would fill the slot, from slot / spoken clamped to [0.2, 2]."""
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.2), slot_ms / spoken_ms))
    return F.when(spoken_ms > 0, F.greatest(F.lit(1), F.floor(F.length(text) * factor)).cast("long"))


def select_variant(rows: DataFrame, estimate, prefer_shorter: bool = True, low: float = COMFORT[0], high: float = COMFORT[1]) -> DataFrame:
    """TOP4: adds track, chosen_text and deviation to rows (start_ms, end_ms, translation, very_short_, short_ and long_translation).

    The translation stays if its estimate(text) fits; if it is too long the shorter variants compete with it, if too short the longer one.
    The smallest absolute deviation wins, on ties a negative one if prefer_shorter, then the earlier variant.  Without an estimate the
    translation stays.
    """
    slot = (F.col("end_ms") - F.col("start_ms")).cast("double")
    names = ("translation", "very_short_translation", "short_translation", "long_translation")
    ratio = lambda c: F.when(estimate(F.col(c)) > 0, slot / estimate(F.col(c)))
    rated = rows.select("*", *[F.round(ratio(c), 9).alias(f"_r{k}") for k, c in enumerate(names)])

    def candidate(k: int, when: Column) -> Column:
        d = deviation(F.col(f"_r{k}"), low, high)
        key = F.struct(F.abs(d).alias("a"), F.when(F.lit(prefer_shorter) & (d < 0), 0).otherwise(1).alias("b"), F.lit(k).alias("k"), d.alias("d"))
        return F.when(when & F.col(f"_r{k}").isNotNull() & F.col(names[k]).isNotNull(), key)

    normal = F.col("_r0")
    best = F.array_min(F.filter(F.array(candidate(0, F.lit(True)), candidate(1, normal < low), candidate(2, normal < low), candidate(3, normal > high)), lambda x: x.isNotNull()))
    out = rated.withColumn("_best", best).withColumn("_k", F.coalesce("_best.k", F.lit(0)))
    text = F.element_at(F.array(*names), F.col("_k") + 1)
    return out.select(*rows.columns, F.element_at(F.array(*map(F.lit, names)), F.col("_k") + 1).alias("track"), text.alias("chosen_text"), F.round("_best.d", 6).alias("deviation"))


def reselect(attempts: DataFrame, prefer_shorter: bool = True, low: float = COMFORT[0], high: float = COMFORT[1]) -> DataFrame:
    """TOP6: per segment the best measured attempt (media_id, seg_idx, ord, track, text, slot_ms, spoken_ms).

    A text already tried counts once (lowest ord), failed attempts (0 ms) are skipped, and a later one must be strictly better: a smaller
    absolute deviation, on ties a negative one if prefer_shorter (when pauses are removed).
    """
    tried = attempts.filter("spoken_ms > 0").groupBy("media_id", "seg_idx", "text").agg(F.min_by(F.struct("ord", "track", "slot_ms", "spoken_ms"), "ord").alias("t"))
    d = deviation(F.round(F.col("t.slot_ms") / F.col("t.spoken_ms"), 9), low, high)
    key = F.struct(F.abs(d).alias("a"), F.when(F.lit(prefer_shorter) & (d < 0), 0).otherwise(1).alias("b"), F.col("t.ord").alias("o"))
    best = tried.groupBy("media_id", "seg_idx").agg(F.min_by(F.struct(F.col("t.track").alias("track"), "text", d.alias("d")), key).alias("b"))
    return best.select("media_id", "seg_idx", "b.track", "b.text", F.round("b.d", 6).alias("deviation"), (F.abs("b.d") > 0.15).alias("needs_adjusting"))


def track_usage(chosen: DataFrame) -> DataFrame:
    """AG4: rows and share per track."""
    n = chosen.groupBy("track").agg(F.count("*").alias("n"))
    return n.select("track", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))
