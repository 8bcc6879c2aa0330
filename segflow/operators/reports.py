"""Reports as rows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ellipsis
from ..functions.timefmt import dotted
from .speakers import first_phrases, longest_turns


def debug_rows(segments: DataFrame, time) -> DataFrame:
    """SNK2: time, original, translation with tabs as spaces; a missing translation is empty."""
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\t"), F.lit(" "))
    return segments.select("media_id", "seg_idx", time.alias("time"), flat("text").alias("original"), flat("translation").alias("translation"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """SNK3: [HH.MM.SS-HH.MM.SS] SPEAKER: text"""
    return segments.select("media_id", "seg_idx", F.concat(F.lit("["), dotted(F.col("start_ms")), F.lit("-"), dotted(F.col("end_ms")), F.lit("] "), "speaker", F.lit(": "), "text").alias("line"))


def caption_lines(segments: DataFrame) -> DataFrame:
    """SNK8: [speaker]: text"""
    return segments.select("media_id", "seg_idx", "start_ms", "end_ms", F.concat(F.lit("["), "speaker", F.lit("]: "), "text").alias("line"))


def chapter_lines(contexts: DataFrame) -> DataFrame:
    """SNK4: of (media_id, info) the lines 'time - title' and the summary; a leading 00: hour is dropped."""
    rows = contexts.select("media_id", F.posexplode("info.chapters").alias("chapter", "c"))
    time = F.when(F.col("c.start_time").startswith("00:"), F.substring("c.start_time", 4, 100)).otherwise(F.col("c.start_time"))
    return rows.select("media_id", "chapter", F.concat(time, F.lit(" - "), F.col("c.title")).alias("line"), F.col("c.summary").alias("summary"))


def speaker_report(segments: DataFrame, n: int = 3, chars: int = 100) -> DataFrame:
    """SNK5: per speaker its first n phrases, cut to chars characters, one per line."""
    rows = first_phrases(segments, n).select("media_id", "speaker", "rank", ellipsis(F.col("text"), chars).alias("t"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy("media_id", "speaker").agg(lines.alias("phrases"))


def translated_samples(segments: DataFrame, n: int = 3, least_ms: int = 1000) -> DataFrame:
    """SNK6: per speaker up to n longest segments with both texts and the duration."""
    top = longest_turns(segments, n=n, least_ms=least_ms, order="seg_idx")
    return top.select("media_id", "speaker", "rank", "seg_idx", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), "text", "translation")


def stage_report(metrics: DataFrame, durations: DataFrame) -> DataFrame:
    """AG10: per media and step seconds, minutes and percent of the total, with the ratio of processing to media time.

    A total or duration of 0 or null gives null ratios; a last row 'other' holds total minus the listed steps, if a step 'total' is there.
    """
    steps = metrics.groupBy("media_id", "step").agg(F.round(F.sum("seconds"), 6).alias("seconds"))
    total = steps.groupBy("media_id").agg(F.max(F.when(F.col("step") == "total", F.col("seconds"))).alias("_t"), F.sum(F.when(F.col("step") != "total", F.col("seconds")).otherwise(0)).alias("_sum"))
    total = total.withColumn("total_s", F.coalesce("_t", "_sum"))
    rest = total.filter("_t IS NOT NULL").select("media_id", F.lit("other").alias("step"), F.round(F.greatest(F.lit(0.0), F.col("_t") - F.col("_sum")), 6).alias("seconds"))
    out = steps.filter("step <> 'total'").unionByName(rest).join(total.select("media_id", "total_s"), "media_id").join(durations, "media_id", "left")
    over = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    media_s = F.col("duration_ms") / 1000.0
    return out.select("media_id", "step", "seconds", F.round(F.col("seconds") / 60, 6).alias("minutes"), over(F.col("seconds") * 100, F.col("total_s")).alias("percent"), over(F.col("total_s"), media_s).alias("ratio"), over(media_s, F.col("total_s")).alias("speed"))


def by_system(rows: DataFrame) -> DataFrame:
    """AG3: segments per text-to-speech system."""
    return rows.groupBy("tts_system").agg(F.count("*").alias("n"), F.count_distinct("media_id").alias("n_media"))


def file_numbers(files: DataFrame) -> DataFrame:
    """Cues of several files of one media item numbered together in start order."""
    return files.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "file", "index")))
