"""Subtitle cues from segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import full_stop, pack_sentences, sentences


def cues(segments: DataFrame, text: str = "text", max_chars: int = 80) -> DataFrame:
    """WN9: (media_id, seg_idx, part, start_ms, end_ms, text) cues of segments (media_id, seg_idx, start_ms, end_ms, text).

    A single sentence within max_chars keeps its text and slot.  Otherwise each sentence (closed with a full stop) gets a share of the slot
    by its characters, and one longer than max_chars becomes lines of equal time.
    """
    rows = segments.filter(F.col(text).isNotNull()).select("media_id", "seg_idx", "start_ms", "end_ms", F.col(text).alias("_text"), F.explode(F.array(F.transform(sentences(F.col(text)), full_stop))).alias("_s"))
    whole = (F.size("_s") <= 1) & (F.length("_text") <= max_chars)
    # characters before each sentence, then the sentence's lines
    n = F.transform("_s", lambda x: F.length(x))
    sums = F.aggregate(n, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    rows = rows.withColumn("_upto", F.explode(F.array(sums))).withColumn("_s", F.when(whole, F.array("_text")).otherwise(F.col("_s"))).withColumn("_whole", whole)
    one = rows.select("*", F.posexplode("_s").alias("_k", "_sentence")).withColumn("_dur", F.col("end_ms") - F.col("start_ms"))
    total = F.element_at("_upto", -1)
    at = lambda k: F.col("start_ms") + F.floor(F.col("_dur") * F.get("_upto", k) / F.greatest(total, F.lit(1)))
    one = one.withColumn("_from", F.when(F.col("_whole"), F.col("start_ms")).otherwise(at(F.col("_k")))).withColumn("_to", F.when(F.col("_whole"), F.col("end_ms")).otherwise(at(F.col("_k") + 1)))
    lines = F.when(F.length("_sentence") <= max_chars, F.array("_sentence")).otherwise(pack_sentences(F.col("_sentence"), max_chars))
    one = one.withColumn("_lines", lines).select("*", F.posexplode("_lines").alias("_j", "_line"))
    share = lambda j: F.col("_from") + F.floor((F.col("_to") - F.col("_from")) * j / F.size("_lines"))
    part = F.row_number().over(Window.partitionBy("media_id", "seg_idx").orderBy("_k", "_j")) - 1
    return one.select("media_id", "seg_idx", part.alias("part"), share(F.col("_j")).alias("start_ms"), share(F.col("_j") + 1).alias("end_ms"), F.col("_line").alias("text"))


def numbered(cue_rows: DataFrame, *ties: str) -> DataFrame:
    """WN10: cues with cue_no from 1 in start order within their media item; ties says how equal starts order."""
    by = Window.partitionBy("media_id").orderBy("start_ms", *ties)
    return cue_rows.withColumn("cue_no", F.row_number().over(by))
