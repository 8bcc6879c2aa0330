"""Subtitle, text and table files, one folder per media item where a reader expects one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import srt_time


def srt_entries(numbered: DataFrame) -> DataFrame:
    """SNK1: (media_id, cue_no, entry): number, times, text and a blank line."""
    return numbered.select("media_id", "cue_no", F.concat(F.col("cue_no").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n")).alias("entry"))


def srt_documents(numbered: DataFrame) -> DataFrame:
    """(media_id, srt): a whole SRT file per media item."""
    rows = F.sort_array(F.collect_list(F.struct("cue_no", "entry")))
    return srt_entries(numbered).groupBy("media_id").agg(F.concat(F.array_join(F.transform(rows, lambda x: x["entry"]), "\n"), F.lit("\n")).alias("srt"))


def write_srt(numbered: DataFrame, path: str) -> None:
    """Entries in order, under media_id=.../; each media item is one file."""
    srt_entries(numbered).repartition("media_id").sortWithinPartitions("media_id", "cue_no").select("media_id", "entry").write.partitionBy("media_id").text(path)


def by_start(rows: DataFrame, *ties: str) -> DataFrame:
    """TOP7: rows in one order over all partitions: media item, start, then ties.  A sort for sinks; operators keep to sorts within partitions."""
    return rows.orderBy("media_id", "start_ms", *ties)


def write_tsv(rows: DataFrame, path: str) -> None:
    """SNK2"""
    rows.write.option("sep", "\t").option("header", "true").csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """SNK3, SNK8: one text line per row under media_id=.../"""
    rows.repartition("media_id").sortWithinPartitions("media_id", "seg_idx").select("media_id", column).write.partitionBy("media_id").text(path)


def voice_json(stats: DataFrame, vectors: DataFrame) -> DataFrame:
    """SNK10: one JSON object per voice with its statistics and vector."""
    both = stats.join(vectors, "voice", "full")
    return both.select("voice", F.to_json(F.struct(*both.columns)).alias("json"))
