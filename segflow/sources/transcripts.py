"""Segments, turns and cues from recogniser results and subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.timefmt import parse_srt_time

WORD = "struct<text:string,speaker:string,start:bigint,end:bigint>"
ASR = f"utterances array<struct<speaker:string,text:string,start:bigint,end:bigint>>, sentences array<struct<text:string,start:bigint,end:bigint>>, words array<{WORD}>, text string, audio_duration bigint"


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser results, one JSON object with media_id per line."""
    return spark.read.schema("media_id bigint, " + ASR).json(path)


def asr_segments(results: DataFrame) -> DataFrame:
    """SRC1: segments from utterances, else sentences (speaker SPEAKER_00), else the whole text; blank ones and start >= end drop out."""
    row = lambda speaker, x: F.struct(speaker.alias("speaker"), strip(F.coalesce(x["text"], F.lit(""))).alias("text"), x["start"].alias("start_ms"), x["end"].alias("end_ms"))
    zero = F.lit("SPEAKER_00")
    uttered = F.transform("utterances", lambda u: row(F.concat(F.lit("SPEAKER_"), F.coalesce(u["speaker"], F.lit("00"))), u))
    spoken = F.transform("sentences", lambda s: row(zero, s))
    whole = F.array(F.struct(zero.alias("speaker"), strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(0).cast("long").alias("start_ms"), F.col("audio_duration").alias("end_ms")))
    picked = F.when(F.size("utterances") > 0, uttered).when(F.size("sentences") > 0, spoken).otherwise(whole)
    rows = results.select("media_id", F.posexplode(picked).alias("pos", "s")).select("media_id", "pos", "s.*").filter("text <> '' AND start_ms < end_ms")
    by = Window.partitionBy("media_id").orderBy("start_ms", "pos")
    return rows.select("media_id", (F.row_number().over(by) - 1).alias("seg_idx"), "speaker", "text", "start_ms", "end_ms")


def asr_rolls(results: DataFrame) -> DataFrame:
    """SRC2: turns from utterances; without them, runs of words of one speaker (null: SPEAKER_00)."""
    named = lambda s: F.concat(F.lit("SPEAKER_"), F.coalesce(s, F.lit("00")))
    uttered = results.filter(F.size("utterances") > 0).select("media_id", F.posexplode("utterances").alias("i", "u")).select("media_id", F.col("u.start").alias("start_ms"), F.col("u.end").alias("end_ms"), named(F.col("u.speaker")).alias("speaker"))
    words = results.filter(F.coalesce(F.size("utterances"), F.lit(0)) <= 0).select("media_id", F.posexplode("words").alias("i", "w")).select("media_id", "i", F.col("w.start").alias("s"), F.col("w.end").alias("e"), named(F.col("w.speaker")).alias("speaker"))
    by = Window.partitionBy("media_id").orderBy("i")
    runs = words.withColumn("g", F.sum(F.coalesce((F.lag("speaker").over(by) != F.col("speaker")).cast("int"), F.lit(1))).over(by))
    spoken = runs.groupBy("media_id", "g").agg(F.min_by("s", "i").alias("start_ms"), F.max_by("e", "i").alias("end_ms"), F.first("speaker").alias("speaker")).drop("g")
    return uttered.unionByName(spoken)


def loose_segments(rows: DataFrame) -> DataFrame:
    """SRC3: segments of a recogniser that may leave out speaker or times; start >= end and blank texts drop out."""
    full = rows.select("media_id", F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN")).alias("speaker"), strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("start_ms", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", F.lit(0)).alias("end_ms"))
    return valid_segments(full)


def valid_segments(rows: DataFrame) -> DataFrame:
    """FL4: text not blank and start < end."""
    return rows.filter((F.trim("text") != "") & (F.col("start_ms") < F.col("end_ms")))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of SRT files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def srt_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC4: (cues, rejects) of (file, content): entries between blank lines with an index, a time line and text lines."""
    entries = files.select("file", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n+")).alias("pos", "entry"))
    entries = entries.select("file", "pos", F.regexp_replace("entry", r"^\n+|\n+$", "").alias("entry")).filter("trim(entry) <> ''")
    lines = entries.withColumn("l", F.split("entry", "\n"))
    sides = F.split(F.get("l", F.lit(1)), r"\s*-->\s*")
    index = F.when(F.trim(F.get("l", F.lit(0))).rlike(r"^\d{1,9}$"), F.trim(F.get("l", F.lit(0))).cast("int"))
    parsed = lines.select("file", "pos", "entry", index.alias("index"), parse_srt_time(F.get(sides, F.lit(0))).alias("start_ms"), parse_srt_time(F.get(sides, F.lit(1))).alias("end_ms"), F.array_join(F.slice("l", 3, F.greatest(F.lit(0), F.size("l") - 2)), "\n").alias("text"))
    good = F.col("index").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    return parsed.filter(good).drop("entry", "pos"), parsed.filter(~good).select("file", "pos", "entry")
