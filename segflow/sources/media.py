"""Keyframes, silences, probes, voices and parameters from the text that tools print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import parse_range, seconds_to_ms

PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,bit_rate:string,sample_rate:string>>,format:struct<duration:string,bit_rate:string>>"
STATS = "struct<voice_stats:map<string,struct<words_per_minute:double,characters_per_second:double,total_samples:bigint>>,embeddings:map<string,array<double>>>"


def keyframes(lines: DataFrame) -> DataFrame:
    """SRC7: (media_id, ts_ms) of 'seconds,flag' lines with flag 1; unparsable lines drop out."""
    parts = F.split(F.trim("line"), ",")
    ts, flag = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return lines.select("media_id", F.when(ts.rlike(r"^\d{1,12}(\.\d+)?$"), (ts.cast("decimal(20,3)") * 1000).cast("long")).alias("ts_ms"), flag.alias("flag")).filter("flag = '1' AND ts_ms IS NOT NULL").select("media_id", "ts_ms")


def silences(logs: DataFrame) -> DataFrame:
    """SRC8: intervals of (media_id, log, duration_ms): starts and ends pair by position, a missing end is the media's end; end <= start drops out."""
    found = lambda k: F.transform(F.regexp_extract_all("log", F.lit(k + r":\s*(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: (x.cast("decimal(20,3)") * 1000).cast("long"))
    pairs = logs.select("media_id", "duration_ms", F.posexplode(F.arrays_zip(found("silence_start").alias("s"), found("silence_end").alias("e"))).alias("i", "p"))
    return pairs.filter("p.s IS NOT NULL").select("media_id", F.col("p.s").alias("start_ms"), F.coalesce("p.e", "duration_ms").alias("end_ms")).filter("end_ms > start_ms")


def probe_info(rows: DataFrame) -> DataFrame:
    """SRC9: one row per media of (media_id, probe JSON): duration, first video and first audio stream, bit rates; null where absent."""
    p = F.from_json("probe", PROBE)
    rows = rows.select("media_id", p.alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = rows.select("media_id", F.col("p.format.duration").alias("d"), F.col("p.format.bit_rate").alias("b"), first("video").alias("v"), first("audio").alias("a"))
    return rows.select("media_id", seconds_to_ms(F.col("d").cast("decimal(20,3)")).alias("duration_ms"), F.col("b").cast("long").alias("bit_rate"), "v.width", "v.height", F.col("v.codec_name").alias("video_codec"), F.col("a.codec_name").alias("audio_codec"), F.col("a.sample_rate").cast("int").alias("sample_rate"))


def voice_vectors(rows: DataFrame) -> DataFrame:
    """SRC5: (voice, embedding) of JSON maps; vectors of another size than the most frequent are left out (VAL4)."""
    v = rows.select(F.explode(F.from_json("json", "map<string,array<double>>")).alias("voice", "embedding"))
    size = v.groupBy(F.size("embedding").alias("dim")).count().agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))
    return v.withColumn("dim", F.size("embedding")).join(size, "dim").select("voice", "embedding")


def voice_database(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC6: (statistics, vectors) of JSON objects with voice_stats and embeddings."""
    s = rows.select(F.from_json("json", STATS).alias("j"))
    stats = s.select(F.explode("j.voice_stats").alias("voice", "x")).select("voice", "x.*")
    return stats, s.select(F.explode("j.embeddings").alias("voice", "embedding"))


def ranges(rows: DataFrame) -> DataFrame:
    """SRC10: intervals of (media_id, ranges) with comma-separated 'a-b' ranges; bad ones and start >= end drop out."""
    r = rows.select("media_id", F.posexplode(F.split("ranges", ",")).alias("i", "r")).select("media_id", "i", parse_range(F.col("r")).alias("x"))
    return r.filter("x IS NOT NULL").select("media_id", "i", "x.start_ms", "x.end_ms")


def mapping(text: Column) -> Column:
    """SC13: 'a:v,b:w' or a JSON object as a map; null if neither."""
    bare = F.trim(text)
    listed = F.str_to_map(F.regexp_replace(bare, r"\s*([,:])\s*", "$1"), F.lit(","), F.lit(":"))
    return F.when(bare.startswith("{"), F.from_json(bare, "map<string,string>")).when(bare.rlike(r"^[^,:]+:[^,:]+(,[^,:]+:[^,:]+)*$"), listed)
