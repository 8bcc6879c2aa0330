"""Representative inputs derived from the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences


class Inputs:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def segments(self) -> DataFrame:
        """the sentences of every conversation as timed segments."""
        t = self.table("conversations").select(F.col("conv_id").alias("media_id"), "turn", F.concat(F.lit("S_"), "role").alias("speaker"), F.posexplode(sentences(F.col("text"))).alias("p", "text"))
        by = Window.partitionBy("media_id").orderBy("turn", "p")
        t = t.withColumn("seg_idx", (F.row_number().over(by) - 1).cast("int"))
        gap = ((F.col("media_id") * 31 + F.col("seg_idx") * 17) % 9) * 150 + F.when(F.col("seg_idx") % 23 == 22, 3500).otherwise(0)
        t = t.withColumn("gap_ms", gap.cast("long"))
        t = t.withColumn("end_ms", F.sum(60 * F.length("text") + F.col("gap_ms")).over(Window.partitionBy("media_id").orderBy("seg_idx")))
        return t.select("media_id", "seg_idx", "speaker", "text", "gap_ms", (F.col("end_ms") - 60 * F.length("text")).alias("start_ms"), "end_ms")

    def words(self) -> DataFrame:
        """segments with their words; word k of n gets the k-th n-th of the time."""
        w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
        d = F.col("end_ms") - F.col("start_ms")
        at = lambda k: F.col("start_ms") + F.floor(k * d / F.size("_w"))
        rows = self.segments().withColumn("_w", F.explode(F.array(w)))
        return rows.withColumn("words", F.transform("_w", lambda x, k: F.struct(x.alias("word"), at(k).alias("start_ms"), at(k + 1).alias("end_ms"), F.lit(1.0).alias("confidence")))).drop("_w", "gap_ms")

    def rolls(self) -> DataFrame:
        """overlapping turns."""
        ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") - 1_704_067_200_000
        e = self.table("events").select(F.floor(F.col("event_id") / 200).alias("media_id"), F.col("event_id").alias("roll_idx"), ms.alias("start_ms"), "value", "user_id")
        return e.select("media_id", "roll_idx", "start_ms", (F.col("start_ms") + F.round(F.col("value") * 10000).cast("long")).alias("end_ms"), F.concat(F.lit("S_"), (F.col("user_id") % 3).cast("string")).alias("speaker"))

    def pauses(self) -> DataFrame:
        return self.segments().filter("gap_ms >= 3000").select("media_id", (F.col("start_ms") - F.col("gap_ms")).alias("start_ms"), F.col("start_ms").alias("end_ms"))

    def media(self) -> DataFrame:
        return self.segments().groupBy("media_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))

    def keyframes(self) -> DataFrame:
        return self.media().select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(10_000).cast("long"))).alias("ts_ms"))

    def speaker_vecs(self) -> DataFrame:
        """F5"""
        return self.table("embeddings").select(F.floor(F.col("vec_id") / 100).alias("media_id"), (F.floor(F.col("vec_id") / 10) % 10).alias("chunk_idx"), F.concat(F.lit("P"), (F.col("vec_id") % 10).cast("string")).alias("speaker"), F.col("vec_id").alias("vec_idx"), "embedding")

    def voices(self) -> DataFrame:
        v = self.table("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
        return v.select(F.concat(F.lit("V"), F.col("label").cast("string")).alias("voice"), F.col("label").alias("voice_ord"), "embedding")

    def variants(self) -> DataFrame:
        """segments with shorter and longer forms of a translation."""
        t, n = F.col("text"), F.length("text")
        part = lambda k: F.substring(t, F.lit(1), F.floor(n * k / 100).cast("int"))
        missing = F.col("seg_idx") % 5 == 0
        return self.segments().select("*", t.alias("translation"), part(45).alias("very_short_translation"), F.when(~missing, part(60)).alias("short_translation"), F.when(~missing, F.concat(t, F.lit(" "), part(20))).alias("long_translation"))

    def synth(self) -> DataFrame:
        """segments with a measured length, 0 where synthesis failed."""
        spoken = F.when(F.col("seg_idx") % 37 == 36, 0).otherwise(F.floor(60 * F.length("text") * (60 + F.col("seg_idx") * 13 % 80) / 100))
        return self.segments().withColumn("spoken_ms", spoken.cast("long"))

    def frames(self) -> DataFrame:
        """F8: energies per 100 ms, nearly silent at the end of a media item."""
        e = self.table("events").select(F.floor(F.col("event_id") / 200).alias("media_id"), (F.col("event_id") % 200).alias("frame_idx"), "value")
        last = F.max("frame_idx").over(Window.partitionBy("media_id"))
        return e.select("media_id", "frame_idx", F.when(F.col("frame_idx") > last - F.col("media_id") % 20, F.lit(0.00001)).otherwise(F.col("value") / 500).alias("rms"))


#: The same tables in DuckDB, in the order in which they build on each other.
CTES = {
    "segments": r"""SELECT media_id, CAST(seg_idx AS BIGINT) AS seg_idx, speaker, text, CAST(gap_ms AS BIGINT) AS gap_ms,
    CAST(sum(60 * length(text) + gap_ms) OVER w AS BIGINT) - 60 * length(text) AS start_ms, CAST(sum(60 * length(text) + gap_ms) OVER w AS BIGINT) AS end_ms
  FROM (SELECT *, ((media_id * 31 + seg_idx * 17) % 9) * 150 + CASE WHEN seg_idx % 23 = 22 THEN 3500 ELSE 0 END AS gap_ms
    FROM (SELECT conv_id AS media_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS seg_idx, 'S_' || role AS speaker, t AS text
      FROM (SELECT conv_id, turn, role, p, regexp_replace(ps[p], '^\s+|\s+$', '', 'g') AS t
        FROM (SELECT conv_id, turn, role, ps, unnest(range(1, len(ps) + 1)) AS p FROM (SELECT *, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ps FROM conversations)))
      WHERE t <> ''))
  WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx)""",
    "words": r"""SELECT media_id, seg_idx, speaker, text, start_ms, end_ms, k, ws[k + 1] AS word, start_ms + k * (end_ms - start_ms) // len(ws) AS w_start, start_ms + (k + 1) * (end_ms - start_ms) // len(ws) AS w_end
  FROM (SELECT *, unnest(range(0, len(ws))) AS k FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM segments))""",
    "rolls": """SELECT event_id // 200 AS media_id, event_id AS roll_idx, epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
    epoch_us(ts) // 1000 - 1704067200000 + CAST(round(value * 10000) AS BIGINT) AS end_ms, 'S_' || (user_id % 3) AS speaker FROM events""",
    "pauses": "SELECT media_id, start_ms - gap_ms AS start_ms, start_ms AS end_ms FROM segments WHERE gap_ms >= 3000",
    "media": "SELECT media_id, max(end_ms) + 1000 AS duration_ms FROM segments GROUP BY media_id",
    "keyframes": "SELECT media_id, unnest(range(0, duration_ms + 1, 10000)) AS ts_ms FROM media",
    "speaker_vecs": "SELECT vec_id // 100 AS media_id, vec_id // 10 % 10 AS chunk_idx, 'P' || (vec_id % 10) AS speaker, vec_id AS vec_idx, embedding::DOUBLE[] AS embedding FROM embeddings",
    "voices": "SELECT 'V' || label AS voice, CAST(label AS BIGINT) AS voice_ord, min_by(embedding, vec_id)::DOUBLE[] AS embedding FROM embeddings GROUP BY label",
    "variants": """SELECT *, text AS translation, left(text, length(text) * 45 // 100) AS very_short_translation, CASE WHEN seg_idx % 5 <> 0 THEN left(text, length(text) * 60 // 100) END AS short_translation,
    CASE WHEN seg_idx % 5 <> 0 THEN text || ' ' || left(text, length(text) * 20 // 100) END AS long_translation FROM segments""",
    "synth": "SELECT *, CAST(CASE WHEN seg_idx % 37 = 36 THEN 0 ELSE 60 * length(text) * (60 + seg_idx * 13 % 80) // 100 END AS BIGINT) AS spoken_ms FROM segments",
    "frames": "SELECT event_id // 200 AS media_id, event_id % 200 AS frame_idx, CASE WHEN event_id % 200 > max(event_id % 200) OVER (PARTITION BY event_id // 200) - (event_id // 200) % 20 THEN 0.00001::DOUBLE ELSE value / 500 END AS rms FROM events",
    "turns": """SELECT media_id, sum(b) OVER (PARTITION BY media_id ORDER BY start_ms, roll_idx ROWS UNBOUNDED PRECEDING) - 1 AS turn_idx, roll_idx, speaker, start_ms, end_ms
  FROM (SELECT media_id, seg_idx AS roll_idx, speaker, start_ms, end_ms, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 300 THEN 0 ELSE 1 END AS b FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seg_idx))""",
    "merged_turns": "SELECT media_id, CAST(turn_idx AS BIGINT) AS turn_idx, min_by(speaker, roll_idx) AS speaker, min(start_ms) AS start_ms, max_by(end_ms, roll_idx) AS end_ms, count(*) AS n_turns FROM turns GROUP BY media_id, turn_idx",
    "removals": """SELECT media_id, start_ms AS original_start_ms, end_ms AS original_end_ms, start_ms + 1500 AS cut_from_ms, end_ms - start_ms - 1500 AS removed_ms,
    CAST(sum(end_ms - start_ms - 1500) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS BIGINT) AS cumulative_ms FROM pauses WHERE end_ms - start_ms > 1500""",
    "numbered": "SELECT *, count(*) OVER (PARTITION BY media_id) AS n_rows FROM segments",
    "chunked": """SELECT media_id, seg_idx, speaker, text, start_ms, end_ms, chunk_idx FROM chunk_walk""",
}


def sql(body: str, *names: str, more: str = "", recursive: str = "") -> str:
    """body after the named tables and what they need; recursive adds a recursive table's text first in need."""
    need, todo = set(), list(names)
    parents = {"words": ["segments"], "pauses": ["segments"], "media": ["segments"], "keyframes": ["media"], "variants": ["segments"], "synth": ["segments"], "turns": ["segments"], "merged_turns": ["turns"], "removals": ["pauses"], "numbered": ["segments"], "chunked": ["segments"]}
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += parents.get(n, [])
    ctes = [f"{k} AS MATERIALIZED (\n  {v}\n)" for k, v in CTES.items() if k in need and k != "chunked"]
    if recursive:
        ctes.append(recursive)
    if "chunked" in need:
        ctes.append(f"chunked AS ({CTES['chunked']})")
    if more:
        ctes.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
