"""Voices: statistics, duration estimates, nearest voices, votes and exclusive assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_count, complexity, word_count
from .graph import shared_folder_set
from .nearest import nearest, voice_index

WPM, CPS = 150.0, 12.5


def voice_stats(samples: DataFrame) -> DataFrame:
    """AG5: per voice the sums over samples (voice, text, dur_ms) and words per minute, characters per second (defaults without data)."""
    sums = samples.groupBy("voice").agg(F.count("*").alias("n"), F.sum(word_count(F.col("text"))).alias("words"), F.sum(char_count(F.col("text"))).alias("chars"), F.sum("dur_ms").alias("ms"))
    rate = lambda n, per, default: F.round(F.coalesce(F.when(F.col("ms") > 0, F.col(n) * per / F.col("ms")), F.lit(default)), 6)
    return sums.select("voice", "n", "words", "chars", "ms", rate("words", 60_000.0, WPM).alias("wpm"), rate("chars", 1000.0, CPS).alias("cps"))


def estimated_ms(text: Column, wpm: Column, cps: Column, has_samples: Column, speed: float = 1.0) -> Column:
    """SC7: spoken length in ms: by words, and by characters too if the voice has samples (mean), times complexity; 0 for blank, else 100 at least."""
    by_words = word_count(text) / wpm * 60
    both = F.when(has_samples, (by_words + char_count(text) / cps) / 2).otherwise(by_words)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0.0)).otherwise(F.greatest(F.lit(100.0), F.round(both * complexity(text) / speed * 1000, 3)))


def fixed_rate_ms(text: Column, wpm: float = WPM) -> Column:
    """SC9: spoken length at a fixed word rate."""
    return F.round(word_count(text) * F.lit(60_000.0) / wpm, 3)


def nearest_voice(vectors: DataFrame, voices: DataFrame) -> DataFrame:
    """JN7: each vector (media_id, speaker, vec_idx, embedding) with its nearest voice (voice, voice_ord, embedding); ties by catalogue order.

    The catalogue is indexed first (operators/nearest.py); to ask one catalogue often, write voice_index(voices) and hand it to nearest() instead.
    """
    shared_folder_set(vectors)
    found = nearest(vectors, voice_index(voices).checkpoint())
    return found.select("media_id", "speaker", "vec_idx", "voice", "voice_ord", F.round("d", 6).alias("distance"))


def voice_votes(vectors: DataFrame, voices: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """AG6: per speaker the voices by votes of its vectors, then mean distance, then catalogue order; rank 1 wins."""
    allowed = voices.filter(~F.col("voice").isin(excluded)) if excluded else voices
    votes = nearest_voice(vectors, allowed).groupBy("media_id", "speaker", "voice", "voice_ord").agg(F.count("*").alias("votes"), F.round(F.sum(F.round(F.col("distance") * 1_000_000).cast("long")) / F.count("*") / 1_000_000, 9).alias("mean_distance"))
    by = Window.partitionBy("media_id", "speaker").orderBy(F.desc("votes"), "mean_distance", "voice_ord")
    return votes.withColumn("rank", F.row_number().over(by))


def exclusive_voices(candidates: DataFrame, order: DataFrame, default: str = "default", least_ms: int = 3000) -> DataFrame:
    """PK7: speakers in order of first appearance each take their best voice that no earlier one took.

    candidates (media_id, speaker, voice, rank); order (media_id, speaker, first_idx, ref_ms).  A voice given on a reference shorter than
    least_ms is used but not taken.  A fold over each media item's few speakers.
    """
    wish = candidates.groupBy("media_id", "speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "voice"))), lambda x: x["voice"]).alias("wish"))
    rows = order.join(wish, ["media_id", "speaker"], "left").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("first_idx", "speaker", "ref_ms", F.coalesce("wish", F.array().cast("array<string>")).alias("wish")))).alias("s"))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<speaker:string,voice:string>>").alias("out"))

    def give(s, x):
        free = F.get(F.filter(x["wish"], lambda v: ~F.array_contains(s["taken"], v)), F.lit(0))
        taken = F.when(free.isNotNull() & (x["ref_ms"] >= least_ms), F.array_append(s["taken"], free)).otherwise(s["taken"])
        return F.struct(taken.alias("taken"), F.array_append(s["out"], F.struct(x["speaker"].alias("speaker"), F.coalesce(free, F.lit(default)).alias("voice"))).alias("out"))

    return rows.select("media_id", F.explode(F.aggregate("s", start, give, lambda s: s["out"])).alias("x")).select("media_id", "x.speaker", "x.voice")


def catalogue_voices(candidates: DataFrame, order: DataFrame, taken: DataFrame | None = None, default: str = "default", least_ms: int = 3000) -> DataFrame:
    """PK7 over the whole catalogue: as exclusive_voices, but a voice is taken for all media, and voices of the table taken (voice) are out from the beginning.

    Media come in order of media_id.  All speakers ask for their best voice at once; a voice stays with the earliest who asks, and is struck from the lists of all
    later ones.  A voice only ever passes to an earlier speaker, so what is struck stays struck, and the end is what one speaker after the other would get: the
    first speaker without a voice for good has every voice of those before struck, and gets its best of the rest.  A reference that is short or null (or a
    speaker that isn't in candidates) takes nothing; such a speaker gets its best voice that no earlier one took.
    """
    shared_folder_set(order)
    who = ["media_id", "speaker"]
    free = candidates if taken is None else candidates.join(taken.select("voice").distinct(), "voice", "left_anti")
    wishes = free.join(order.select(*who, "first_idx", "ref_ms"), who).select("voice", F.struct("rank", "voice").alias("wish"), F.struct("media_id", "first_idx", "speaker").alias("place"), F.coalesce(F.col("ref_ms") >= least_ms, F.lit(False)).alias("pins"))
    wishes = wishes.checkpoint()

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("place").agg(F.min("wish").alias("w")).select("place", F.col("w.voice").alias("voice"))

    def holders(rows: DataFrame) -> DataFrame:
        return best(rows).groupBy("voice").agg(F.min("place").alias("holder"))

    asking, n = wishes.filter("pins"), -1
    while n != (n := asking.count()):
        asking = asking.join(holders(asking), "voice", "left").filter("holder IS NULL OR place <= holder").drop("holder").checkpoint()
    brief = wishes.filter("NOT pins").join(holders(asking), "voice", "left").filter("holder IS NULL OR place < holder")
    given = best(asking).unionByName(best(brief)).select("place.media_id", "place.speaker", "voice")
    return order.select(*who).join(given, who, "left").select(*who, F.coalesce("voice", F.lit(default)).alias("voice"))


def tts_system(rows: DataFrame, mapping: DataFrame, default: str) -> DataFrame:
    """JN3: rows with tts_system by exact speaker, else by the mapping's '*' (the first in order of systems if it has several), else default."""
    exact = mapping.filter("speaker <> '*'").select("speaker", F.col("system").alias("_s"))
    star = mapping.filter("speaker = '*'").agg(F.min("system")).scalar()
    return rows.join(exact, "speaker", "left").select(*rows.columns, F.coalesce("_s", star, F.lit(default)).alias("tts_system"))


def voice_of(rows: DataFrame, mapping: DataFrame, catalogue: DataFrame, default: str = "default") -> DataFrame:
    """JN4: rows (with an optional voice_override) with voice: the override, else the speaker's, else the mapping's first, else default.

    mapping (ord, speaker, voice); a voice counts only if the catalogue has it in any letter case, and is spelled as there.
    """
    first = mapping.agg(F.min_by("voice", "ord")).scalar()
    named = catalogue.select(F.lower("voice").alias("_low"), F.col("voice").alias("_named"))
    found = rows.join(mapping.select("speaker", F.col("voice").alias("_m")), "speaker", "left")
    found = found.withColumn("_low", F.lower(F.coalesce("voice_override", "_m", first))).join(named, "_low", "left")
    return found.select(*rows.columns, F.coalesce("_named", F.lit(default)).alias("voice"))


def pinnable(references: DataFrame, least_ms: int = 500, pin_ms: int = 3000) -> DataFrame:
    """FL10: references with dur_ms only where it suffices for a vector (else null), and whether the voice found by it may be kept for the speaker."""
    return references.withColumn("usable_ms", F.when(F.col("dur_ms") >= least_ms, F.col("dur_ms"))).withColumn("pin", F.col("dur_ms") >= pin_ms)


def style_prompt(mapped: Column, hint: Column, voice: Column, emotion: Column) -> Column:
    """SC17: mapping, else the segment's hint, else a sentence from voice and emotion; it ends with a colon."""
    made = F.when(emotion.isNotNull(), F.concat(F.lit("Make "), voice, F.lit(" sound "), F.lower(emotion)))
    text = F.coalesce(F.nullif(F.trim(mapped), F.lit("")), F.nullif(F.trim(hint), F.lit("")), made)
    return F.when(text.rlike(":$"), text).otherwise(F.concat(text, F.lit(":")))


def speech_prompt(style: Column, text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.concat(style, F.lit("\n\n")), F.lit("")), text)


def need_voice(segments: DataFrame, mapped: DataFrame, references: DataFrame) -> DataFrame:
    """SET5: speakers with a reference and no voice yet, by first use."""
    missing = segments.join(mapped.select("speaker").distinct(), "speaker", "left_anti").join(references.select("media_id", "speaker").distinct(), ["media_id", "speaker"], "left_semi")
    return missing.groupBy("media_id", "speaker").agg(F.min("seg_idx").alias("first_idx"))


def coverage(catalogue: DataFrame, stats: DataFrame, vectors: DataFrame, force: bool = False) -> DataFrame:
    """SET6: per voice whether it has statistics and a vector, and whether it needs a refresh."""
    s, v = stats.select("voice").distinct().withColumn("has_stats", F.lit(True)), vectors.select("voice").distinct().withColumn("has_vector", F.lit(True))
    out = catalogue.select("voice").join(s, "voice", "left").join(v, "voice", "left").select("voice", F.coalesce("has_stats", F.lit(False)).alias("has_stats"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"))
    return out.withColumn("needs", F.lit(force) | ~F.col("has_stats") | ~F.col("has_vector"))


def free_voices(catalogue: DataFrame, taken: DataFrame) -> DataFrame:
    """SET3: catalogue voices that are not taken."""
    return catalogue.join(taken.select("voice"), "voice", "left_anti")
