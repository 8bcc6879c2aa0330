"""Joins and windows on time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import DEPTH, last_point, overlapping, started_within
from .scan import CELL_MS, scan


def overlap_pairs(rolls: DataFrame, min_overlap_ms: int = 1500, depth: int = DEPTH, cell_ms: int = CELL_MS) -> DataFrame:
    """JN1: pairs of turns (earlier roll_idx first) of one media that overlap by more than min_overlap_ms.

    Of two turns the later one starts in the earlier one, more than min_overlap_ms before its end.
    """
    # turns no longer than the limit can't overlap by more
    long = rolls.filter(F.col("end_ms") - F.col("start_ms") > min_overlap_ms)
    turns = long.select("media_id", F.col("start_ms").alias("s"), (F.col("end_ms") - min_overlap_ms).alias("e"), F.struct("roll_idx", "speaker", "start_ms", "end_ms").alias("x"))
    found = started_within(turns, depth, cell_ms).filter("a.roll_idx <> b.roll_idx")
    low = F.col("a.roll_idx") < F.col("b.roll_idx")
    named = found.select("media_id", F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"))
    start, end = F.greatest("a.start_ms", "b.start_ms"), F.least("a.end_ms", "b.end_ms")
    return named.select("media_id", F.col("a.roll_idx").alias("roll_idx_a"), F.col("b.roll_idx").alias("roll_idx_b"), F.col("a.speaker").alias("speaker_a"), F.col("b.speaker").alias("speaker_b"), start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("overlap_ms"))


def merge_turns(rolls: DataFrame, max_gap_ms: int = 300, end: str = "last", cell_ms: int = CELL_MS) -> DataFrame:
    """WN1: neighbouring turns (in start order over all speakers) of one speaker with a gap of at most max_gap_ms become one.

    Its end is the last turn's end, or with end="max" the latest.
    """
    order = ["start_ms", "roll_idx"]
    last = F.max("end_ms") if end == "max" else F.max_by("end_ms", F.struct(*order))
    after = scan(rolls.select("media_id", "speaker", "end_ms", *order), ["media_id"], order, cell_ms, previous={"_speaker": F.col("speaker"), "_end": F.col("end_ms")})
    new = F.coalesce((F.col("_speaker") != F.col("speaker")) | (F.col("start_ms") - F.col("_end") > max_gap_ms), F.lit(True))
    runs = scan(after.withColumn("_new", new.cast("long")), ["media_id"], order, cell_ms, sums={"_turns": F.col("_new")}).withColumn("turn_idx", F.col("_turns") - 1)
    return runs.groupBy("media_id", "turn_idx").agg(F.min_by("speaker", F.struct(*order)).alias("speaker"), F.min("start_ms").alias("start_ms"), last.alias("end_ms"), F.count("*").alias("n_turns"))


def without_keyframes(pauses: DataFrame, keyframes: DataFrame, buffer_ms: int = 200, cell_ms: int = CELL_MS) -> DataFrame:
    """FL7: pauses with no keyframe in [start - buffer, end + buffer]."""
    spans = pauses.select("media_id", (F.col("end_ms") + buffer_ms).alias("hi"), F.struct(*pauses.columns).alias("span"))
    seen = last_point(keyframes.select("media_id", F.col("ts_ms").alias("t")), spans, cell_ms)
    hit = F.col("last_t") >= F.greatest(F.lit(0), F.col("span.start_ms") - buffer_ms)
    return seen.filter(~F.coalesce(hit, F.lit(False)) | F.col("media_id").isNull() | F.col("span.start_ms").isNull()).select("span.*")


def inside_edges(pauses: DataFrame, media: DataFrame, edge_ms: int = 500) -> DataFrame:
    """FL8: pauses that start after edge_ms and end before the media's last edge_ms."""
    return pauses.join(media.select("media_id", "duration_ms"), "media_id").filter((F.col("start_ms") > edge_ms) & (F.col("end_ms") < F.col("duration_ms") - edge_ms)).drop("duration_ms")


def cuts_on_keyframes(cuts: DataFrame, keyframes: DataFrame, tolerance_ms: int = 100, cell_ms: int = CELL_MS) -> DataFrame:
    """FL9: per media, whether every cut start lies within tolerance_ms of a keyframe (false if it has none)."""
    spans = cuts.select("media_id", (F.col("start_ms") + tolerance_ms).alias("hi"), F.struct("start_ms").alias("span"))
    seen = last_point(keyframes.select("media_id", F.col("ts_ms").alias("t")), spans, cell_ms)
    hit = F.col("media_id").isNotNull() & (F.col("last_t") >= F.col("span.start_ms") - tolerance_ms)
    return seen.groupBy("media_id").agg(F.bool_and(F.coalesce(hit, F.lit(False))).alias("aligned"), F.count("*").alias("n_cuts"))


def pause_removals(pauses: DataFrame, preserve_ms: int = 1500, cell_ms: int = CELL_MS) -> DataFrame:
    """WN6: what to cut from pauses longer than preserve_ms, and the running total cut so far."""
    cut = pauses.select("media_id", "start_ms", "end_ms").filter(F.col("end_ms") - F.col("start_ms") > preserve_ms)
    total = scan(cut, ["media_id"], ["start_ms", "end_ms"], cell_ms, sums={"cumulative_ms": F.col("end_ms") - F.col("start_ms") - preserve_ms})
    return total.select("media_id", F.col("start_ms").alias("original_start_ms"), F.col("end_ms").alias("original_end_ms"), (F.col("start_ms") + preserve_ms).alias("cut_from_ms"), (F.col("end_ms") - F.col("start_ms") - preserve_ms).alias("removed_ms"), "cumulative_ms")


def kept_pieces(removals: DataFrame, media: DataFrame) -> DataFrame:
    """WN7: the complement of the removals in [0, duration]; empty pieces drop out."""
    cuts = removals.select("media_id", F.col("cut_from_ms").alias("until"), F.col("original_end_ms").alias("resume"))
    tail = media.select("media_id", F.col("duration_ms").alias("until"), F.lit(None).cast("long").alias("resume"))
    by = Window.partitionBy("media_id").orderBy("until", F.col("resume").asc_nulls_last())
    pieces = cuts.unionByName(tail).select("media_id", F.coalesce(F.lag("resume").over(by), F.lit(0)).alias("start_ms"), F.col("until").alias("end_ms"))
    return pieces.filter("start_ms < end_ms")


def retime(rows: DataFrame, removals: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """JN2: start_ms and end_ms of rows (media_id, seg_idx, ...) moved by the pauses removed before them.

    An as-of join: each time looks up the last removal whose pause starts at or before it.  Times and removals go through one ordered
    scan, so no pair of rows is built and a long media item is many tasks' work.
    """
    times = rows.select("media_id", "seg_idx", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_ms").alias("t")), F.struct(F.lit("end").alias("side"), F.col("end_ms").alias("t")))).alias("x"))
    times = times.select("media_id", "seg_idx", "x.side", "x.t", F.lit(1).alias("kind"), F.lit(None).cast("struct<e:bigint,r:bigint,c:bigint>").alias("adj"))
    marks = removals.select("media_id", F.lit(None).cast("int").alias("seg_idx"), F.lit(None).cast("string").alias("side"), F.col("original_start_ms").alias("t"), F.lit(0).alias("kind"), F.struct(F.col("original_end_ms").alias("e"), F.col("removed_ms").alias("r"), F.col("cumulative_ms").alias("c")).alias("adj"))
    both = marks.unionByName(times).withColumn("e", F.col("adj.e"))
    found = scan(both, ["media_id"], ["t", "kind", "e"], cell_ms, lasts={"adj": F.col("adj")}).filter("kind = 1")
    moved = F.when(F.col("adj").isNull(), F.col("t")).when(F.col("t") >= F.col("adj.e"), F.col("t") - F.col("adj.c")).otherwise(F.least(F.col("t"), F.col("adj.e") - F.col("adj.r")) - (F.col("adj.c") - F.col("adj.r")))
    side = lambda s: F.max(F.when(F.col("side") == s, moved))
    new = found.groupBy("media_id", "seg_idx").agg(F.greatest(F.lit(0), side("start")).alias("new_start_ms"), side("end").alias("_e"))
    return new.select("media_id", "seg_idx", "new_start_ms", F.greatest("new_start_ms", "_e").alias("new_end_ms"))


def excerpt_plan(rolls: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """WN8: per speaker, turns in start order until limit_ms are full; the last one is trimmed."""
    by = Window.partitionBy("media_id", "speaker").orderBy("start_ms", "roll_idx")
    upto = rolls.withColumn("before_ms", F.sum(F.col("end_ms") - F.col("start_ms")).over(by) - (F.col("end_ms") - F.col("start_ms")))
    return upto.filter(F.col("before_ms") < limit_ms).select("media_id", "speaker", "roll_idx", "start_ms", F.least(F.col("end_ms"), F.col("start_ms") + limit_ms - F.col("before_ms")).alias("end_ms"), "before_ms")


def audible(keep: DataFrame, media: DataFrame) -> DataFrame:
    """JN10: stretches of each media with the source heard there: original inside any keep interval, dubbed elsewhere.

    A sweep over interval ends: where the number of open intervals is above 0, the original is heard.
    """
    inside = keep.join(media.select("media_id", "duration_ms"), "media_id").select("media_id", F.greatest(F.lit(0), F.col("start_ms")).alias("s"), F.least("end_ms", "duration_ms").alias("e")).filter("s < e")
    edges = inside.select("media_id", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).select("media_id", "x.t", "x.d")
    ends = media.select("media_id", F.explode(F.array(F.lit(0).cast("long"), F.col("duration_ms"))).alias("t"), F.lit(0).alias("d"))
    by = Window.partitionBy("media_id").orderBy("t")
    points = edges.unionByName(ends).groupBy("media_id", "t").agg(F.sum("d").alias("d"))
    spans = points.withColumn("original", F.sum("d").over(by) > 0).withColumn("until", F.lead("t").over(by)).filter("until IS NOT NULL AND t < until")
    new = F.coalesce(F.lag("original").over(by) != F.col("original"), F.lit(True))
    runs = spans.withColumn("g", F.sum(new.cast("int")).over(by))
    return runs.groupBy("media_id", "g").agg(F.min("t").alias("start_ms"), F.max("until").alias("end_ms"), F.first("original").alias("o")).select("media_id", "start_ms", "end_ms", F.when(F.col("o"), "original").otherwise("dubbed").alias("source"))


def speaker_of_words(words: DataFrame, rolls: DataFrame, depth: int = DEPTH, cell_ms: int = CELL_MS) -> DataFrame:
    """JN11: each word (media_id, word_idx, start_ms, end_ms) with the speaker of the turn that overlaps it most; null if none does.

    Equal overlaps go to the earlier turn.
    """
    side = lambda df, idx, speaker: df.select("media_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.struct(F.col(idx).cast("long").alias("idx"), speaker.alias("speaker"), "start_ms", "end_ms").alias("x"))
    hit = overlapping(side(words, "word_idx", F.lit(None).cast("string")), side(rolls, "roll_idx", F.col("speaker")), depth, cell_ms)
    overlap = F.least("a.end_ms", "b.end_ms") - F.greatest("a.start_ms", "b.start_ms")
    best = hit.groupBy("media_id", F.col("a.idx").alias("word_idx")).agg(F.max_by("b.speaker", F.struct(overlap.alias("n"), (-F.col("b.start_ms")).alias("s"), (-F.col("b.idx")).alias("i"))).alias("speaker"))
    return words.select("media_id", "word_idx", "start_ms", "end_ms").join(best, ["media_id", "word_idx"], "left")


def silences(frames: DataFrame, limit_db: float = -30.0, least_ms: int = 500, frame_ms: int = 100) -> DataFrame:
    """WN11: runs of frames (media_id, frame_idx, rms) below limit_db that last at least least_ms."""
    quiet = frames.filter(F.col("rms") < 10 ** (limit_db / 20))
    g = F.col("frame_idx") - F.row_number().over(Window.partitionBy("media_id").orderBy("frame_idx"))
    runs = quiet.withColumn("g", g).groupBy("media_id", "g").agg((F.min("frame_idx") * frame_ms).alias("start_ms"), ((F.max("frame_idx") + 1) * frame_ms).alias("end_ms"))
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("g")


def last_of_equal_ranges(rolls: DataFrame) -> DataFrame:
    """SET2: of turns with one and the same range the last wins."""
    return rolls.groupBy("media_id", "start_ms", "end_ms").agg(F.max_by("speaker", "roll_idx").alias("speaker"))


def shift_by_chunk(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """FL13: start_ms, end_ms and the times of nested words moved by their chunk's offset_ms."""
    moved = rows.join(chunks.select("media_id", "chunk_idx", "offset_ms"), ["media_id", "chunk_idx"])
    off = F.col("offset_ms")
    moved = moved.withColumn("start_ms", F.col("start_ms") + off).withColumn("end_ms", F.col("end_ms") + off)
    if "words" in rows.columns:
        moved = moved.withColumn("words", F.transform("words", lambda w: w.withField("start_ms", w["start_ms"] + off).withField("end_ms", w["end_ms"] + off)))
    return moved.select(*rows.columns)


def slice_media(rows: DataFrame, media: DataFrame, start_ms: int = 0, duration_ms: int | None = None) -> DataFrame:
    """FL12: rows that start inside [start, start + duration) of their media, and the total duration that remains."""
    total = F.least(F.lit(duration_ms).cast("long"), F.col("duration_ms") - start_ms) if duration_ms is not None else F.col("duration_ms") - start_ms
    joined = rows.join(media.select("media_id", "duration_ms"), "media_id").withColumn("total_ms", F.greatest(F.lit(0), total))
    return joined.filter((F.col("start_ms") >= start_ms) & (F.col("start_ms") < F.lit(start_ms) + F.col("total_ms"))).drop("duration_ms")
