"""Speakers: speaking time, naming, identity across chunks, and choice of reference turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import minutes
from ..functions.vectors import Vectors
from .graph import roots


def speaking_time(turns: DataFrame) -> DataFrame:
    """AG1: per speaker total_ms, first_start_ms, share of the media's total and MM:SS."""
    total = turns.groupBy("media_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.min("start_ms").alias("first_start_ms"))
    share = F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy("media_id"))
    return total.select("media_id", "speaker", "total_ms", "first_start_ms", F.round(share, 6).alias("share"), minutes(F.col("total_ms")).alias("mmss"))


def rename_by_time(turns: DataFrame) -> DataFrame:
    """WN2: speaking_time with new_speaker SPEAKER_00.. by total time, ties by first appearance."""
    by = Window.partitionBy("media_id").orderBy(F.desc("total_ms"), "first_start_ms", "speaker")
    return speaking_time(turns).withColumn("new_speaker", F.format_string("SPEAKER_%02d", F.row_number().over(by) - 1))


def remap(rows: DataFrame, names: DataFrame) -> DataFrame:
    """JN13: rows with speakers replaced by names (media_id, speaker, new_speaker); unknown ones become UNKNOWN_ and their name."""
    found = rows.join(names.select("media_id", "speaker", "new_speaker"), ["media_id", "speaker"], "left")
    return found.withColumn("speaker", F.coalesce("new_speaker", F.concat(F.lit("UNKNOWN_"), "speaker"))).select(*rows.columns)


def earlier_match(vecs: DataFrame, limit: float = 0.15, block: int = 1024) -> DataFrame:
    """JN6: each (chunk, speaker) with its closest speaker of any earlier chunk of the media, where their cosine distance is below limit.

    A media item's vectors are dealt to blocks of about `block`, and each pair of blocks is one matrix product in one task, so a large item spreads over many; ties
    go to the earlier chunk, then the speaker that sorts first.
    """
    rows = vecs.select(F.col("media_id").cast("long").alias("media_id"), F.col("chunk_idx").cast("long").alias("chunk"), F.col("speaker").alias("spk"), F.col("embedding").cast("array<double>").alias("v"))
    sized = rows.groupBy("media_id").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    dealt = rows.join(sized, "media_id").withColumn("own", F.pmod(F.xxhash64("chunk", "spk"), F.col("nb")).cast("int"))
    others = F.sequence(F.lit(0), F.col("nb") - 1)
    task = lambda i, j, later: F.struct(i.alias("i"), j.alias("j"), F.lit(later).alias("later"))
    tasks = F.concat(F.transform(others, lambda k: task(F.col("own"), k, True)), F.transform(others, lambda k: task(k, F.col("own"), False)))
    dealt = dealt.select("media_id", "chunk", "spk", "v", F.explode(tasks).alias("t")).select("media_id", "chunk", "spk", "v", "t.*")

    def run(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cur = t.filter(t.column("later"))
        prev = t.filter(pc.invert(t.column("later"))).sort_by([("chunk", "ascending"), ("spk", "ascending")])
        chunk, before = cur.column("chunk").to_numpy(), prev.column("chunk").to_numpy()
        out = []
        for mine, theirs, d in Vectors(cur.column("v").to_pylist()).distances(Vectors(prev.column("v").to_pylist())):
            d = np.where(before[theirs][None, :] < chunk[mine][:, None], d, np.inf)
            best = d.argmin(1)
            low = d[np.arange(len(best)), best]
            out += [(int(i), int(theirs[k]), float(x)) for i, k, x in zip(mine, best, low, strict=True) if x < limit]
        i, k = pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())
        return pa.table([cur.column("media_id").take(i), cur.column("chunk").take(i), cur.column("spk").take(i), pa.array([o[2] for o in out], pa.float64()), prev.column("chunk").take(k), prev.column("spk").take(k)], ["media_id", "chunk", "spk", "d", "prev_chunk", "prev_speaker"])

    pairs = dealt.groupBy("media_id", "i", "j").applyInArrow(run, "media_id long, chunk long, spk string, d double, prev_chunk long, prev_speaker string")
    best = pairs.groupBy("media_id", "chunk", "spk").agg(F.min(F.struct("d", "prev_chunk", "prev_speaker")).alias("best"))
    return best.select("media_id", F.col("chunk").alias("chunk_idx"), F.col("spk").alias("speaker"), F.col("best.prev_chunk").alias("prev_chunk"), F.col("best.prev_speaker").alias("prev_speaker"), F.round("best.d", 6).alias("distance"))


def global_speakers(vecs: DataFrame, limit: float = 0.15) -> DataFrame:
    """AG7: (media_id, chunk_idx, speaker, global_idx): matches are followed to the first chunk; each root gets a number in order of appearance."""
    node = lambda c, s: F.struct(F.col("media_id").cast("long").alias("m"), F.col(c).cast("long").alias("c"), F.col(s).alias("s"))
    match = earlier_match(vecs, limit).select(node("chunk_idx", "speaker").alias("node"), node("prev_chunk", "prev_speaker").alias("parent"))
    nodes = vecs.select("media_id", "chunk_idx", "speaker", node("chunk_idx", "speaker").alias("node")).join(match, "node", "left")
    rooted = roots(nodes.select("node", "parent"))
    found = nodes.select("media_id", "chunk_idx", "speaker", "node").join(rooted, "node")
    return found.select("media_id", "chunk_idx", "speaker", (F.dense_rank().over(Window.partitionBy("media_id").orderBy("root")) - 1).alias("global_idx"))


def longest_turns(turns: DataFrame, keys: tuple[str, ...] = ("media_id", "speaker"), n: int = 5, least_ms: int = 0, order: str = "roll_idx") -> DataFrame:
    """TOP1, TOP2: the n longest turns per keys of at least least_ms; rank 1 is the longest, ties by start."""
    by = Window.partitionBy(*keys).orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms", order)
    return turns.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def best_reference(turns: DataFrame, least_ms: int = 2000, ideal_ms: int = 7000) -> DataFrame:
    """TOP3: per speaker the turn of at least least_ms whose length is closest to ideal_ms; on ties the longer, then the earlier."""
    d = F.col("end_ms") - F.col("start_ms")
    pick = F.struct(F.abs(d - ideal_ms).alias("a"), (-d).alias("b"), F.col("start_ms").alias("c"))
    return turns.filter(d >= least_ms).groupBy("media_id", "speaker").agg(F.min_by(F.struct("start_ms", "end_ms"), pick).alias("t")).select("media_id", "speaker", "t.start_ms", "t.end_ms")


def first_phrases(segments: DataFrame, n: int = 3) -> DataFrame:
    """TOP5: the first n segments per speaker."""
    by = Window.partitionBy("media_id", "speaker").orderBy("seg_idx")
    return segments.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def distinct_speakers(rows: DataFrame) -> DataFrame:
    """AG2: distinct speakers per media item."""
    return rows.groupBy("media_id").agg(F.count_distinct("speaker").alias("n_speakers"))


def catalogue_speakers(rows: DataFrame) -> DataFrame:
    """AG2 over all media: media items, and distinct speakers of the whole catalogue, exactly; null speakers don't count."""
    return rows.agg(F.count_distinct("media_id").alias("n_media"), F.count_distinct("speaker").alias("n_speakers"))


def speaker_states(rows: DataFrame, lg_k: int = 14) -> DataFrame:
    """A state per media item that catalogue counts can be had from without its rows: its distinct speakers, and a HyperLogLog sketch of them (null: none)."""
    return rows.groupBy("media_id").agg(F.count_distinct("speaker").alias("n_speakers"), F.hll_sketch_agg("speaker", F.lit(lg_k)).alias("sketch"))


def with_arrived(states: DataFrame, arrived: DataFrame) -> DataFrame:
    """states with those of media that have arrived; a media item that arrives again replaces its state, so a repeated batch changes nothing."""
    seen = arrived.select(F.col("media_id").alias("_m"))
    return states.join(seen, F.col("media_id").eqNullSafe(F.col("_m")), "left_anti").unionByName(arrived)


def speakers_of_states(states: DataFrame) -> DataFrame:
    """Media items and about how many distinct speakers all states have; at 2**14 registers the standard error is below 1 %; the order of merging moves it within that."""
    return states.agg(F.count("*").alias("n_media"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_speakers"))


def unmuted(rows: DataFrame, muted: list[str] | str) -> DataFrame:
    """FL1: rows whose speaker is not in a list (or comma-separated string) of muted ones; blanks in it are ignored, a null speaker stays."""
    names = [x.strip() for x in (muted.split(",") if isinstance(muted, str) else muted) if x and x.strip()]
    return rows.filter(F.col("speaker").isNull() | ~F.col("speaker").isin(names)) if names else rows


def unmuted_ranges(rolls: DataFrame, muted: list[str] | str) -> DataFrame:
    """FL11: the ranges in which an unmuted speaker talks."""
    return unmuted(rolls, muted).select("media_id", "start_ms", "end_ms").distinct()


def is_long(ms: int = 750) -> Column:
    """FL2: whether a roll is longer than ms, whichever way its ends lie."""
    return F.abs(F.col("end_ms") - F.col("start_ms")) > ms


def is_too_short(ms: int = 500) -> Column:
    """FL3: whether a roll is shorter than ms, and so not worth transcribing."""
    return F.col("end_ms") - F.col("start_ms") < ms


def all_turns(*tables: DataFrame) -> DataFrame:
    """SET1: the turns of several tables (chunks, recognisers) in one; equal ones stay."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def probe_windows(clips: DataFrame, n: int = 3) -> DataFrame:
    """SC19: n windows over each clip (media_id, clip_idx, dur_ms): 3, 4 or 5 s wide by its length; start, middle and end, or even steps.

    A clip no longer than the window is taken whole.
    """
    d = F.col("dur_ms")
    w = F.when(d < 15_000, 3000).when(d < 30_000, 4000).otherwise(5000)
    k = F.sequence(F.lit(0), F.lit(n - 1))
    starts = F.transform(k, lambda i: F.floor((d - F.col("w")) / max(1, n - 1)) * i) if n != 3 else F.array(F.lit(0).cast("long"), F.floor((d - F.col("w")) / 2), d - F.col("w"))
    rows = clips.withColumn("w", w.cast("long")).withColumn("s", F.when(d <= F.col("w"), F.array(F.lit(0).cast("long"))).otherwise(starts))
    return rows.select("media_id", "clip_idx", "dur_ms", "w", F.posexplode("s").alias("probe", "start_ms")).select("media_id", "clip_idx", "probe", "start_ms", F.least(F.col("start_ms") + F.col("w"), F.col("dur_ms")).alias("end_ms"))
