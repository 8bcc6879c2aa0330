"""Overlaps by places in order against plain loops, dense items, and one long item over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from segflow.operators import intervals, ranges

TURNS = "media_id long, roll_idx int, speaker string, start_ms long, end_ms long"


def some_turns(seed, n=120, span=4000, most=900):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice("abc"), t := rng.randrange(0, span, 50), t + rng.randrange(-50, most, 50)) for k, _ in enumerate(range(n))]
    return [*rows, rows[0], rows[1], (1, None, "n", 0, 900), (1, 500, "s", None, 900), (1, 501, "e", 10, None), (1, 502, None, 0, 4000)]


@pytest.mark.parametrize("depth, cell", [(1, 100), (7, 1000), (256, 600_000)])
def test_overlap_pairs_equal_the_loop(spark, depth, cell):
    rows = some_turns(depth)
    got = intervals.overlap_pairs(spark.createDataFrame(rows, TURNS), 150, depth, cell)
    want = []
    for a in rows:
        for b in rows:
            if None in (a[0], a[1], b[1], a[3], a[4], b[3], b[4]) or a[0] != b[0] or not a[1] < b[1]:
                continue
            s, e = max(a[3], b[3]), min(a[4], b[4])
            if e - s > 150:
                want.append((a[0], a[1], b[1], a[2], b[2], s, e, e - s))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


@pytest.mark.parametrize("depth, cell", [(1, 100), (5, 1000), (256, 600_000)])
def test_overlapping_equals_the_loop_with_repeats(spark, depth, cell):
    left, right = some_turns(depth + 50, 60), some_turns(depth + 90, 60)
    side = lambda rows: spark.createDataFrame(rows, TURNS).select("media_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.struct("roll_idx", "start_ms", "end_ms").alias("x"))
    got = ranges.overlapping(side(left), side(right), depth, cell).select("media_id", "a.roll_idx", "a.start_ms", "b.roll_idx", "b.start_ms")
    full = lambda r: None not in (r[0], r[3], r[4]) and r[3] < r[4]
    want = [(a[0], a[1], a[3], b[1], b[3]) for a in left for b in right if full(a) and full(b) and a[0] == b[0] and max(a[3], b[3]) < min(a[4], b[4])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


@pytest.mark.parametrize("depth, cell", [(1, 100), (256, 600_000)])
def test_speaker_of_words_equals_the_loop(spark, depth, cell):
    words = [(m, k, s, e) for k, (m, _, _, s, e) in enumerate(some_turns(7, 80, most=300))]
    turns = some_turns(8, 40)
    got = intervals.speaker_of_words(spark.createDataFrame(words, "media_id long, word_idx long, start_ms long, end_ms long"), spark.createDataFrame([t for t in turns if t[1] is not None], TURNS), depth, cell)
    want = []
    for m, k, s, e in words:
        hits = [(min(e, t[4]) - max(s, t[3]), -t[3], -t[1], t[2]) for t in turns if None not in (m, s, e, t[1], t[3], t[4]) and t[0] == m and max(s, t[3]) < min(e, t[4]) and s < e]
        want.append((m, k, s, e, max(hits, key=lambda h: h[:3])[3] if hits else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cell", [70, 600_000])
def test_keyframes_near_pauses_equal_the_loop(spark, cell):
    rng = random.Random(cell)
    pauses = [(rng.choice([1, 2, 3, None]), t := rng.randrange(0, 3000, 10), t + rng.randrange(0, 200), k) for k in range(60)] + [(1, None, 5, 99), (1, 5, None, 98)]
    frames = [(rng.choice([1, 2, None]), rng.randrange(0, 3000, 10)) for _ in range(40)] + [(1, None)]
    p, k = spark.createDataFrame(pauses, "media_id long, start_ms long, end_ms long, last_t int"), spark.createDataFrame(frames, "media_id long, ts_ms long")
    hit = lambda m, lo, hi: None not in (m, lo, hi) and any(f[0] == m and f[1] is not None and lo <= f[1] <= hi for f in frames)
    got = intervals.without_keyframes(p, k, 20, cell)
    assert got.columns == p.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in pauses if None in r or not hit(r[0], max(0, r[1] - 20), r[2] + 20)), key=str)
    cuts = {}
    for m, s, _, _ in pauses:
        cuts.setdefault(m, []).append(s is not None and hit(m, s - 20, s + 20))
    got = intervals.cuts_on_keyframes(p, k, 20, cell)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((m, all(v), len(v)) for m, v in cuts.items()), key=str)


def test_dense_speech_is_compared_with_little_more_than_it_overlaps(spark):
    """3,000 turns of 200 ms within one minute: a bucket of a minute compares 9,000,000 pairs."""
    rng = random.Random(3)
    starts = sorted(rng.randrange(60_000) for _ in range(3000))
    rows = spark.createDataFrame([(1, 0, t, t + 200, (k,)) for k, t in enumerate(starts)], "media_id long, side int, s long, e long, x struct<k:int>")
    there, reach = ranges.in_cells(rows, 1, 32, ranges.CELL_MS)
    within = sum(sum(1 for s in starts[i + 1 :] if s < starts[i] + 200) for i in range(3000))
    compared = there.join(reach, ["media_id", "of", "cell"]).count()
    assert ranges.met(rows, 1, 32, ranges.CELL_MS).count() == within <= compared <= within + 2 * 32 * 3000
    assert there.groupBy("cell").count().agg(F.max("count")).head()[0] <= 32


def test_one_long_item_is_many_tasks_work(spark):
    turns = spark.range(20_000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("roll_idx"), F.lit("s").alias("speaker"), (F.col("id") * 500).alias("start_ms"), (F.col("id") * 500 + 2600).alias("end_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = intervals.overlap_pairs(turns).withColumn("task", F.spark_partition_id())
        shares = [r["n"] for r in pairs.groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # a turn overlaps the next two by 2,100 and 1,600 ms
    assert sum(shares) == 2 * 20_000 - 3 and len(shares) > 1 and max(shares) < 0.6 * sum(shares)


def test_empty_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert intervals.overlap_pairs(none).count() == 0
    words = spark.createDataFrame([(1, 0, 5, 9)], "media_id long, word_idx long, start_ms long, end_ms long")
    assert [tuple(r) for r in intervals.speaker_of_words(words, none).collect()] == [(1, 0, 5, 9, None)]
    assert intervals.speaker_of_words(words.limit(0), none).count() == 0


def test_ends_and_starts_are_placed_once_and_nothing_is_joined_to_it(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rolls = spark.createDataFrame([(1, k, 100 * k, 100 * k + 5000, "a") for k in range(50)], "media_id long, roll_idx long, start_ms long, end_ms long, speaker string")
    adaptive, broadcast = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        # a window over each cell's events and one over the cells' summaries, for both sides of the one join
        found = plan(intervals.overlap_pairs(rolls))
        assert found.count("Window [") == 2 and found.count("Join [") == 1 and "ReusedExchange" in found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
