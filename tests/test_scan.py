"""Running values over cells against plain loops, and one long item over many tasks."""

import random

import pytest
from pyspark.sql import functions as F
from segflow.operators import intervals, packing, timeline
from segflow.operators.scan import scan


def some_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, rng.randrange(-50, 3000)]) if i % 40 == 0 else rng.randrange(-50, 3000), i, rng.choice([None, 1, 5, -3])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 700])
def test_scan_equals_the_loop(spark, width):
    rows = some_rows(width)
    df = spark.createDataFrame(rows, "k long, t long, i int, v long")
    got = scan(df, ["k"], ["t", "i"], width, {"total": F.col("v")}, {"latest": F.col("v")}, {"before": F.col("v")})
    want = []
    for key in (1, 2, None):
        total = latest = before = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total = total if r[3] is None else (total or 0) + r[3]
            latest = latest if r[3] is None else r[3]
            want.append((*r, total, latest, before))
            before = r[3]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_peers_share_a_sum(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 10, 2), (1, 10, 4), (1, 11, 1)], "k long, t long, v long")
    got = scan(df, ["k"], ["t"], 10, {"total": F.col("v")})
    assert sorted((r["t"], r["v"], r["total"]) for r in got.collect()) == [(0, 5, 5), (10, 2, 11), (10, 4, 11), (11, 1, 12)]


def test_empty_table_and_names_in_use(spark):
    df = spark.createDataFrame([], "k long, t long, v long")
    assert scan(df, ["k"], ["t"], 10, {"total": F.col("v")}).columns == ["k", "t", "v", "total"]
    assert scan(df, ["k"], ["t"], 10, {"v": F.col("v")}).count() == 0


def rolls(spark, seed, n=300):
    rng, t, out = random.Random(seed), 0, []
    for m in (1, 2, 3):
        t = 0
        for i in range(n if m < 3 else 1):
            t += rng.choice([0, 0, 200, 900, 4000])
            out.append((m, rng.choice("ab"), rng.randrange(3), i, t, t + rng.choice([0, 300, 2500]), rng.choice([None, 0, 700])))
    return spark.createDataFrame(out, "media_id long, speaker string, grp int, seg_idx int, start_ms long, end_ms long, spoken_ms long")


@pytest.mark.parametrize("cell", [1000])
def test_operators_do_not_depend_on_cells(spark, cell):
    r = rolls(spark, cell)
    whole = 10**12
    same = lambda f: sorted(map(tuple, f(cell).collect()), key=str) == sorted(map(tuple, f(whole).collect()), key=str)
    assert same(lambda c: intervals.merge_turns(r.withColumnRenamed("seg_idx", "roll_idx"), cell_ms=c))
    assert same(lambda c: intervals.pause_removals(r.dropDuplicates(["media_id", "start_ms"]), 500, cell_ms=c))
    assert same(lambda c: timeline.place_in_groups(r, cell_ms=c))
    cuts = intervals.pause_removals(r.dropDuplicates(["media_id", "start_ms"]), 500, cell_ms=whole)
    assert same(lambda c: intervals.retime(r, cuts, cell_ms=c))
    sentences = r.select("media_id", F.col("seg_idx").alias("sent_idx"), (F.col("seg_idx") % 4).alias("n_words"), F.col("speaker").alias("text"))
    tokens = r.select("media_id", F.col("seg_idx").alias("tok_idx"), "start_ms", "end_ms")
    assert same(lambda c: packing.align_sentences(sentences, tokens, c))


def test_merged_turns_equal_the_loop(spark):
    r = rolls(spark, 5)
    want, last = [], None
    for x in sorted(r.collect(), key=lambda x: (x["media_id"], x["start_ms"], x["seg_idx"])):
        if last and last["media_id"] == x["media_id"] and last["speaker"] == x["speaker"] and x["start_ms"] - last["end_ms"] <= 300:
            want[-1] = (*want[-1][:3], x["end_ms"], want[-1][4] + 1)
        else:
            want.append((x["media_id"], x["speaker"], x["start_ms"], x["end_ms"], 1))
        last = x
    got = intervals.merge_turns(r.withColumnRenamed("seg_idx", "roll_idx"), cell_ms=1500).orderBy("media_id", "turn_idx").collect()
    assert [(g["media_id"], g["speaker"], g["start_ms"], g["end_ms"], g["n_turns"]) for g in got] == want


def test_one_long_item_is_many_tasks_work(spark):
    rows = spark.range(40_000).select(F.lit(7).cast("long").alias("media_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.pause_removals(rows, 100).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in got.groupBy("task").count().collect()]
        assert got.agg(F.max("cumulative_ms")).first()[0] == 40_000 * 800
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(tasks) == 40_000 and len(tasks) == 4 and max(tasks) < 20_000
