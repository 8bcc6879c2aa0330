"""Groups by composed jump tables against the plain loop over each item."""

import random

import pytest
from pyspark.sql import functions as F
from segflow.operators import jumps, packing


def plain(rows, step):
    """Group number of each (media, index, *values), in order."""
    out, last, state, n = [], None, None, -1
    for row in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        if row[0] != last:
            last, state, n = row[0], None, -1
        new, state = step(state, *row[2:])
        n += bool(new)
        out.append((*row[:2], n))
    return out


def chunk_step(state, speaker):
    if state is None:
        return True, (1, 0, speaker)
    n, switches, before = state
    switches += before is not None and speaker is not None and before != speaker
    new = n >= 10 or switches > 3
    return new, (1, 0, speaker) if new else (n + 1, switches, speaker)


def sum_step(state, dur):
    total = dur if state is None else None if state[0] is None or dur is None else state[0] + dur
    new = state is None or (total is not None and total > 100)
    return new, (dur if new else total,)


@pytest.mark.parametrize("seed", range(30))
def test_tables_carry_like_the_loop(seed):
    rng = random.Random(seed)
    step = rng.choice([chunk_step, sum_step])
    some = lambda: (rng.choice(["a", "b", None] if step is chunk_step else [1, 5, 30, 99, 150] + [None] * (seed % 5 == 0)),)
    values = [some() for _ in range(rng.randrange(1, 300))]
    state, n, at = None, 0, 0
    want, groups = None, 0
    while at < len(values):
        block = values[at : at + rng.randrange(1, 60)]
        state, more = jumps.after_block(state, *jumps.jump_table(block, step), step)
        n += more
        for v in block:
            new, want = step(want, *v)
            groups += bool(new)
        assert (state, n) == (want, groups)
        at += len(block)


@pytest.mark.parametrize("block_rows", [1, 7, 64, 4096])
def test_long_items_equal_the_stream(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(m, k, rng.choice("abc")) for m, n in ((1, 900), (2, 3), (3, 64), (4, 1)) for k in range(5 * (m == 2), n + 5 * (m == 2))]
    got = packing.translation_chunks(spark.createDataFrame(rows, "media_id long, seg_idx int, speaker string"), block_rows=block_rows)
    assert sorted((r["media_id"], r["seg_idx"], r["chunk_idx"]) for r in got.collect()) == sorted(plain(rows, chunk_step))


def test_one_long_item_is_many_tasks_work(spark):
    rows = spark.range(60_000).select(F.lit(7).cast("long").alias("media_id"), F.col("id").cast("int").alias("seg_idx"), F.concat(F.lit("s"), (F.col("id") * 7919 % 11 % 3).cast("string")).alias("speaker"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.translation_chunks(rows).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in got.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(tasks) == 60_000 and len(tasks) == 4 and max(tasks) < 40_000
    want = plain([(7, k, f"s{k * 7919 % 11 % 3}") for k in range(60_000)], chunk_step)
    assert sorted((r["media_id"], r["seg_idx"], r["chunk_idx"]) for r in got.collect()) == want


@pytest.mark.parametrize("block_rows", [2, 50, 4096])
def test_block_chunks_of_long_items(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(m, k if k else None, rng.choice([1, 10, 45, 120, None] if m == 3 else [1, 10, 45, 120])) for m, n in ((1, 400), (2, 60), (3, 200)) for k in range(n)]
    got = packing.block_chunks(spark.createDataFrame(rows, "media_id long, block_idx int, dur_ms long"), 100, 0, block_rows)
    want = {}
    for (m, _, g), (*_, dur) in zip(plain(rows, sum_step), sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)), strict=True):
        n, total = want.get((m, g), (0, None))
        want[m, g] = (n + 1, total if dur is None else dur + (total or 0))
    assert {(r["media_id"], r["chunk_idx"]): (r["n_blocks"], r["dur_ms"]) for r in got.collect()} == want
