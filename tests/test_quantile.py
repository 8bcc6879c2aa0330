"""Quantiles by sketch and one pass over the bins that decide, against the built-in one."""

import random

import pytest
from pyspark.sql import functions as F

from segflow.operators import frames as fr

FRAMES = "media_id long, frame_idx long, rms double"


def some_frames(seed):
    rng = random.Random(seed)
    rows = [(m, k, rng.choice([0.0, 0.5, rng.random(), rng.random() ** 8, None])) for m in (1, 2, 3) for k in range(rng.randrange(1, 200))]
    return [*rows, (4, 0, 0.25), (5, 0, None), (6, 0, 0.0), (6, 1, 0.0), (7, 0, float("inf")), (7, 1, 1.0), (8, 0, 1e-300), (8, 1, 1e300), (9, 0, -1.0), (9, 1, -2.0), (9, 2, 3.0)]


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.9, 1.0])
def test_quantile_equals_the_built_in_one(spark, q):
    df = spark.createDataFrame(some_frames(int(q * 100)), FRAMES)
    want = {r["media_id"]: r["p"] for r in df.groupBy("media_id").agg(F.percentile("rms", F.lit(q)).alias("p")).collect() if r["p"] is not None}
    got = {r["media_id"]: r["quantile"] for r in fr.quantile(df, q).collect()}
    assert got.keys() == want.keys()
    for m, v in want.items():
        assert got[m] == pytest.approx(v, rel=1e-12), m


def test_merged_sketches_are_the_whole_ones_sketch(spark):
    df = spark.createDataFrame(some_frames(5), FRAMES)
    parts = fr.merge_sketches(fr.quantile_sketch(df.filter("frame_idx % 3 = 0")), fr.quantile_sketch(df.filter("frame_idx % 3 <> 0")))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, fr.quantile_sketch(df).collect()))
    a, b = fr.trailing_silence(df.filter("media_id < 5"), sketch=parts), fr.trailing_silence(df.filter("media_id < 5"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bins_hold_values_within_the_stated_bound(spark):
    df = spark.range(1, 5000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("frame_idx"), (F.col("id") / 777.0).alias("rms"))
    spread = df.groupBy(fr.log_bin(F.col("rms"))).agg((F.max("rms") / F.min("rms")).alias("s")).agg(F.max("s")).head()[0]
    assert spread <= fr.GAMMA + 1e-9


def test_a_null_media_item_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, 0, 2.0), (None, 1, 4.0)], FRAMES)
    assert [tuple(r) for r in fr.quantile(df, 0.5).collect()] == [(None, 3.0)]
    assert fr.quantile(df.limit(0), 0.5).count() == 0 and fr.trailing_silence(df.limit(0)).count() == 0
