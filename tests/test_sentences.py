"""Sentences aligned with word tokens: against a plain loop, over long items, and in little memory."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from segflow.operators import packing
from segflow.operators.scan import scan


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_alignment_equals_the_loop(spark, cell):
    words = {1: [2, 0, 7, 1, 0], 2: [3, 4, 5], 3: [1, 1], 4: [0, None], None: [2, 1]}
    n_tokens = {1: 14, 2: 5, 3: 0, 4: 3, None: 3}  # more than the words, fewer, none
    sentences = [(m, k, n, f"{m}.{k}") for m, ns in words.items() for k, n in enumerate(ns)]
    tokens = [(m, i, 100 * i, 100 * i + 60) for m, n in n_tokens.items() for i in range(n)]
    want = set()
    for m, ns in words.items():
        at = 0
        for k, n in enumerate(ns):
            took = range(at, min(at + (n or 0), n_tokens[m]))
            at += n or 0
            if took:
                want.add((m, k, f"{m}.{k}", 100 * took[0], 100 * took[-1] + 60, len(took)))
    got = packing.align_sentences(spark.createDataFrame(sentences, "media_id long, sent_idx int, n_words int, text string"), spark.createDataFrame(tokens, "media_id long, tok_idx long, start_ms long, end_ms long"), cell)
    rows = [tuple(r) for r in got.select("media_id", "sent_idx", "text", "start_ms", "end_ms", "n_tokens").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_a_long_item_that_lies_by_item_is_many_tasks_work(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("t")).repartition("k")
        tasks = [r["count"] for r in scan(rows, ["k"], ["t"], 1000, {"n": F.lit(1)}).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(tasks) == 40_000 and len(tasks) == 4 and max(tasks) < 20_000


LITTLE = """
import sys
from pyspark.sql import SparkSession, functions as F
from segflow.plans.queries import QUERIES

conf = {"spark.testing.memory": 48 << 20, "spark.testing.reservedMemory": 0, "spark.buffer.pageSize": "4m", "spark.sql.shuffle.partitions": sys.argv[2], "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.repeat(F.lit("word "), 39), F.lit("last."))))
spark.range(1000).select(F.col("id").alias("conv_id"), F.lit(0).cast("int").alias("turn"), F.lit("user").alias("role"), text.alias("text")).write.parquet(sys.argv[1] + "/conversations.parquet")
print(QUERIES["jn5_align_sentences"](spark, sys.argv[1]).agg(F.count("*"), F.sum("n_tokens"), F.sum(F.length("text"))).first()[:])
"""


@pytest.mark.parametrize("partitions", [1, 201])
def test_alignment_needs_little_memory(tmp_path, partitions):
    """400,000 tokens in one task with 28 MB for sorts, which take 4 MB at a time.  Over 200 partitions Spark sorts what it writes, too."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent), "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    run = subprocess.run([sys.executable, "-c", LITTLE, str(tmp_path), str(partitions)], env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip() == "(10000, 400000, 2000000)", run.stderr[-2000:]
