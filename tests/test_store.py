"""The key store: look-ups open few files, repeated and broken batches add nothing, compaction keeps what is there."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from segflow.operators.store import KeyStore

SCHEMA = StructType([StructField("key", StringType()), StructField("result", StringType())])


def rows(spark, lo, hi, mark="r"):
    return spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit(mark), "id").alias("result"))


def content(df):
    return sorted(map(tuple, df.collect()))


def files_read(df):
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if p.metrics().contains("numFiles"):
            n += p.metrics().apply("numFiles").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_appends_look_ups_and_compaction(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    assert content(store.read()) == [] and store.batches() == []
    assert store.append(rows(spark, 0, 60), "one")
    assert store.append(rows(spark, 40, 90, "later").unionByName(rows(spark, 40, 90, "later")).unionByName(spark.createDataFrame([(None, "x")], SCHEMA)), "two")
    want = content(rows(spark, 0, 60).unionByName(rows(spark, 60, 90, "later")))
    assert content(store.read()) == want
    # the same batch again, and the same rows under another id
    assert not store.append(rows(spark, 0, 500), "one")
    assert store.append(rows(spark, 0, 90), "three") and content(store.read()) == want
    store.compact(buckets=3)
    assert store.generation() == (1, 3) and store.batches() == ["base"] and content(store.read()) == want
    assert store.append(rows(spark, 80, 95, "new"), "two")
    want = sorted(want + content(rows(spark, 90, 95, "new")))
    assert content(store.read()) == want
    store.vacuum()
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["g1-b3"] and content(store.read()) == want
    asked = spark.createDataFrame([("k1",), ("k1",), ("no",), (None,)], "key string")
    hits, misses = store.look_up(asked)
    assert content(hits) == [("k1", "r1"), ("k1", "r1")] and sorted(map(tuple, misses.collect()), key=str) == [("no",), (None,)]
    assert content(store.get("k93", "no")) == [("k93", "new93")] and content(store.get()) == []


def test_few_keys_open_few_files(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), SCHEMA, buckets=32)
    store.append(rows(spark, 0, 5000), "one")
    assert files_read(store.read()) == 32
    assert files_read(store.near(spark.createDataFrame([("k1",), ("k2",)], "key string"))) <= 2
    assert files_read(store.get("k7")) == 1
    assert files_read(store.near(spark.createDataFrame([], "key string"))) == 0


def test_what_a_lost_job_left_is_not_read(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.append(rows(spark, 0, 10), "one")
    store.append(rows(spark, 10, 20), "two")
    (tmp_path / "s" / "g0-b4" / "store_batch=two" / "_SUCCESS").unlink()
    assert store.batches() == ["one"] and content(store.read()) == content(rows(spark, 0, 10))
    assert store.append(rows(spark, 10, 15), "two") and content(store.read()) == content(rows(spark, 0, 15))
    store.compact()
    (tmp_path / "s" / "g1-b4" / "store_batch=base" / "_SUCCESS").unlink()
    assert store.generation() == (0, 4) and content(store.read()) == content(rows(spark, 0, 15))
    store.compact()
    assert store.generation() == (1, 4) and content(store.read()) == content(rows(spark, 0, 15))


def test_cached_computes_each_missing_key_once(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.append(spark.createDataFrame([("a", "A")], SCHEMA), "one")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "key string, n int")
    calls = spark.sparkContext.accumulator(0)

    def compute(missing):
        def model(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return missing.select("key", F.upper("key").alias("result")).mapInArrow(model, "key string, result string")

    assert content(store.cached(asked, compute, "two").select("n", "key", "result")) == [(1, "a", "A"), (2, "b", "B"), (3, "b", "B"), (4, "c", "C")]
    assert calls.value == 2
    assert content(store.cached(asked, compute, "two").select("n")) == [(1,), (2,), (3,), (4,)] and calls.value == 2


def test_names_that_clash_or_leave_the_folder(spark, tmp_path):
    with pytest.raises(ValueError):
        KeyStore(spark, str(tmp_path), StructType([StructField("Store_Bucket", StringType())]))
    store = KeyStore(spark, str(tmp_path), SCHEMA)
    for bad in ("", "base", "../x", "a b"):
        with pytest.raises(ValueError):
            store.append(rows(spark, 0, 1), bad)
