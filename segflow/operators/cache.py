"""Results kept under a content key: look up, compute the misses, append them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_json_map(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """SRC11: a JSON object of translations (key to list of speaker and text) per row as (key, translated_pairs); what is no such object gives nothing."""
    entries = F.from_json(raw, "map<string, array<struct<speaker:string, text:string>>>")
    return rows.select(F.explode(entries).alias("key", "translated_pairs")).filter("translated_pairs IS NOT NULL")


def look_up(rows: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """JN9: (hits, misses): rows with the cache's columns, and rows whose key it lacks.  A key kept twice counts once."""
    once = cache.dropDuplicates([key])
    return rows.join(once, key), rows.join(once.select(key), key, "left_anti")


def cached(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(all rows with results, new cache rows).  compute gets each missing key once; rows without a key share what it makes of one of them, which isn't new in the cache."""
    hits, misses = look_up(rows, cache, key)
    fresh = compute(misses.dropDuplicates([key])).select(cache.columns)
    same = misses.alias("m").join(fresh.alias("f"), F.col(f"m.{key}").eqNullSafe(F.col(f"f.{key}")))
    made = same.select("m.*", *[f"f.{c}" for c in cache.columns if c != key])
    return hits.unionByName(made, allowMissingColumns=True), fresh.filter(F.col(key).isNotNull())


def hit_counts(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Hits, misses and distinct missing keys."""
    known = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    seen = rows.join(known, key, "left")
    return seen.agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"), F.count_distinct(F.when(F.col("_hit").isNull(), F.col(key))).alias("new_keys"))


def append(new: DataFrame, path: str, key: str = "key") -> None:
    """SNK9: add new entries to the Parquet cache at path, each key once."""
    new.dropDuplicates([key]).write.mode("append").parquet(path)
