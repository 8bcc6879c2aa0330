"""A store of results by key: Parquet in hash buckets, added to in batches, compacted into generations.

    path/g<generation>-b<buckets>/store_batch=<id>/store_bucket=<n>/*.parquet

A batch, and a generation by its first batch, is there once its _SUCCESS file is: what a lost job left behind is never read, and is overwritten when the job runs
again.  One writer at a time; readers go on with the generation they began with until vacuum() removes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .graph import shared_folder_set

BATCH, BUCKET, BASE = "store_batch", "store_bucket", "base"


class KeyStore:
    """Rows of a schema, one per value of the string column key; null is no key and is not kept."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "key", buckets: int = 64):
        if {BATCH, BUCKET} & {f.name.lower() for f in schema.fields}:
            raise ValueError(f"{BATCH} and {BUCKET} are columns of the store itself")
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._folder(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _whole(self, path: str) -> bool:
        return "_SUCCESS" in self._names(path)

    def generation(self) -> tuple[int, int]:
        """(number, buckets) of the generation in use; the first one needs no base."""
        found = sorted((int(m[1]), int(m[2])) for m in (re.fullmatch(r"g(\d+)-b(\d+)", n) for n in self._names(self.path)) if m)
        return next((g for g in reversed(found) if g[0] == 0 or self._whole(f"{self._at(g)}/{BATCH}={BASE}")), (0, self.buckets))

    def _at(self, generation: tuple[int, int]) -> str:
        return f"{self.path}/g{generation[0]}-b{generation[1]}"

    def batches(self) -> list[str]:
        """Ids of the batches that are there."""
        at = self._at(self.generation())
        ids = [n.removeprefix(f"{BATCH}=") for n in self._names(at) if n.startswith(f"{BATCH}=")]
        return sorted(i for i in ids if self._whole(f"{at}/{BATCH}={i}"))

    def bucket_of(self, key: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.generation()[1])).cast("int")

    def _rows(self) -> DataFrame:
        at, fields = self._at(self.generation()), [*self.schema.fields, StructField(BATCH, StringType()), StructField(BUCKET, IntegerType())]
        paths = [f"{at}/{BATCH}={i}" for i in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], StructType(fields))
        return self.spark.read.schema(StructType(fields)).option("basePath", at).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows."""
        return self._rows().select(self.schema.names)

    def near(self, rows: DataFrame) -> DataFrame:
        """The store's rows of all buckets that keys of rows fall into: others aren't opened.  At most one number per bucket reaches the driver."""
        hit = rows.filter(F.col(self.key).isNotNull()).select(self.bucket_of(F.col(self.key)).alias("b")).distinct().collect()
        return self._rows().filter(F.col(BUCKET).isin([r["b"] for r in hit])).select(self.schema.names)

    def get(self, *keys: str) -> DataFrame:
        """Rows of a few given keys; beside the buckets, Parquet's Bloom filters tell which files hold none of them."""
        buckets = self.bucket_of(F.col(self.key))
        at = [r["b"] for r in self.spark.createDataFrame([(k,) for k in keys], StructType([StructField(self.key, StringType())])).select(buckets.alias("b")).distinct().collect()] if keys else []
        return self._rows().filter(F.col(BUCKET).isin(at) & F.col(self.key).isin(list(keys))).select(self.schema.names)

    def look_up(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """JN9: (hits, misses): rows with the store's columns, and rows whose key it lacks."""
        known = self.near(rows)
        return rows.join(known, self.key), rows.join(known.select(self.key), self.key, "left_anti")

    def append(self, new: DataFrame, batch: str) -> bool:
        """SNK9: add rows of keys that are new, each key once, as the batch of this id.  A batch that is there already is left alone (False)."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch == BASE:
            raise ValueError(f"a batch id is made of letters, digits, dot, underscore and hyphen, and isn't {BASE!r}: {batch!r}")
        if batch in self.batches():
            return False
        shared_folder_set(new)
        # a model may stand behind the rows: they are made once, though their buckets are asked for before they are written
        rows = new.select(self.schema.names).filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]).checkpoint()
        self._write(self.look_up(rows)[1].select(self.schema.names), self.generation(), batch)
        return True

    def _write(self, rows: DataFrame, generation: tuple[int, int], batch: str) -> None:
        # one file per bucket, in order of keys, so that statistics tell pages apart
        dealt = rows.withColumn(BUCKET, self.bucket_of(F.col(self.key), generation[1])).repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        dealt.write.mode("overwrite").options(**bloom, partitionOverwriteMode="static").partitionBy(BUCKET).parquet(f"{self._at(generation)}/{BATCH}={batch}")

    def compact(self, buckets: int | None = None) -> None:
        """All batches as the base of a new generation, with another number of buckets if given."""
        first = F.struct((F.col(BATCH) != BASE).alias("later"), BATCH)
        once = self._rows().groupBy(self.key).agg(F.min_by(F.struct(*self.schema.names), first).alias("r")).select("r.*")
        number, now = self.generation()
        # what an unfinished compaction left under this number may have other buckets, and is no generation
        self._write(once, (number + 1, buckets or now), BASE)

    def vacuum(self) -> None:
        """Remove the generations before the one in use."""
        number = self.generation()[0]
        for name in self._names(self.path):
            m = re.fullmatch(r"g(\d+)-b(\d+)", name)
            if m and int(m[1]) < number:
                fs, p = self._folder(f"{self.path}/{name}")
                fs.delete(p, True)

    def remove(self) -> None:
        fs, p = self._folder(self.path)
        fs.delete(p, True)

    def cached(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
        """rows with results: compute gets each missing key once, its rows are appended as the batch, and all rows look their results up.

        Keys for which compute has no row, or null, have no result.  The batch's id belongs to these rows: run again with it, nothing is computed.
        """
        if batch in self.batches():
            return self.look_up(rows)[0]
        self.append(compute(self.look_up(rows.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]))[1]), batch)
        return self.look_up(rows)[0]
