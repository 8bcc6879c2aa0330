"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import map_texts  # noqa: F401

#: The white space that separates words in every contract of this subpackage.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a temporary one only where none is set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="segflow-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there.  With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes the files when
    no plan needs them; without it they stay until the folder is emptied."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (whatever the letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: Spark's Arrow maps look names up unquoted, so that a dot in one would fail."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def whole_row(df: DataFrame):
    """All columns of df as one struct, so that no column that an operator adds can meet one of df's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_hash(df: DataFrame, row: str, by=F.xxhash64):
    """A hash of the columns of df in the struct row (maps have none and are left out)."""
    return by(*[F.col(row).getField(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


#: Stands for a null doc_id.
NO_ID = -(2**63)


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id occurs twice, null and NO_ID counting as one."""
    return not docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).take(1)


def identified(docs: DataFrame, nulls_last: bool = False) -> DataFrame:
    """(doc, copies, doc_id, text): each document of docs (doc_id, text) once, with a number that sorts as its doc_id does and how many rows repeat it.

    A null id sorts first, or last where ids repeat and it is asked for.  Where every id occurs once the number is the id (a null id sorts first).  Else rows of equal id and text are one document, those of equal id and
    different texts are told apart by SHA-256 and ordered by the text's crc32 and SHA-256, and numbers are given out in that order over sorted ranges,
    written once so that a lost task can't deal others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    if unique_ids(rows):
        return rows.select(doc, F.lit(1).alias("copies"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    order = [*[F.col("doc_id").isNull()] * nulls_last, "doc_id", "_crc", "_sha"]
    once = rows.groupBy("doc_id", F.crc32(text).alias("_crc"), F.sha2(text, 256).alias("_sha")).agg(F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))
    return cut(once.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("doc"), "copies", "doc_id", "text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text):
    """Array of the maximal runs of non-white-space in a text column; null and blank give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offset of each row (one more than rows); null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batch, most_bytes: int = 8 << 20, column: str = "text"):
    """Cut an Arrow batch into runs of rows of about most_bytes of text (a longer single text stays whole)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        base = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, base + most_bytes, "right")))
        yield batch.slice(first, end - first)
        first = end


#: Fixed value: odd multiplier of the polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that are hashed together, so that the arrays stay in cache.
STRETCH = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = max(n, STRETCH + 1)
        for k, base in (("p", BASE), ("q", pow(BASE, -1, 2**64))):
            out = np.ones(n, np.uint64)
            done = 1
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
                done += more
            _POWERS[k] = out
    return _POWERS["p"], _POWERS["q"]


def word_spans(body: np.ndarray, offsets: np.ndarray, gaps=(32, 9, 10, 11, 12, 13)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word (run of bytes that are not gaps) of the documents laid end to end in body."""
    is_gap = np.zeros(256, bool)
    is_gap[list(gaps)] = True
    gap = is_gap[body]
    new = np.zeros(len(body) + 1, bool)
    new[offsets[:-1]] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | new[1:-1]
    last[:-1] &= gap[1:] | new[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    # polynomial hash of a word from a running sum: sum(byte * B**i), divided by B**start; a stretch of words at a time
    key, i = np.empty(len(a), np.uint64), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(b, a[i] + STRETCH, "right")))
        low, high = a[i], b[j - 1]
        power, inverse = powers(int(high - low) + 1)
        upto = np.zeros(high - low + 1, np.uint64)
        np.cumsum((body[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=upto[1:])
        key[i:j] = (upto[b[i:j] - low] - upto[a[i:j] - low]) * inverse[a[i:j] - low]
        i = j
    return a, b, mix64(key + (b - a).astype(np.uint64) * np.uint64(BASE))
