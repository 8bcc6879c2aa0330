"""Nearest vector of a catalogue, exactly, by an index of cells around pivots with bounds by the triangle inequality.

An index is a table (cell, pivot, radius, block, members) that can be written and read back.  Distances are cosine distances rounded to nine decimals, and chords
between unit vectors obey the triangle inequality: a voice of a cell is no nearer than the chord to the pivot less the cell's radius, and, as its own pivot is the
nearest of all, no nearer than half of what the vector's chord to that pivot is longer than its shortest.  Each vector asks its own cell first and then those that
can hold something as near.  Where the bounds can't tell cells apart, all are asked: the answer is exact in any case.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.vectors import cosine_distances
from .graph import shared_folder_set

# chords of equal vectors differ from 0 by about 3e-8 in double precision, rounded distances from true ones by 5e-10
CHORD_SLACK, DISTANCE_SLACK = 1e-6, 1e-8
OUT_BYTES = 32 * 1024 * 1024
KEYS = ["media_id", "speaker", "vec_idx"]


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null, NaN or infinite element and a norm above 0."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return (total > 0) & (total < F.lit(float("inf")))


def by_size(column):
    """(size, rows, matrix) for each size in an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Pivots:
    """Pivots by their size, from rows (cell, pivot, radius)."""

    def __init__(self, rows: list):
        import numpy as np

        self.cells, self.matrix, self.radius = {}, {}, {}
        for size in {len(p) for _, p, _ in rows}:
            mine = [(c, p, r) for c, p, r in rows if len(p) == size]
            self.cells[size] = np.array([c for c, _, _ in mine], np.int64)
            self.matrix[size] = np.array([p for _, p, _ in mine], np.float64)
            self.radius[size] = np.array([r for _, _, r in mine], np.float64)

    def chords(self, size: int, m):
        import numpy as np

        return np.sqrt(2 * np.maximum(cosine_distances(m, self.matrix[size]), 0))

    def nearest(self, size: int, m):
        """Cells and chords of the nearest pivots; vectors of a size without a pivot go to the cell -size."""
        if size not in self.cells:
            return -size, 0.0
        chords = self.chords(size, m)
        return self.cells[size][chords.argmin(1)], chords.min(1)


def in_cells(rows: DataFrame, pivots: list) -> DataFrame:
    """rows with a column v of vectors, and the cell and chord of its nearest pivot."""
    at, names = rows.columns.index("v"), [*rows.columns, "cell", "chord"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Pivots(pivots)
        for b in batches:
            cell, chord = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for size, mine, m in by_size(b.column(at)):
                cell[mine], chord[mine] = known.nearest(size, m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(chord)], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", LongType()), StructField("chord", DoubleType())]))


def dealt(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """rows with block: each cell's rows dealt by hash of key into blocks of about `most`."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("_blocks"))
    return rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(*key), F.col("_blocks")).cast("int")).drop("_blocks")


def voice_index(voices: DataFrame, most_pivots: int = 1024, block: int = 2048) -> DataFrame:
    """The index of voices (voice, voice_ord, embedding): cell, pivot, radius, block, members (voice_ord, voice, v), in blocks of about `block` voices.

    Pivots are about the square root of the voices, `most_pivots` at most, taken by hash; they and their cells' radii are all that reaches the driver.  Of voices
    with one vector the first in catalogue order stays, as no other can win.  Vectors without a direction are in no cell.
    """
    rows = voices.select(F.col("voice_ord").cast("long").alias("voice_ord"), "voice", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    rows = rows.groupBy("v").agg(F.min(F.struct("voice_ord", "voice")).alias("first")).select("v", "first.*")
    n = rows.count()
    chosen = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(min(most_pivots, isqrt(n) + 1)).collect()
    pivots = [(k, list(r["v"]), 0.0) for k, r in enumerate(chosen)]
    members = dealt(in_cells(rows, pivots), block, "v")
    blocks = members.groupBy("cell", "block").agg(F.max("chord").alias("radius"), F.sort_array(F.collect_list(F.struct("voice_ord", "voice", "v"))).alias("members"))
    named = voices.sparkSession.createDataFrame([p[:2] for p in pivots], "cell long, pivot array<double>")
    return blocks.join(named, "cell", "left").select("cell", "pivot", "radius", "block", "members")


def pivots_of(index: DataFrame) -> list:
    return [tuple(r) for r in index.filter("cell >= 0").groupBy("cell").agg(F.first("pivot"), F.max("radius")).collect()]


def other_cells(found: DataFrame, pivots: list) -> DataFrame:
    """found (with v, the cell own and the distance d found there) once for each other cell that can hold a voice as near."""
    at, own, d, names = *(found.columns.index(c) for c in ("v", "own", "d")), [*found.columns, "cell"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Pivots(pivots)
        for b in batches:
            mine, best = b.column(own).to_numpy(), b.column(d).to_numpy()
            for size, rows, m in by_size(b.column(at)):
                if size not in known.cells:
                    continue
                chords = known.chords(size, m)
                least = np.maximum(chords - known.radius[size][None, :], (chords - chords.min(1)[:, None]) / 2)
                ask = (least - CHORD_SLACK <= np.sqrt(2 * (best[rows] + DISTANCE_SLACK))[:, None]) & (known.cells[size][None, :] != mine[rows][:, None])
                i, k = np.nonzero(ask)
                step = max(1, OUT_BYTES // (8 * size))
                for lo in range(0, len(i), step):
                    part = b.take(pa.array(rows[i[lo : lo + step]]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(known.cells[size][k[lo : lo + step]])], names)

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("cell", LongType())]))


def best_in_cells(asked: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """asked (keys, n, v, own, cell) with the best voice of the cells asked: d, voice_ord, voice.

    Vectors are packed by cell, and each pack meets each block of the cell in a matrix product of its own.
    """
    packs = dealt(asked, most, *KEYS, "v").withColumnRenamed("block", "pack").groupBy("cell", "pack").agg(F.collect_list(F.struct(*KEYS, "n", "own", "v")).alias("asked"))
    tasks = packs.join(index.select("cell", "block"), "cell").join(index.select("cell", "block", "members"), ["cell", "block"]).select("asked", "members")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def vectors(rows):
            return rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for b in batches:
            for asked, members in zip(b.column(0), b.column(1), strict=True):
                rows, names = asked.values, members.values
                d = np.round(cosine_distances(vectors(rows), vectors(names)), 9)
                at = d.argmin(1)
                told = [rows.field(c) for c in (*KEYS, "n", "own", "v")]
                yield pa.RecordBatch.from_arrays([*told, pa.array(d[np.arange(len(at)), at]), names.field("voice_ord").take(pa.array(at)), names.field("voice").take(pa.array(at))], [*KEYS, "n", "own", "v", "d", "voice_ord", "voice"])

    return tasks.mapInArrow(run, "media_id long, speaker string, vec_idx long, n long, own long, v array<double>, d double, voice_ord long, voice string")


def best_of(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEYS, "n", "own", "v").agg(F.min(F.struct("d", "voice_ord", "voice")).alias("b")).select(*KEYS, "n", "own", "v", "b.*")


def own_cells(vectors: DataFrame, pivots: list) -> DataFrame:
    """Vectors (media_id, speaker, vec_idx, embedding) that have a direction, equal rows once with their number n, in the cell of their nearest pivot."""
    rows = vectors.select(F.col("media_id").cast("long").alias("media_id"), "speaker", F.col("vec_idx").cast("long").alias("vec_idx"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    return in_cells(rows.groupBy(*KEYS, "v").agg(F.count("*").alias("n")), pivots).withColumn("own", F.col("cell")).drop("chord")


def nearest(vectors: DataFrame, index: DataFrame, most: int = 1024) -> DataFrame:
    """vectors (media_id, speaker, vec_idx, embedding) with their nearest voice of the index: voice, voice_ord, d; ties by catalogue order.

    Repeated rows come back as often.  Vectors without a direction, or of a size that no voice has, have no row.
    """
    shared_folder_set(vectors)
    pivots = pivots_of(index)
    first = best_of(best_in_cells(own_cells(vectors, pivots), index, most)).checkpoint()
    more = other_cells(first.drop("voice", "voice_ord"), pivots).drop("d")
    best = best_of(first.unionByName(best_in_cells(more, index, most)))
    return best.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*KEYS, "voice", "voice_ord", "d")
