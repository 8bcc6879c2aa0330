"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

PIECE_BYTES = 1 << 20


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches bounded by bytes: texts and packed columns differ too much in length for a bound on rows.

    The bound is a session setting, read when the plan runs, so it stays set; one that the user has chosen is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = rows.sparkSession.conf
    if conf.get(key, "64m").rstrip("b") in ("67108864", "64m"):
        conf.set(key, "4m")
    return rows.mapInArrow(run, schema)


def pieces(batches: Iterator, most_bytes: int = PIECE_BYTES) -> Iterator:
    """batches in slices of about most_bytes, a row at least, whatever bound the session has."""
    for b in batches:
        rows = max(1, b.num_rows * most_bytes // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
