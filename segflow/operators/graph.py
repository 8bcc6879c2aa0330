"""Roots of a parent table by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder_set(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if configured is None:
            import tempfile

            configured = tempfile.mkdtemp(prefix="segflow-")
        sc.setCheckpointDir(configured)


def roots(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of (node, parent), parent null for roots and acyclic: each round doubles the distance that a node looks up."""
    shared_folder_set(nodes)
    now = nodes.select("node", F.coalesce("parent", "node").alias("up")).checkpoint()
    for _ in range(most_rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        after = now.join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")).checkpoint()
        now = after.select("node", "up")
        if not after.filter("moved").take(1):
            return now.select("node", F.col("up").alias("root"))
    raise RuntimeError("parents form a cycle")
