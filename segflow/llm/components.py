"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step only takes minima per vertex (combined before the shuffle) and joins them back (splittable when skewed), so a
vertex with very many neighbours is never gathered in one place.  The two-phase form of this algorithm needs at most about log(n) squared
rounds, the alternating one about log(n) in practice; a run of more than most_rounds raises instead of returning an unfinished result.

Nulls: edges with a null end are not allowed.  Repeated edges and loops change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts


def local_forest(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by edges to the smallest vertex they connect to there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(p, p)
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(u), root(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for i in range(0, len(pairs), 100_000):
            part = np.array(pairs[i : i + 100_000], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])

    return map_texts(edges, run, "u long, v long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each vertex's larger (large) or its not larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u, v): every vertex u that is not the least of its component, with that least vertex v."""
    now = cut(local_forest(edges.select("u", "v")).distinct())
    for _ in range(most_rounds):
        # done when every vertex has one edge and no parent is itself a child
        loose = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").limit(1).unionByName(now.select(F.col("v").alias("u")).distinct().join(now.select("u").distinct(), "u", "left_semi").limit(1))
        if not loose.take(1):
            return now
        now = cut(star(star(now, True), False))
    raise RuntimeError("components did not settle")
