"""The vector index against brute force, its pruning, and its stored form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.operators import nearest as nn
from segflow.operators import voices as op

VECTORS = "media_id long, speaker string, vec_idx long, embedding array<double>"
VOICES = "voice string, voice_ord long, embedding array<double>"


def brute(vectors, voices):
    out = []
    for media, speaker, idx, v in vectors:
        best = None
        for name, place, c in voices:
            if v is None or c is None or len(v) != len(c) or not v or None in v or None in c:
                continue
            a, b = np.array(v), np.array(c)
            scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if not 0 < scale < np.inf:
                continue
            key = (float(np.round(1 - (a @ b) / scale, 6)), place, name)
            best = key if best is None or key < best else best
        if best is not None:
            out.append((media, speaker, idx, best[2], best[1], best[0]))
    return sorted(out, key=str)


def answer(spark, vectors, voices, pivots=6, block=5, most=4):
    index = nn.voice_index(spark.createDataFrame(voices, VOICES), pivots, block)
    got = nn.nearest(spark.createDataFrame(vectors, VECTORS), index, most).select("media_id", "speaker", "vec_idx", "voice", "voice_ord", F.round("d", 6))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("kind", ["random", "ties", "hot", "sizes"])
def test_nearest_equals_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    # distances are far apart or equal, so that no rounding decides
    if kind == "random":
        voices, vectors = rng.normal(size=(70, 8)), rng.normal(size=(60, 8))
    elif kind == "ties":
        voices, vectors = rng.integers(-1, 2, (70, 3)), rng.integers(-1, 2, (60, 3))
    elif kind == "hot":
        voices, vectors = np.vstack([np.tile([3.0, 4.0, 0.0], (30, 1)), 1 + rng.normal(size=(30, 3)) / 100, rng.normal(size=(10, 3))]), np.vstack([np.tile([3.0, 4.0, 0.5], (30, 1)), rng.normal(size=(30, 3))])
    else:
        voices, vectors = [rng.normal(size=rng.integers(1, 5)) for _ in range(60)], [rng.normal(size=rng.integers(1, 7)) for _ in range(60)]
    place = rng.permutation(len(voices)) // 2
    voices = [(f"v{k}", int(place[k]), [float(x) for x in v]) for k, v in enumerate(voices)]
    vectors = [(k % 3, f"s{k % 2}", k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    assert answer(spark, vectors, voices) == brute(vectors, voices)


def test_vectors_without_a_direction_repeats_and_null_keys(spark):
    nan = float("nan")
    voices = [("a", 1, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("zero", 0, [0.0, 0.0]), ("null", 0, None), ("hole", 0, [1.0, None]), ("nan", 0, [nan, 1.0]), ("late", 9, [1.0, 0.0]), ("twice", 5, [2.0, 0.0]), (None, None, [1.0, 1.0])]
    vectors = [(1, "x", 0, [3.0, 0.1]), (1, "x", 0, [3.0, 0.1]), (None, None, None, [0.0, 2.0]), (1, "y", 1, [1.0, 1.0]), (2, "z", 0, None), (2, "z", 1, []), (2, "z", 2, [0.0, 0.0]), (2, "z", 3, [nan, 1.0]), (2, "z", 4, [1.0, None]), (2, "z", 5, [1.0]), (2, "z", 6, [float("inf"), 1.0])]
    got = answer(spark, vectors, voices)
    assert [r[:5] for r in got] == sorted([(1, "x", 0, "a", 1), (1, "x", 0, "a", 1), (None, None, None, "b", 0), (1, "y", 1, None, None)], key=str)


def test_empty_tables(spark):
    assert answer(spark, [], [("a", 0, [1.0])]) == []
    assert answer(spark, [(1, "x", 0, [1.0])], []) == []
    assert op.nearest_voice(spark.createDataFrame([], VECTORS), spark.createDataFrame([], VOICES)).columns == ["media_id", "speaker", "vec_idx", "voice", "voice_ord", "distance"]


def test_bounds_leave_out_most_of_a_clustered_catalogue(spark):
    """300 voices around 12 directions, asked by 120 vectors near them: cells of other directions are not asked."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    near = lambda n: [[float(x) for x in centres[k % 12] + rng.normal(size=16) / 50] for k in range(n)]
    voices = [(f"v{k}", k, v) for k, v in enumerate(near(300))]
    vectors = [(1, "s", k, v) for k, v in enumerate(near(120))]
    index = nn.voice_index(spark.createDataFrame(voices, VOICES), 64, 50).cache()
    pivots = nn.pivots_of(index)
    assert len(pivots) <= 18
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.sum(F.size("members")).alias("n")).collect()}
    assert sum(sizes.values()) == 300
    own = nn.own_cells(spark.createDataFrame(vectors, VECTORS), pivots).cache()
    first = nn.best_of(nn.best_in_cells(own, index, 40))
    others = nn.other_cells(first.drop("voice", "voice_ord"), pivots)
    looked = sum(sizes[r["cell"]] for r in own.select("cell").collect()) + sum(sizes[r["cell"]] for r in others.select("cell").collect())
    assert looked < 0.35 * 300 * 120
    assert answer(spark, vectors, voices, 64, 50, 40) == brute(vectors, voices)


def test_a_stored_index_gives_the_same(spark, tmp_path):
    rng = np.random.default_rng(8)
    voices = [(f"v{k}", k, [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    vectors = [(1, "s", k, [float(x) for x in rng.normal(size=4)]) for k in range(30)]
    nn.voice_index(spark.createDataFrame(voices, VOICES), 5, 4).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.agg(F.max(F.size("members"))).head()[0] < 40
    got = nn.nearest(spark.createDataFrame(vectors, VECTORS), index, 8)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == [r[:5] for r in brute(vectors, voices)]
