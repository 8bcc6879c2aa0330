"""Vector measures on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if sizes differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)


def same_size(vector: Column, size: int) -> Column:
    """The vector if it has the catalogue's size, else null."""
    return F.when(F.size(vector) == size, vector)


def cosine_distances(a, b):
    """Cosine distances of the rows of two matrices; NaN or infinite where a row has no direction."""
    import numpy as np

    norm = lambda m: np.sqrt((m**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - a @ b.T / (norm(a)[:, None] * norm(b)[None, :])


class Vectors:
    """Rows of vectors by their size, as matrices, for products of whole blocks."""

    def __init__(self, vectors: list):
        import numpy as np

        self.rows, self.matrix, self.norm = {}, {}, {}
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None and len(v):
                by.setdefault(len(v), []).append(i)
        for size, rows in by.items():
            self.rows[size] = np.array(rows)
            self.matrix[size] = np.array([vectors[i] for i in rows], np.float64)
            self.norm[size] = np.sqrt((self.matrix[size] ** 2).sum(1))

    def distances(self, other: Vectors):
        """(rows of self, rows of other, cosine distances) for each size that both have; a distance to or from a vector of norm 0 or with a null is infinite."""
        import numpy as np

        for size in self.rows.keys() & other.rows.keys():
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.round(1 - self.matrix[size] @ other.matrix[size].T / (self.norm[size][:, None] * other.norm[size][None, :]), 9)
            yield self.rows[size], other.rows[size], np.where(np.isfinite(d), d, np.inf)
