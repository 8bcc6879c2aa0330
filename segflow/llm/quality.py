"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes.  Every passage is encoded from its own bytes (shares of byte classes and of
hashed byte pairs, word length, immediate word repetition); a small network turns that into a vector h, gated attention
weights a = softmax(w . (tanh(V h) * sigmoid(U h))) are learned from document labels alone, and the score is the logistic
of the weighted passage vector sum(a * h).  Training runs on a bounded sample of labelled rows (rows and bytes per row
are parameters); scoring covers all passages of all documents.

Nulls: a null or empty text is one empty passage and gets a score like any other; null labels are left out of the fit.
Without any label, or with one class only, the score is that class's share (0.5 if none).  Repeated rows score alike; of ties in the fit's order the row whose id, then
text hash is least goes first.  A text of any length is scored whole.  Empty tables give empty results.  Extra columns pass by unused, whatever their names; one
named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, numbered, slices, utf8, word_spans

PASSAGE, PAIRS = 512, 64


def byte_classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, white space, UTF-8 lead and tail bytes, and single marks."""
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[9, 11, 12, 13, 32]] = 4
    table[10] = 5
    table[128:192] = 6
    table[192:] = 7
    for k, c in enumerate("!|#$%&*.,;:'\"-<>/@_()=+"):
        table[ord(c)] = 8 + k
    return table


CLASSES = 32
WIDTH = CLASSES + PAIRS + 4


def encode(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the document each belongs to."""
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-size // PASSAGE))
    owner = np.repeat(np.arange(len(size)), pieces)
    first = np.cumsum(pieces) - pieces
    place = np.arange(len(body)) - np.repeat(offsets[:-1], size)
    of = np.repeat(first, size) + place // PASSAGE
    n = len(owner)
    length = np.maximum(1, np.bincount(of, minlength=n))
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :CLASSES] = np.bincount(of * CLASSES + byte_classes()[body], minlength=n * CLASSES).reshape(n, CLASSES) / length[:, None]
    if len(body) > 1:
        pair = (body[:-1].astype(np.uint32) * np.uint32(2654435) + body[1:].astype(np.uint32) * np.uint32(40503)) >> np.uint32(7) & np.uint32(PAIRS - 1)
        inside = place[1:] > 0  # no pair reaches into the next document
        out[:, CLASSES : CLASSES + PAIRS] = np.bincount(of[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS) / length[:, None]
    a, b, key = word_spans(body, offsets)
    at = of[a] if len(a) else np.zeros(0, np.int64)
    words = np.maximum(1, np.bincount(at, minlength=n))
    same = np.zeros(len(a), bool)
    same[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1])
    extra = out[:, CLASSES + PAIRS :]
    extra[:, 0] = np.bincount(at, weights=same, minlength=n) / words
    extra[:, 1] = np.bincount(at, weights=b - a, minlength=n) / words / 10
    extra[:, 2] = words / length * 5
    extra[:, 3] = np.minimum(1, length / PASSAGE)
    return out, owner


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder (W, b), gated attention (V, U, w) and output (c, d) in plain numpy."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros((), np.float32)}
        self.constant: float | None = None

    @classmethod
    def restore(cls, state: dict) -> Model:
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def forward(self, x, owner, n):
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        start = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, start)[owner])
        a = e / np.add.reduceat(e, start)[owner]
        z = np.add.reduceat(a[:, None] * h, start)
        return h, t, g, a, z, sigmoid(z @ p["c"] + p["d"])

    def score(self, x, owner, n):
        return np.full(n, self.constant) if self.constant is not None else self.forward(x, owner, n)[-1].astype(float)

    def attention(self, x, owner, n):
        """Weight of each passage within its document."""
        return self.forward(x, owner, n)[3]

    def gradients(self, x, owner, y):
        p, n = self.p, len(y)
        h, t, g, a, z, s = self.forward(x, owner, n)
        out = (s - y) / n
        dz = out[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        start = np.searchsorted(owner, np.arange(n))
        de = a * (da - np.add.reduceat(a * da, start)[owner])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum()}

    def fit(self, x, owner, y, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
        """Adam on the logistic loss; owner is sorted and numbers the documents of y."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        start = np.searchsorted(owner, np.arange(len(y) + 1))
        for _ in range(epochs):
            for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                size = start[docs + 1] - start[docs]
                own = np.repeat(np.arange(len(docs)), size)
                rows = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[docs], size)
                step += 1
                for k, g in self.gradients(x[rows], own, y[docs]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


FEATURES = "y int, rank long, n int, x binary"


def passages(docs: DataFrame) -> DataFrame:
    """Encoded passages of (y, rank, text): n passages as float32 bytes per document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                x, owner = encode(*utf8(piece.column(2)))
                n = np.bincount(owner, minlength=piece.num_rows)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n.astype(np.int32)), pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], ["y", "rank", "n", "x"])

    return map_texts(docs, run, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 20_000, seed: int = 3) -> Model:
    """Fit on docs (doc_id, text) joined with labels (doc_id, quality): the sample_rows labelled rows of docs that come first in a hashed order; a text of more
    than sample_chars characters gives a passage of that length that begins at a hashed place.  Only their features reach the driver (about
    sample_rows * sample_chars / PASSAGE rows at most)."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"), order.alias("rank"))
    chosen = chosen.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy("rank", "doc_id", "y").limit(sample_rows)
    n = F.length("text")
    place = F.when(n > sample_chars, F.pmod(F.xxhash64(F.lit(seed), "text"), n - sample_chars)).otherwise(0).cast("int")
    # the broadcast side has at most sample_rows rows of three numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("y", "rank", "doc_id", F.substring(F.col("text"), place + 1, F.lit(sample_chars)).alias("text")).orderBy("rank", "doc_id", F.xxhash64("text"), "y").limit(sample_rows)
    got = sorted(passages(rows.select("y", "rank", "text")).collect(), key=lambda r: (r["rank"], r["x"]))
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]) if got else np.zeros((0, WIDTH), np.float32)
    owner = np.repeat(np.arange(len(got)), [r["n"] for r in got]) if got else np.zeros(0, int)
    return Model().fit(x, owner, np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of that name (0 to 1) added or replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: a broadcast may not name this package
    names = [c for c in docs.columns if c.lower() != name.lower()]
    at = names.index(text)
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in names]))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        model = Model.restore(shared.value)
        for batch in batches:
            for piece in slices(batch, 1 << 20, f"c{at}"):
                x, owner = encode(*utf8(piece.column(at)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.score(x, owner, piece.num_rows), pa.float64())], [*piece.schema.names, "score"])

    return map_texts(rows, run, schema).toDF(*names, name)
