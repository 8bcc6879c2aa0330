"""Source divergence audit on a K-squared quadtree of the group-term count matrix.

Every (language, source) group gives each kept term of its language a smoothed share p of SCALE; two sources diverge by the sum of |p - q| over the terms.

1. Terms are counted in slices of texts (Arrow's dictionary encoding) and the partial counts added up by Spark.  Terms of enough documents of a language stay.
2. The matrix of a language is cut into blocks of SIDE groups by SIDE terms, numbered inside hashed blocks, so no task sorts a whole language.  A block's
   nonzero cells make a K-squared tree (K = 2): a bit per quadrant and level, the cells at the leaves.
3. The trees of two row blocks are traversed together, for all pairs of their groups at once.  A quadrant that is all zero in both is priced by its number
   of terms times the difference of the groups' smoothing shares; only where either has cells the traversal goes on, down to the cells.
4. Sums of a pair of row blocks add up inside a task; Spark adds the tasks'.

All arithmetic is on whole numbers; shares are computed in DECIMAL(38), so counts may go beyond what 64 bits hold times SCALE.

Nulls: null text, lang and source read as ''.  A group without terms diverges by the smoothing share alone; a language that keeps no term gives pairs of value 0.
Ties rank by item (UTF-8 order).  Repeated rows are documents of their own.  A text of any length is counted whole, in the memory of one
task.  Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, partitions, slices, utf8

SCALE, ADDED, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Rows and columns of a block, a power of two.
SIDE = 256
#: Bytes that separate terms: ASCII but for the letters.
GAPS = np.array([c < 0x80 and not (65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])


def terms_of(body: np.ndarray, offsets: np.ndarray):
    """Arrow array of all terms of documents laid end to end, A-Z in lower case, and the document of each."""
    import pyarrow as pa

    body = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    gap = GAPS[body]
    new = np.zeros(len(body) + 1, bool)
    new[offsets] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | new[1:-1]
    last[:-1] &= gap[1:] | new[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(bounds.tobytes()), pa.py_buffer(body[~gap].tobytes()))
    return terms, np.searchsorted(offsets, a, "right") - 1


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of slices of texts: occurrences and documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 8 << 20, "text"):
                terms, owner = terms_of(*utf8(piece.column(2)))
                coded = terms.dictionary_encode()
                code, v = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
                names = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True))
                number = {g: k for k, g in enumerate(dict.fromkeys(names))}
                group = np.array([number[g] for g in names], np.int64)
                each, times = np.unique(owner * v + code, return_counts=True)
                cell, where, n_docs = np.unique(group[each // v] * v + each % v, return_inverse=True, return_counts=True)
                n = np.zeros(len(cell), np.int64)
                np.add.at(n, where, times)
                groups = list(number)
                lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(cell // v)) for k in (0, 1))
                found = coded.dictionary.cast(pa.string()).take(pa.array(cell % v))
                yield pa.RecordBatch.from_arrays([lang, source, found, pa.array(n), pa.array(n_docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    return map_texts(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept))."""
    return f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {ADDED} as decimal(20,0))) div cast({total} + {ADDED} * {kept} as decimal(20,0)) as bigint)"


def distinct(x: np.ndarray) -> np.ndarray:
    """Values of a sorted array, once each."""
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


class Tree:
    """K-squared tree of a SIDE by SIDE block: for each level the bits of the quadrants' children, and the values of the cells in leaf order."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        depth = SIDE.bit_length() - 1
        code = np.zeros(len(row), np.int64)
        for k in range(depth):  # two bits a level: the row's and the column's
            code |= ((row.astype(np.int64) >> k & 1) << 1 | column.astype(np.int64) >> k & 1) << 2 * k
        order = np.argsort(code)
        code, self.values = code[order], value[order]
        self.levels: list[np.ndarray] = []
        for level in range(depth):
            at = distinct(code >> 2 * (depth - level - 1))
            new = np.append(True, at[1:] >> 2 != at[:-1] >> 2)[: len(at)]
            bits = np.zeros((int(new.sum()), 4), bool)
            bits[np.cumsum(new) - 1, at & 3] = True
            self.levels.append(bits)
        #: Number of each quadrant's node in the next level (its set bits before), -1 where it is all zero.
        self.child = [np.where(bits, np.cumsum(bits.ravel()).reshape(-1, 4) - 1, -1).astype(np.int32) for bits in self.levels]

    def share(self, cell: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Value of each cell, zero's where there is none (-1)."""
        return np.where(cell >= 0, self.values[np.maximum(cell, 0)], zero) if len(self.values) else zero

    def children(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """Number of the child in the next level, or -1 where the quadrant is all zero or the node is none."""
        if not len(self.levels[level]):
            return np.full(len(node), -1, np.int32)
        return np.append(self.child[level][:, quadrant], np.int32(-1))[node]


def add_distances(out: np.ndarray, a: Tree, b: Tree, za: np.ndarray, zb: np.ndarray, n_columns: int) -> None:
    """Add the distances over one column block of every row of a to every row of b to out; za and zb are the rows' shares of a zero cell.

    Rectangles of pairs that are zero on both sides are priced with their number of real columns, all at once per level.  A tree meets itself in the half
    above the diagonal, which is mirrored.
    """
    depth = SIDE.bit_length() - 1
    zero, sums = np.zeros((SIDE, SIDE), np.int64), np.zeros(SIDE * SIDE)
    start = [np.array([x], np.int32) for x in (0, 0, 0, 0 if len(a.values) else -1, 0 if len(b.values) else -1)]
    todo = [(0, start)]
    while todo:
        level, (row, other, column, node, node2) = todo.pop()
        size = SIDE >> level
        both = (node < 0) & (node2 < 0)
        if both.any():
            grid = np.zeros((1 << level, 1 << level), np.int64)
            np.add.at(grid, (row[both], other[both]), np.clip(n_columns - column[both] * size, 0, size))
            zero += grid.repeat(size, 0).repeat(size, 1)
            row, other, column, node, node2 = (x[~both] for x in (row, other, column, node, node2))
        if level == depth:
            # sums of whole numbers below 2**53, so exact
            sums += np.bincount(row.astype(np.int64) * SIDE + other, np.abs(a.share(node, za[row]) - b.share(node2, zb[other])), SIDE * SIDE)
            continue
        for begin in range(0, len(row), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            below = []
            for c in (0, 1):
                left, right = ([t.children(level, x[part], 2 * i + c) for i in (0, 1)] for t, x in ((a, node), (b, node2)))
                for i in (0, 1):
                    for j in (0, 1):
                        below.append((2 * row[part] + i, 2 * other[part] + j, 2 * column[part] + c, left[i], right[j]))
            below = [np.concatenate(x) for x in zip(*below, strict=True)]
            stays = below[2] * (size >> 1) < n_columns
            if a is b:
                stays &= below[0] <= below[1]
            todo.append((level + 1, [x[stays] for x in below]))
    found = sums.reshape(SIDE, SIDE).astype(np.int64) + zero * np.abs(za[:, None] - zb[None, :])
    out += np.triu(found, 1) + np.triu(found, 1).T if a is b else found


def trees(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(lang, rb, cb, n_columns, zeros, cells): every block of every language, its packed cells null where it has none."""
    packed = cells.groupBy("lang", "rb", "cb").agg(F.collect_list(F.struct("row", "col", "p")).alias("cells"))
    across = columns.groupBy("lang", "cb").agg(F.count("*").cast("int").alias("n_columns"))
    zeros = rows.groupBy("lang", "rb").agg(F.array_sort(F.collect_list(F.struct("row", "zero"))).getField("zero").alias("zeros"))
    return zeros.join(across, "lang").join(packed, ["lang", "rb", "cb"], "left")


def block_distances(blocks: DataFrame) -> DataFrame:
    """(lang, rb, row, rb2, row2, value): partial sums over column blocks of all pairs of rows of two row blocks, the first not after the second."""
    other = blocks.select("lang", "cb", F.col("rb").alias("rb2"), F.col("zeros").alias("zeros2"), F.col("cells").alias("cells2"))
    met = blocks.join(other, ["lang", "cb"]).filter("rb <= rb2").select("lang", "rb", "rb2", "n_columns", "zeros", "cells", "zeros2", "cells2")

    def lists(column, *fields: str) -> list[tuple]:
        """The arrays in each row of a list column, null as empty."""
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = column.flatten()
        parts = [(flat.field(f) if f else flat).to_numpy(zero_copy_only=False) for f in fields]
        return [tuple(x[a:b] for x in parts) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def padded(zeros: np.ndarray) -> np.ndarray:
        return np.concatenate([zeros, np.zeros(SIDE - len(zeros), np.int64)])

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        sizes: dict[tuple, tuple[int, int]] = {}

        def flush():
            for (lang, rb, rb2), out in sums.items():
                n, m = sizes[lang, rb, rb2]
                i, j = (x.ravel() for x in np.indices((n, m)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(np.full(len(i), rb)), pa.array(i.astype(np.int32)), pa.array(np.full(len(i), rb2)), pa.array(j.astype(np.int32)), pa.array(out[:n, :m].ravel())], ["lang", "rb", "row", "rb2", "row2", "value"])
            sums.clear()

        for batch in batches:
            lang, rb, rb2, n_columns = (batch.column(k).to_pylist() for k in range(4))
            (zeros, cells), (zeros2, cells2) = ((lists(batch.column(k), ""), lists(batch.column(k + 1), "row", "col", "p")) for k in (4, 6))
            for k, key in enumerate(zip(lang, rb, rb2, strict=True)):
                if key not in sums and len(sums) == 64:
                    yield from flush()
                out = sums.setdefault(key, np.zeros((SIDE, SIDE), np.int64))
                sizes[key] = (len(zeros[k][0]), len(zeros2[k][0]))
                a = Tree(*cells[k])
                b = a if key[1] == key[2] else Tree(*cells2[k])
                add_distances(out, a, b, padded(zeros[k][0]), padded(zeros2[k][0]), n_columns[k])
        yield from flush()

    return map_texts(met, run, "lang string, rb long, row int, rb2 long, row2 int, value long")


def numbered(df: DataFrame, key: str, block: str, place: str, of: DataFrame) -> DataFrame:
    """df with a block and a place of less than SIDE in it for every key of a language; of has the number of keys of each language as k.

    Keys are dealt to hashed blocks of about three quarters of SIDE and numbered there; blocks that come out larger give further ones.
    """
    spread = df.join(of, "lang").withColumn("_h", F.pmod(F.xxhash64(key), F.ceil(F.col("k") / (SIDE * 3 // 4))).cast("long")).drop("k")
    spread = spread.repartition(partitions(df.sparkSession), "lang", "_h")  # not by the language alone, which the join deals by
    nth = F.row_number().over(Window.partitionBy("lang", "_h").orderBy(key)) - 1
    spread = spread.withColumn("_n", nth)
    name = F.shiftleft("_h", 32) + F.floor(F.col("_n") / SIDE)
    return spread.withColumn(block, name).withColumn(place, (F.col("_n") % SIDE).cast("int")).drop("_h", "_n")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` (other sources of the language) and `term` (terms that the source favours) of every group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    counts = cut(partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= least_docs).select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    cells = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "v", "total"])
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, F.expr(share("0", "n_group", "v"))).otherwise(0))
    sized = groups.groupBy("lang").agg(F.count("*").alias("k"))
    groups = cut(numbered(groups, "source", "rb", "row", sized))
    columns = cut(numbered(kept, "term", "cb", "col", langs.select("lang", F.col("v").alias("k"))))
    priced = cells.drop("all").join(groups.select("lang", "source", "rb", "row", "n_group", "v", "total"), ["lang", "source"]).join(columns, ["lang", "term"])
    priced = cut(priced.withColumn("p", F.expr(share("n", "n_group", "v"))).withColumn("q", F.expr(share("all", "total", "v"))).select("lang", "source", "term", "rb", "row", "cb", "col", "p", "q"))

    blocks = cut(trees(priced, groups, columns))
    sums = cut(block_distances(blocks.repartition(partitions(docs.sparkSession), "lang", "cb")).groupBy("lang", "rb", "row", "rb2", "row2").agg(F.sum("value").alias("value")))
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("rb").alias(rb), F.col("row").alias(row)) for s, rb, row in (("source", "rb", "row"), ("item", "rb2", "row2")))
    ways = sums.unionByName(sums.filter("rb < rb2").select("lang", F.col("rb2").alias("rb"), F.col("row2").alias("row"), F.col("rb").alias("rb2"), F.col("row").alias("row2"), "value"))
    # every pair of a language's groups is a row of the result; a language without kept terms has no sums
    pairs = one.join(two, "lang").filter("source <> item").join(ways, ["lang", "rb", "row", "rb2", "row2"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    favoured = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).cast("int").alias("rank")
    ranked = favoured.select("*", rank).filter(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(ranked)
