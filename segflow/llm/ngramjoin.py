"""Word n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per distinct shingle set (documents with equal sets share one) and a column per shingle.  It is cut into
column blocks, which travel as packed arrays, one shuffle row per block and batch:

1. Size bounds say how many of its smallest-hashed columns a row must share with any partner.  A first product pass over
   that part of the matrix counts, per row, columns that another row has too; rows below their bound can't be in any
   link and drop out.
2. The same pass over all columns of the remaining rows gives column counts.  A row with too few shared columns drops out;
   the others keep their rarest shared columns, as many as the size bound needs, and rows that meet in one are candidates.
3. Candidate groups (components of that graph) are multiplied block by block: overlaps add up over column chunks, pairs below
   PERCENT of the union are discarded, and each block returns a spanning forest of its links.  Groups too large for one
   block are dealt to blocks by size class and hash; only what these leave unconnected meets every row whose size can match.

No bound, count or hash order ever drops a real link.  Frequent columns found in a bounded sample skip the column blocks
(they are shared anyway), so a passage that a third of the documents contain doesn't gather in one task.

Shingles are 64-bit hashes.  Nulls: null and blank texts have the empty set and link with nothing; a null doc_id is a
document of its own, and its component is the least non-null id of those it links with.  Ties don't matter: the result is a
set of components.  Repeated rows belong to one component.  A text of any length is one row of the matrix, in the memory of one task.
Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, fresh, identified, map_texts, mix64, partitions, row_hash, slices, unique_ids, utf8, whole_row, word_spans
from .components import components

N, PERCENT = 4, 85


def shingle_sets(body: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents end to end, sizes, and a hash of each set (as signed integers)."""
    body = body.copy()
    body[(body >= 65) & (body <= 90)] += 32
    a, _, key = word_spans(body, offsets)
    docs = len(offsets) - 1
    words = np.diff(np.searchsorted(a, offsets))
    first = np.cumsum(words) - words
    x = key.copy()
    for j in range(1, n):
        m = max(0, len(x) - j)
        # a document with fewer words than n ends early: its last words take part in one sequence of its own length
        x[:m] = mix64(x[:m]) * np.uint64(BASE) + key[j : j + m]
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    for d in np.flatnonzero((words > 0) & (words < n)):
        w = key[first[d] : first[d] + words[d]]
        h = w[:1]
        for k in range(1, len(w)):
            h = mix64(h) * np.uint64(BASE) + w[k : k + 1]
        x[first[d]] = mix64(h + np.uint64(len(w)))[0]
    start = np.cumsum(count) - count
    x = mix64(x[np.arange(int(count.sum())) - np.repeat(start, count) + np.repeat(first, count)])
    for s, c in zip(start.tolist(), count.tolist(), strict=True):
        x[s : s + c].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[start[count > 0]] = True
    owner = np.repeat(np.arange(docs), count)
    x, owner = x[new], owner[new]
    size = np.bincount(owner, minlength=docs)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix64(x ^ np.uint64(BASE)), out=total[1:])
    ends = np.cumsum(size)
    return x, size, mix64(total[ends] - total[ends - size] + size.astype(np.uint64)).view(np.int64)


def least_overlap(size, percent: int = PERCENT):
    """Overlap that a set of this size needs with any partner, as percent of the larger set at least."""
    return -(-percent * size // 100)


def extra(size, percent: int = PERCENT):
    return size * (100 - percent) // 100


def prefix(size, percent: int = PERCENT):
    """Columns of the first pass: any partner shares extra(smaller size) + 1 of them at least."""
    return np.minimum(size, size - least_overlap(size, percent) + 1 + extra(size, percent))


def first_bound(size, percent: int = PERCENT):
    """Shared columns that a row needs in the first pass, whatever its partner's size.  The pass knows columns by 38 bits or more, and
    the allowance covers two columns of one row that fall together."""
    return extra(least_overlap(size, percent), percent) - size // 2048


def second_bound(size, percent: int = PERCENT):
    return least_overlap(size, percent)


def pack(part: np.ndarray, n_parts: int, *columns: np.ndarray):
    """(part, body) rows: the given columns dealt out by part, as one byte string each."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    columns = [c[order] for c in columns]
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            yield p, np.int64(end - begin).tobytes() + b"".join(c[begin:end].tobytes() for c in columns)
        begin = end


def unpack(bodies: list[bytes], kinds: tuple) -> list[np.ndarray]:
    out: list[list] = [[] for _ in kinds]
    for b in bodies:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, kinds, strict=True)]


def as_batch(rows):
    import pyarrow as pa

    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "body"])


PACKED = "part int, body binary"
ENTRY = (np.uint32, np.int64, np.int32)
SHARED = (np.int64, np.int32, np.uint64, np.int32)


def spread(x: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of each 64-bit hash, from its high bits."""
    return ((x >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def digests(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, cls): cls identifies the shingle set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 2 << 20):
                _, size, cls = shingle_sets(*utf8(piece.column(1)), n)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size.astype(np.int64)), pa.array(cls)], ["doc_id", "n_shingles", "cls"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, n_shingles long, cls long")


def frequent_columns(docs: DataFrame, sample_rows: int = 1000, share: float = 0.02, n: int = N) -> np.ndarray:
    """Shingles in at least this share of a bounded sample of rows (only the speed depends on it)."""
    rows = docs.select("text").sample(0.05, seed=1).limit(sample_rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 2 << 20):
                x, size, _ = shingle_sets(*utf8(piece.column(0)), n)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["x"])

    found = map_texts(rows, run, "x long").groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") >= max(8, int(share * sample_rows))).select("x").collect()
    return np.sort(np.array([r["x"] for r in found], np.int64).view(np.uint64))


def shared_columns(sets: DataFrame, n_parts: int, frequent: np.ndarray, whole: bool) -> DataFrame:
    """Product pass: packed (cls, size, column, count) of entries whose column another row has too, dealt by cls.

    sets has packed rows from set_blocks().
    """

    def columns(batches):
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        low, cls, size = unpack([b for _, b in rows], ENTRY)
        part = np.repeat(np.array([p for p, _ in rows], np.uint64), [int(np.frombuffer(b, np.int64, 1)[0]) for _, b in rows]) if rows else np.zeros(0, np.uint64)
        key = low.astype(np.uint64) | part << np.uint64(32)
        order = np.lexsort((cls, key))
        key, cls, size = key[order], cls[order], size[order]
        if not whole:  # batches may repeat a set
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, size = key[keep], cls[keep], size[keep]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group] if len(group) else group
        hit = count > 1
        column, cls, size, count = key[hit], cls[hit], size[hit], count[hit].astype(np.int32)
        if whole:
            yield as_batch(pack(spread(mix64(cls.view(np.uint64)), n_parts), n_parts, cls, size, column, count))
        else:  # only the number of shared columns matters
            one, inverse, n = np.unique(cls, return_inverse=True, return_counts=True)
            most = np.zeros(len(one), np.int32)
            most[inverse] = size
            yield as_batch(pack(spread(mix64(one.view(np.uint64)), n_parts), n_parts, one, most, n.astype(np.uint64), n.astype(np.int32)))

    return map_texts(sets.filter("part < 1000000").repartitionById(n_parts, "part"), columns, PACKED).unionByName(sets.filter("part >= 1000000").select((F.col("part") - 1000000).alias("part"), "body"))


def set_blocks(rows: DataFrame, n_parts: int, frequent: np.ndarray, whole: bool, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Column blocks of the matrix from rows (cls, n_shingles, body) of sets or (text,) of texts; frequent columns go straight to their rows' part,
    numbered from 1000000."""

    def emit(x, size, cls):
        owner = np.repeat(np.arange(len(size)), size)
        if not whole:
            rank = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            keep = rank < np.repeat(prefix(size, percent), size)
            x, owner = x[keep], owner[keep]
        known = np.isin(x, frequent)
        y, of = mix64(x[~known]), owner[~known]
        # equal sets of a batch send their entries once
        _, once = np.unique(cls, return_index=True)
        first = np.zeros(len(cls), bool)
        first[once] = True
        keep = first[of]
        y, of = y[keep], of[keep]
        yield as_batch(pack(spread(y, n_parts), n_parts, (y & np.uint64(0xFFFFFFFF)).astype(np.uint32), cls[of], size[of].astype(np.int32)))
        y, of = mix64(x[known]), owner[known]
        keep = first[of]
        y, of = y[keep], of[keep]
        if len(of):
            many = np.full(len(of), 2**31 - 1, np.int32)
            if not whole:
                of, hits = np.unique(of, return_counts=True)
                y, many = hits.astype(np.uint64), hits.astype(np.int32)
            row = cls[of]
            yield as_batch((p + 1000000, b) for p, b in pack(spread(mix64(row.view(np.uint64)), n_parts), n_parts, row, size[of].astype(np.int32), y | np.uint64(1 << 63) if whole else y, many))

    def run(batches):
        for batch in batches:
            if whole:
                sizes, cls = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
                yield from emit(x, sizes, cls)
            else:
                for piece in slices(batch, 2 << 20):
                    yield from emit(*shingle_sets(*utf8(piece.column(0)), n))

    return map_texts(rows.select("cls", "n_shingles", "body") if whole else rows.select("text"), run, PACKED)


def gathered(batches, n_parts):
    """The hits of this task's rows, sorted by row."""
    cls, size, column, count = unpack([b for batch in batches for b in batch.column(1).to_pylist()], SHARED)
    order = np.lexsort((column, count, cls))
    return cls[order], size[order], column[order], count[order]


def possible_rows(docs: DataFrame, frequent: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """cls of the sets that pass the first bound.  Frequent columns may count once per batch that repeats the set, which only keeps more."""
    n_parts = partitions(docs.sparkSession)

    def bound(batches):
        import pyarrow as pa

        cls, size, _, count = gathered(batches, n_parts)
        one, start = np.unique(cls, return_index=True)
        total = np.add.reduceat(count.astype(np.int64), start) if len(one) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(one[total >= first_bound(size[start].astype(np.int64), percent)])], ["cls"])

    return map_texts(shared_columns(set_blocks(docs, n_parts, frequent, False, n, percent), n_parts, frequent, False).repartitionById(n_parts, "part"), bound, "cls long")


def candidate_columns(sets: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(col, cls): the rarest shared columns of each row that passes the second bound."""
    n_parts = partitions(sets.sparkSession)

    def rarest(batches):
        import pyarrow as pa

        cls, size, column, count = gathered(batches, n_parts)
        _, start, n = np.unique(cls, return_index=True, return_counts=True)
        keep = n - second_bound(size[start].astype(np.int64), percent) + 1
        rank = np.arange(len(cls)) - np.repeat(start, n)
        ok = rank < np.repeat(keep, n)
        yield pa.RecordBatch.from_arrays([pa.array(column[ok].view(np.int64)), pa.array(cls[ok])], ["col", "cls"])

    return map_texts(shared_columns(set_blocks(sets, n_parts, frequent, True), n_parts, frequent, True).repartitionById(n_parts, "part"), rarest, "col long, cls long")


def product_forest(cls: np.ndarray, sets: list[np.ndarray], chunk: int = 4096, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Spanning forest of the links among the given sets, and the number of links: overlaps add up over column chunks."""
    size = np.array([len(s) for s in sets], np.int64)
    g = len(sets)
    x, owner = np.concatenate(sets), np.repeat(np.arange(g), size)
    _, column, count = np.unique(x, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.zeros((g, g), np.float64 if size.max(initial=0) > 1 << 23 else np.float32)
    n_columns = int(shared.sum())
    for c in range(0, n_columns, chunk):
        a, b = np.searchsorted(column, [c, c + chunk])
        block = np.zeros((g, min(chunk, n_columns - c)), overlap.dtype)
        block[owner[a:b], column[a:b] - c] = 1
        overlap += block @ block.T
    link = (100 + percent) * overlap >= percent * (size[:, None] + size[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(g)
    while True:  # each row takes the least label among its links until nothing changes
        least = np.minimum(root, np.where(link, root[None, :], g).min(1, initial=g))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return cls, cls[root], int(link.sum()) // 2


def multiply(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the exact links in each task of tasks (cls, task)."""
    rows = sets.select("cls", "body").join(tasks, "cls")

    def run(t):
        import pyarrow as pa

        cls, first = np.unique(t.column("cls").to_numpy(), return_index=True)
        bodies = t.column("body").take(pa.array(first))
        u, v, _ = product_forest(cls, [np.frombuffer(b.as_py(), np.uint64) for b in bodies], percent=percent)
        keep = u != v
        return pa.table({"u": pa.array(np.maximum(u, v)[keep]), "v": pa.array(np.minimum(u, v)[keep])})

    return rows.select("task", "cls", "body").groupBy("task").applyInArrow(run, "u long, v long")


def blocks_of(rows: DataFrame, keys: list[str], name: str, block_rows: int, block_entries: int) -> DataFrame:
    """(keys, name): blocks that the rows of each key need."""
    need = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n_shingles") / block_entries))
    return rows.groupBy(*keys).agg(need.cast("int").alias(name))


def links(groups: DataFrame, sets: DataFrame, percent: int, block_rows: int = 2000, block_entries: int = 2_000_000) -> DataFrame:
    """(u, v): edges that connect what exact links connect, inside candidate groups (cls, grp) of sets (cls, n_shingles, body).

    A group of one block is multiplied at once.  A larger one is dealt to blocks by size class and hash, each block with a few rows of its own and the next smaller
    class that all blocks get; that connects what belongs together with work in proportion to the group's rows, and where much stays apart another deal follows.
    Only rows that are then outside their group's largest component meet all other rows of sizes that can match.
    """
    plan = groups.join(sets.select("cls", "n_shingles"), "cls")
    plan = plan.join(blocks_of(plan, ["grp"], "whole", block_rows, block_entries), "grp")
    # sizes that can match lie in the same class or the next one
    plan = cut(plan.withColumn("s", F.floor(F.log("n_shingles") / -float(np.log(percent / 100 - 0.001))).cast("int")))
    named = lambda *parts: F.concat_ws(":", *parts)
    small, large = plan.filter("whole = 1"), plan.filter("whole > 1")
    edges = cut(multiply(small.select("cls", named("grp").alias("task")), sets, percent))
    if not large.take(1):
        return edges
    large = cut(large.join(blocks_of(large, ["grp", "s"], "nb", block_rows, block_entries), ["grp", "s"]).select("cls", "grp", "s", "nb", "n_shingles"))
    classes = large.select("grp", F.col("s").alias("t"), "nb").distinct()

    def dealt(rows: DataFrame, deal: int) -> DataFrame:
        own = rows.select("cls", named("grp", "s", F.pmod(F.xxhash64("cls", F.lit(deal)), F.col("nb"))).alias("task"))
        pivots = rows.groupBy("grp", "s", F.pmod(F.xxhash64("cls", F.lit(deal)), F.lit(8))).agg(F.min("cls").alias("cls"))
        pivots = pivots.join(classes, "grp").filter("t = s OR t = s + 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        return multiply(own.unionByName(pivots.select("cls", named("grp", "t", "i").alias("task"))), sets, percent)

    def apart(edges: DataFrame) -> DataFrame:
        """Rows outside the largest component of their group."""
        root = components(edges)
        held = large.join(root.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        largest = held.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
        return cut(held.join(largest, "grp").filter("root <> most").select("cls", "grp", "s", "n_shingles"))

    edges = cut(edges.unionByName(dealt(large, 1)))
    left = apart(edges)
    much = left.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("grp")
    if much.take(1):
        edges = cut(edges.unionByName(dealt(large.join(much, "grp", "left_semi"), 2)))
        left = apart(edges)
    if not left.take(1):
        return edges
    nl = blocks_of(left, ["grp", "s"], "nl", block_rows, block_entries)
    near = F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))
    # each block of left rows against each block of all rows whose sizes can match
    left_tasks = left.join(nl, ["grp", "s"]).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("nl"))).withColumn("t", near)
    left_tasks = left_tasks.join(classes, ["grp", "t"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("cls", named("grp", "s", "i", "t", "j").alias("task"))
    all_tasks = large.withColumn("j", F.pmod(F.xxhash64("cls"), F.col("nb"))).withColumnRenamed("s", "t").join(nl.withColumn("t", near), ["grp", "t"])
    all_tasks = all_tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).select("cls", named("grp", "s", "i", "t", "j").alias("task"))
    return cut(edges.unionByName(multiply(left_tasks.unionByName(all_tasks), sets, percent)))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of those reachable by links) of every row of docs (doc_id, text).

    Documents are linked when their sets of word n-grams have a Jaccard similarity of percent / 100 or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = cut(digests(docs, n))
    frequent = frequent_columns(docs, n=n)
    possible = cut(possible_rows(docs, frequent, n, percent))
    # one document stands for each set; equal sets are combined before they move
    by_set = cut(digest.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    stands = by_set.join(possible, "cls", "left_semi")

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 2 << 20):
                x, size, cls = shingle_sets(*utf8(piece.column(1)), n)
                ends = np.cumsum(size)
                want = piece.column(0).to_numpy(zero_copy_only=False)
                mine = np.flatnonzero(want == cls)
                yield pa.RecordBatch.from_arrays([pa.array(cls[mine]), pa.array(size[mine].astype(np.int64)), pa.array([x[ends[i] - size[i] : ends[i]].tobytes() for i in mine.tolist()], pa.binary())], ["cls", "n_shingles", "body"])

    chosen = docs.join(stands.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id"))).select("cls", "text")
    sets = cut(map_texts(chosen, packed, "cls long, n_shingles long, body binary"))
    columns = cut(candidate_columns(sets, frequent, percent))
    hub = columns.groupBy("col").agg(F.min("cls").alias("v"), F.count("*").alias("n")).filter("n > 1")
    near = components(columns.join(hub, "col").filter("cls <> v").select(F.col("cls").alias("u"), "v"))
    groups = near.select(F.col("u").alias("cls"), F.col("v").alias("grp")).unionByName(near.select(F.col("v").alias("cls"), F.col("v").alias("grp")).distinct())
    linked = components(links(cut(groups), sets, percent))
    root = by_set.join(linked.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # written, so that these joins have exchanges of their own, which can be split where a component has many sets or a set many documents
    root = cut(root)
    least = cut(root.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = cut(root.join(least, "root").select("cls", "component_id"))
    return digest.join(found, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component of near copies: the one with the least doc_id.

    Rows without an id stay only if nothing with an id is linked to them.  Rows of equal id and text are one document: of these the row with the least hash
    of all columns stays.  Columns of any names pass through.
    """
    key, sha, row = fresh(docs, "key"), fresh(docs, "sha"), fresh(docs, "row")
    as_key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias(key)
    if unique_ids(docs):
        stays = jaccard_components(docs, n, percent).filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
        return docs.select(as_key, whole_row(docs).alias(row)).join(stays.select(as_key), key, "left_semi").select(f"{row}.*")
    # ids don't tell documents apart: they are known by id and text, and go by numbers of their own
    as_sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias(sha)
    each = identified(docs, nulls_last=True)
    least = jaccard_components(each.select(F.col("doc").alias("doc_id"), "text"), n, percent).filter(F.col("component_id") == F.col("doc_id"))
    stays = each.join(least.select(F.col("doc_id").alias("doc")), "doc", "left_semi").select(as_key, as_sha)
    kept = docs.select(as_key, as_sha, F.col("text").isNull().alias(f"{sha}_null"), whole_row(docs).alias(row)).join(stays, [key, sha], "left_semi")
    return kept.groupBy(key, sha, f"{sha}_null").agg(F.min_by(row, row_hash(docs, row)).alias(row)).select(f"{row}.*")
