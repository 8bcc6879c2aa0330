"""Exact substring dedup by a distributed suffix sort.

A byte goes when a LENGTH-byte string over it also starts earlier (smaller doc_id, or the same document further left).
Sorting every suffix would move a hundred times the text, so suffixes are taken at anchors: the anchor of a window
(a LENGTH-byte string) is the start of its least hashed GRAM-byte gram, so equal windows have equal anchors at equal distances, and a
run of neighbouring windows shares one.  A suffix stands for its run: it starts at the anchor, and carries the bytes of all windows of the run.

1. A first pass only counts: hashes of the grams at anchors are dealt out, and runs whose gram's hash occurs once are left out.
   Runs whose gram repeats in their own slice of texts are known at once, and one of them goes out for all.
2. The suffixes of the runs that are left are range-partitioned by splitters, real suffixes from a bounded sample, compared by their leading
   GRAM bytes and then by document, so that a hot string spreads over buckets.  Equal runs of one slice are combined before they move.
3. A bucket sorts its suffixes by content with multikey quicksort on eight bytes at a time.  A run whose bytes are those of the suffix before it
   repeats as a whole.  Suffixes that share the gram in other surroundings are compared window by window.
4. A gram that a splitter begins with can lie on both sides of a bucket's boundary.  The windows over it that are first in
   their bucket are compared by content across all buckets, and those that are not first there repeat too.
5. Repeated runs and windows merge into spans per document, and the text's remaining bytes are hashed.

Nothing is removed on the word of a hash: hashes only choose what is compared, and every repetition is decided on the bytes.

Nulls: a null text is empty; a null doc_id sorts first.  Documents with equal ids are ordered by the crc32 and then the SHA-256 of the text,
and repeated rows (equal id and text) are judged as one document, so each gets its result.  A text of any length is worked on in stretches.  Empty tables
give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, identified, map_texts, mix64, partitions, slices, utf8
from .ngramjoin import pack, unpack

LENGTH, GRAM = 100, 40
#: A suffix's bytes: as many left of the anchor as a window can reach, and as many from the anchor on.
LEFT, WIDTH = LENGTH - GRAM, 2 * LENGTH - GRAM
#: Low bits of an anchor's rank that hold its place; slices of text are shorter.
PLACE_BITS = 22
KEYS = (np.uint64, np.int64, np.uint32, np.uint8)
RUN = (np.dtype(f"V{WIDTH}"), np.uint8, np.uint8, np.int64, np.uint32)
WINDOW = (np.dtype(f"V{LENGTH}"), np.int64, np.uint32)
SPAN = (np.int64, np.uint32, np.uint32)
#: Kinds of packed rows: spans of windows by document (SPAN), and what is dealt to be compared (KEYS, RUN or WINDOW).
SPANS, COMPARE = 0, 1
PACKED = "kind int, part int, body binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(BASE) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place (the end is padded with zeros)."""
    n = len(body)
    m = -(-(n + 2 * LENGTH) // 8) * 8
    raw = np.zeros(m + 8, np.uint8)
    raw[:n] = body
    h8 = np.empty(m, np.uint64)
    data = raw.tobytes()
    for j in range(8):
        h8[j::8] = np.frombuffer(data, np.uint64, m // 8, j)
    h8 = mix64(h8)
    h16 = join_hash(h8[:-8], h8[8:])
    h32 = join_hash(h16[:-16], h16[16:])
    return join_hash(h32[: n + 64], h8[32 : n + 96])


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window inside a document, and the document."""
    count = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count), owner


def anchored(body: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: document, place of the first window, windows after it, place of the anchor, hash of its gram (places count from body's start)."""
    at, owner = windows(offsets)
    if not len(at):
        return owner, at, np.zeros(0, np.uint8), at, np.zeros(0, np.uint64)
    gram = gram_hashes(body)
    bits = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~bits) | np.arange(len(gram), dtype=np.uint64)
    width = LENGTH - GRAM + 1
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (least[at] & bits).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], (at[last] - at[first]).astype(np.uint8), anchor[first], mix64(gram[anchor[first]])


def contents(body: np.ndarray, first: np.ndarray, more: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """WIDTH bytes about each anchor, zero outside the run's windows."""
    out = np.zeros((len(first), WIDTH), np.uint8)
    step = np.arange(-LEFT, LENGTH, dtype=np.int32)
    for i in range(0, len(first), 4096):
        part = slice(i, i + 4096)
        at = anchor[part].astype(np.int32)[:, None] + step
        inside = (at >= first[part, None]) & (at < (first[part] + more[part] + LENGTH)[:, None])
        out[part] = np.where(inside, body[np.clip(at, 0, len(body) - 1)], 0)
    return out


def content_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes; only a filter in front of comparing them."""
    k = -(-rows.shape[1] // 8)
    words = np.zeros((len(rows), 8 * k), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(k):
        h = join_hash(h, words[:, j])
    return h


def same_content(rows: np.ndarray) -> np.ndarray:
    """Number of each row's class of equal bytes."""
    if not len(rows):
        return np.zeros(0, np.int64)
    _, first, label = np.unique(content_hash(rows), return_index=True, return_inverse=True)
    wrong = (rows != rows[first[label]]).any(1)
    if wrong.any():  # different rows with one hash are told apart by their bytes
        mixed = np.flatnonzero(np.isin(label, label[wrong]))
        order = multikey_quicksort(list(big_endian(rows[mixed]).T))
        held = rows[mixed[order]]
        new = np.append(True, (held[1:] != held[:-1]).any(1))
        label[mixed[order]] = len(first) + np.cumsum(new)
    return label


def firsts(label: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its class in the order of place."""
    order = np.lexsort((*place[::-1], label))
    out = np.zeros(len(label), bool)
    held = label[order]
    out[order[np.append(True, held[1:] != held[:-1])[: len(order)]]] = True
    return out


def big_endian(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers that sort alike, eight bytes each."""
    k = -(-rows.shape[1] // 8)
    out = np.zeros((len(rows), 8 * k), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(">u8").astype(np.uint64)


def multikey_quicksort(keys: list[np.ndarray], small: int = 1024) -> np.ndarray:
    """Order of rows by keys in turn: rows are parted in three about a pivot of one key, and those equal to it go on with the next.

    Parts of at most small rows are sorted by the keys that are left at once.
    """
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([k[part] for k in keys[: depth - 1 if depth else None : -1]])]
            continue
        x = keys[depth][part]
        some = np.sort(x[:: max(1, len(x) // 9)])
        pivot = some[len(some) // 2]
        less, equal = x < pivot, x == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def doc_keys(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def doc_part(doc: np.ndarray, n_parts: int) -> np.ndarray:
    return ((mix64(doc.view(np.uint64)) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def segments(body: np.ndarray, offsets: np.ndarray, most: int = 2 << 20):
    """(body, offsets, base) of all windows: as they are, or a very long document in overlapping stretches that start at base."""
    if len(body) <= most or len(offsets) > 2:
        yield body, offsets, 0
        return
    for base in range(0, len(body) - LENGTH + 1, most):
        part = body[base : base + most + LENGTH - 1]
        yield part, np.array([0, len(part)], np.int64), base


def hash_part(key: np.ndarray, n_parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


class Splitters:
    """Bucket bounds: the last suffix of each bucket but the final one, as its leading GRAM bytes and its document, in that order."""

    def __init__(self, rows: list[tuple[bytes, int]], n_parts: int):
        rows = sorted(rows)
        self.rows = [rows[i] for i in sorted(set(np.linspace(0, len(rows), n_parts + 1)[1:-1].astype(int).tolist()))] if rows else []
        self.n_parts = n_parts
        self.leading = big_endian(np.frombuffer(b"".join(g for g, _ in self.rows), np.uint8).reshape(-1, GRAM))[:, 0]

    def part(self, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Bucket of each suffix, from rows of GRAM bytes and documents."""
        first = big_endian(gram)[:, 0]
        part = np.searchsorted(self.leading, first, "left")
        for i in np.flatnonzero(part < np.searchsorted(self.leading, first, "right")).tolist():  # begins like a splitter: all bytes, then the document decide
            part[i] = bisect_left(self.rows, (gram[i].tobytes(), int(doc[i])))
        return part

    def edges(self, part: int) -> list[bytes]:
        """Grams that can lie on both sides of a bucket's bounds."""
        return [g for g, _ in self.rows[max(0, part - 1) : part + 1]]


def sample_splitters(docs: DataFrame, n_parts: int, sample_rows: int = 1000, sample_runs: int = 32) -> list[tuple[bytes, int]]:
    """Leading bytes and document of at most sample_runs suffixes of each of at most sample_rows documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                body, offsets = utf8(piece.column(1))
                doc = doc_keys(piece.column(0))
                part, bounds, _ = next(segments(body, offsets))
                owner, first, more, anchor, _ = anchored(part, bounds)
                begin = np.searchsorted(owner, np.arange(len(bounds)))
                pick = np.unique(np.concatenate([np.linspace(a, b, sample_runs, endpoint=False).astype(int) for a, b in zip(begin, begin[1:], strict=False) if b > a])) if len(owner) else np.zeros(0, int)
                rows = contents(part, first[pick], more[pick], anchor[pick])[:, LEFT : LEFT + GRAM]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(doc[owner[pick]], pa.int64())], ["gram", "doc"])

    rows = docs.sample(0.1, seed=2).limit(sample_rows)
    return [(bytes(r["gram"]), r["doc"]) for r in map_texts(rows, run, "gram binary, doc long").collect()]


def batch_of(kind: int, rows):
    """Packed (part, body) rows as an Arrow batch, bodies compressed."""
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = [(p, squeeze(b)) for p, b in rows]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["kind", "part", "body"])


def loosened(bodies: list[bytes], kinds: tuple) -> list[np.ndarray]:
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    return unpack([unzip(b) for b in bodies], kinds)


def spans_batch(n_parts: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Spans of window starts, merged, as packed rows dealt by document."""
    doc, a, b, _ = merged(doc, a, b)
    return batch_of(SPANS, pack(doc_part(doc, n_parts), n_parts, doc, a.astype(np.uint32), b.astype(np.uint32)))


def merged(doc, a, b):
    """The spans in order, those of a document that overlap or follow each other made one, and whether a document begins."""
    order = np.lexsort((b, a, doc))
    doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    # ends run on within a document: documents are told apart by adding more than any place
    far = np.int64(1) << 33
    base = (np.cumsum(new) - 1) * far
    reach = np.maximum.accumulate(b + base) if len(b) else b
    begins = new.copy()
    begins[1:] |= a[1:] + base[1:] > reach[:-1] + 1
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], a[first], reach[last] - base[last] if len(first) else a[first], new[first]


def by_part(batches):
    """Bodies of this task's rows: {part: [body]} of those to compare; rows of spans are given back as they are."""
    held: dict[int, list[bytes]] = {}
    passed = []
    for batch in batches:
        for kind, part, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind == SPANS:
                passed.append((kind, part, body))
            else:
                held.setdefault(part, []).append(body)
    return held, passed


def given_back(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 2 else pa.int32()) for k in range(3)], ["kind", "part", "body"])


def repeated_grams(docs: DataFrame, n_parts: int) -> DataFrame:
    """Packed spans of the runs whose gram's hash occurs more than once."""

    def deal(batches):
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                body, offsets = utf8(piece.column(1))
                docs_ = doc_keys(piece.column(0))
                for part, bounds, base in segments(body, offsets):
                    owner, first, more, _, key = anchored(part, bounds)
                    doc, at = docs_[owner], (first - bounds[owner] + base).astype(np.uint32)
                    _, one, label, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    known = count[label] > 1
                    yield spans_batch(n_parts, doc[known], at[known], at[known] + more[known])
                    flag = more[one] | (known[one] << 7).astype(np.uint8)
                    yield batch_of(COMPARE, pack(hash_part(key[one], n_parts), n_parts, key[one], doc[one], at[one], flag))

    def count(batches):
        held, passed = by_part(batches)
        yield given_back(passed)
        for part in sorted(held):
            key, doc, at, flag = loosened(held.pop(part), KEYS)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            pick = again & (flag < 128)
            yield spans_batch(n_parts, doc[pick], at[pick], at[pick] + flag[pick])

    return map_texts(map_texts(docs, deal, PACKED).repartitionById(n_parts, "part"), count, PACKED)


def per_document(spans: DataFrame, n_parts: int) -> DataFrame:
    """(doc, spans): merged spans of window starts of each document, as int64 pairs (first, last)."""

    def run(batches):
        import pyarrow as pa

        doc, a, b = loosened([x for batch in batches for x in batch.column(1).to_pylist()], SPAN)
        doc, a, b, new = merged(doc, a, b)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(doc)) if len(starts) else starts
        pairs = np.stack([a, b], 1)
        for i in range(0, len(starts), 5000):
            s, e = starts[i : i + 5000].tolist(), ends[i : i + 5000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc[s], pa.int64()), pa.array([pairs[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], ["doc", "spans"])

    return map_texts(spans.select("part", "body").repartitionById(n_parts, "part"), run, "doc long, spans binary")


def compressed(docs: DataFrame) -> DataFrame:
    """docs with z, the text packed for the shuffle, in place of text."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack_text = zstandard.ZstdCompressor(level=4).compress
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                body, offsets = utf8(piece.column(at))
                o, view = offsets.tolist(), memoryview(body.tobytes())
                z = pa.array([pack_text(view[a:b]) for a, b in zip(o, o[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([z if k == at else c for k, c in enumerate(piece.columns)], [z_name if k == at else n for k, n in enumerate(piece.schema.names)])

    z_name = "z"
    return map_texts(docs, run, ", ".join("z binary" if f.name == "text" else f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields))


def suffixes(rows: DataFrame, n_parts: int, sample: list[tuple[bytes, int]]) -> DataFrame:
    """The suffixes of the given spans of (doc, z, spans), dealt to their buckets; runs equal to an earlier one of the slice become spans at once."""

    def run(batches):
        import zstandard

        split, unzip = Splitters(sample, n_parts), zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []  # (doc, first window, bytes) of stretches of text

        def flush():
            size = np.array([len(x[2]) for x in held], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            body = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            owner, first, more, anchor, _ = anchored(body, bounds)
            doc = np.array([x[0] for x in held], np.int64)[owner]
            at = (first - bounds[owner] + np.array([x[1] for x in held], np.int64)[owner]).astype(np.uint32)
            held.clear()
            content, back = contents(body, first, more, anchor), (anchor - first).astype(np.uint8)
            stays = firsts(same_content(np.column_stack([content, back, more])), doc, at)
            again = ~stays
            yield spans_batch(n_parts, doc[again], at[again], at[again] + more[again])
            part = split.part(content[stays][:, LEFT : LEFT + GRAM], doc[stays])
            yield batch_of(COMPARE, pack(part, n_parts, content[stays].view(RUN[0]).ravel(), back[stays], more[stays], doc[stays], at[stays]))

        size = 0
        for batch in batches:
            for doc, z, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = unzip(z)
                for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    for first in range(a, b + 1, 1 << 20):
                        held.append((doc, first, text[first : min(b + 1, first + (1 << 20)) + LENGTH - 1]))
                        size += len(held[-1][2])
                        if size >= 1 << 20:
                            yield from flush()
                            size = 0
        if held:
            yield from flush()

    return map_texts(rows.select("doc", "z", "spans"), run, PACKED)


def sorted_buckets(dealt: DataFrame, n_parts: int, sample: list[tuple[bytes, int]]) -> DataFrame:
    """Sort each bucket and compare neighbours: packed spans that repeat, and the windows that must be compared across buckets."""

    def run(batches):
        split = Splitters(sample, n_parts)
        held, passed = by_part(batches)
        yield given_back(passed)
        for part in sorted(held):
            content, back, more, doc, at = loosened(held.pop(part), RUN)
            content = content.view(np.uint8).reshape(-1, WIDTH)
            right, left = big_endian(content[:, LEFT:]), big_endian(content[:, :LEFT])
            order = multikey_quicksort([*right.T, *left.T, back, more, doc, at])
            del right, left
            content, back, more, doc, at = (x[order] for x in (content, back, more, doc, at))
            same = (content[1:] == content[:-1]).all(1) & (back[1:] == back[:-1]) & (more[1:] == more[:-1])
            again = np.append(False, same)[: len(doc)]
            yield spans_batch(n_parts, doc[again], at[again], at[again] + more[again])
            content, back, more, doc, at = (x[~again] for x in (content, back, more, doc, at))
            gram = content[:, LEFT : LEFT + GRAM]
            new = np.append(True, (gram[1:] != gram[:-1]).any(1))[: len(doc)]
            group = np.cumsum(new) - 1
            edge = np.zeros(len(doc), bool)
            for g in split.edges(part):
                edge |= (gram == np.frombuffer(g, np.uint8)).all(1)
            pick = np.flatnonzero((np.bincount(group)[group] > 1) | edge) if len(doc) else np.zeros(0, int)
            # windows at one distance from the anchor are compared with each other; a stretch of whole groups at a time
            begin = 0
            while begin < len(pick):
                end = int(np.searchsorted(group[pick], group[pick[min(begin + 4096, len(pick)) - 1]], "right"))
                rows, hits, apart = pick[begin:end], [], []
                for r in range(-LEFT, 1):
                    mine = rows[(-r <= back[rows].astype(int)) & (r <= more[rows].astype(int) - back[rows])]
                    if len(mine):
                        window = np.ascontiguousarray(content[mine, LEFT + r : LEFT + r + LENGTH])
                        stays = firsts(same_content(window), doc[mine], at[mine])
                        place = (at[mine].astype(np.int64) + back[mine] + r).astype(np.uint32)
                        hits.append((mine[~stays], place[~stays]))
                        out = stays & edge[mine]
                        apart.append((window[out].view(WINDOW[0]).ravel(), doc[mine[out]], place[out]))
                row, place = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
                yield spans_batch(n_parts, doc[row], place, place)
                window, d, p = (np.concatenate([x[k] for x in apart]) for k in range(3))
                dealt_by = hash_part(mix64(content_hash(window.view(np.uint8).reshape(-1, LENGTH))), n_parts)
                yield batch_of(COMPARE, pack(dealt_by, n_parts, window, d, p))
                begin = end

    return map_texts(dealt.repartitionById(n_parts, "part"), run, PACKED)


def across_buckets(compared: DataFrame, n_parts: int) -> DataFrame:
    """Packed spans of the windows that are not the first of their content among those that buckets could not decide alone."""

    def run(batches):
        held, _ = by_part(batches)
        for part in sorted(held):
            window, doc, at = loosened(held.pop(part), WINDOW)
            again = ~firsts(same_content(window.view(np.uint8).reshape(-1, LENGTH)), doc, at)
            yield spans_batch(n_parts, doc[again], at[again], at[again])

    return map_texts(compared.repartitionById(n_parts, "part"), run, PACKED)


def cut_out(text: bytes, pairs: np.ndarray) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and maximal removed runs, for spans of window starts."""
    kept, at, runs, removed = [], 0, 0, 0
    for a, b in pairs.tolist():
        end = b + LENGTH
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
        removed += end - max(a, at if runs else 0)
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans) of every document of (doc, text) with repeated windows; documents are ordered by doc, a number of their own."""
    n_parts = partitions(docs.sparkSession)
    sample = sample_splitters(docs, n_parts)
    wanted = per_document(repeated_grams(docs, n_parts), n_parts)
    rows = compressed(docs).join(wanted, "doc")
    done = cut(sorted_buckets(suffixes(rows, n_parts, sample), n_parts, sample))
    spans = done.filter(F.col("kind") == SPANS).unionByName(across_buckets(done.filter(F.col("kind") == COMPARE), n_parts))
    return per_document(spans, n_parts)


def drop_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text); with_text adds the remaining bytes as kept."""
    docs = identified(docs)
    rows = compressed(docs).join(repeated_spans(docs.select("doc", "text")), "doc", "left").select("doc_id", "copies", "z", "spans")

    def run(batches):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc_id, copies, z, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unzip(z)
                kept, removed, runs = cut_out(text, np.frombuffer(spans, np.int64).reshape(-1, 2)) if spans else (text, 0, 0)
                out += [(doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else []))] * copies
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return map_texts(rows, run, RESULT + ", kept binary" * with_text)
