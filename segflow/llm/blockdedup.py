"""Exact substring dedup by fixed-block anchors.

A word goes when a window of WINDOW words over it has a word sequence that starts anywhere else too, in its own document or in another.

1. Index: every document is cut into non-overlapping blocks of BLOCK words.  BLOCK is (WINDOW + 1) / 2, so every window holds a whole block of its own
   document, and wherever the window's words occur again, that block occurs there too, in whatever position.
2. Probe: the block hashes and those of every rolling window of BLOCK words are dealt out by hash and met there.  A rolling window is a hit where its
   hash is also a block's in another place.
3. Extend: the WINDOW-word windows around the hits are the only ones that can repeat.  They are dealt out by 96 bits of hash and counted;
   neighbouring repeats merge to maximal exact repeats.  Extending hit by hit would compare all pairs of a group of copies; here a group costs its size.

Windows that occur twice in one slice of texts are known to repeat there and go out once, so a hot passage sends one row of a packed block per slice.
Only the hash chooses a block; a window repeats if its hash (96 bits over 64-bit word hashes) does.

Nulls: a null text has no words; a null doc_id is an id like another.  Rows that repeat id and text are documents of their own, so that all their windows
repeat.  Ties don't matter, as all places of a repeat go.  A very long text is hashed in stretches, but its bytes are in one task's memory.  Empty tables give
empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, identified, map_texts, mix64, partitions, slices, utf8, word_spans
from .suffixdedup import COMPARE, PACKED, SPANS, batch_of, by_part, compressed, doc_keys, given_back, hash_part, join_hash, per_document, spans_batch

WINDOW, BLOCK = 35, 18
#: Bytes of text whose words are hashed together, and words of candidate windows that are.
SLICE, WORDS = 8 << 20, 1 << 20
#: Bytes of a block's hash that are kept; its part holds further bits, more of them the more parts there are.
KEY = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def rolling(key: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, from the words' hashes; places whose words run beyond the end get values without meaning."""
    h, width = key, 1
    while 2 * width <= n:
        h = join_hash(h, np.append(h[width:], np.zeros(min(width, len(h)), np.uint64)))
        width *= 2
    rest = n - width
    return mix64(join_hash(h, np.append(h[rest:], np.zeros(min(rest, len(h)), np.uint64)))) if rest else mix64(h)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of whole numbers, plane by plane, which packs well where high bytes agree."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64).view(np.uint64), prepend=np.uint64(0))


def packed_places(part: np.ndarray, n_parts: int, doc: np.ndarray, at: np.ndarray, known: np.ndarray, *keys: tuple[np.ndarray, int]):
    """(part, body) rows: places (document and word number, whether already known to repeat) with keys of the given widths, dealt out by part."""
    order = np.argsort(part.astype(np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            pick = order[begin:end]
            columns = [planes(differences(doc[pick]), 8), planes(differences(at[pick]), 4), known[pick].astype(np.uint8).tobytes(), *(planes(k[pick], w) for k, w in keys)]
            yield p, np.int64(end - begin).tobytes() + b"".join(columns)
        begin = end


def unpacked_places(bodies: list[bytes], *widths: int) -> list[np.ndarray]:
    """doc, at, known and the keys of packed places."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    out: list[list] = [[] for _ in range(3 + len(widths))]
    while bodies:
        body = unzip(bodies.pop())
        n, at = int(np.frombuffer(body, np.int64, 1)[0]), 8
        out[0].append(np.cumsum(from_planes(body, n, 8, at)).view(np.int64))
        out[1].append(np.cumsum(from_planes(body, n, 4, at + 8 * n)).astype(np.uint32))
        out[2].append(np.frombuffer(body, np.uint8, n, at + 12 * n) > 0)
        at += 13 * n
        for k, w in enumerate(widths):
            out[3 + k].append(from_planes(body, n, w, at))
            at += w * n
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.uint32, bool, *[np.uint64] * len(widths)), strict=True)]


def stretches(body: np.ndarray, offsets: np.ndarray, most: int):
    """(word hashes, first word of each document, place of its first word in it, words in it, whether more of it follows).

    A single longer document comes in stretches that share WINDOW - 1 words, so that every window is in one of them.
    """
    if len(offsets) > 2 or len(body) <= most:
        start, _, key = word_spans(body, offsets)
        first = np.searchsorted(start, offsets)
        yield key, first[:-1], np.zeros(len(first) - 1, np.int64), np.diff(first), False
        return
    low, base = 0, 0
    gaps = np.isin(body, np.frombuffer(SPACE_CHARS.encode(), np.uint8))
    while True:
        high = low + most
        if high < len(body):
            more = np.flatnonzero(gaps[high : high + most])
            high = high + int(more[0]) if len(more) else len(body)
        part = body[low : min(high, len(body))]
        start, _, key = word_spans(part, np.array([0, len(part)]))
        last = high >= len(body)
        yield key, np.zeros(1, np.int64), np.array([base]), np.array([len(key)]), not last
        if last:
            return
        if len(key) >= WINDOW:
            low, base = low + int(start[len(key) - WINDOW + 1]), base + len(key) - WINDOW + 1
        most *= 1 + (len(key) < 2 * WINDOW)  # very long words


def counted(key: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(class number, size) of each place by equal keys."""
    order = np.lexsort(key[::-1]) if len(key) > 1 else np.argsort(key[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        held = k[order]
        new[1:] |= held[1:] != held[:-1]
    label = np.empty(len(order), np.int64)
    label[order] = np.cumsum(new) - 1
    return label, np.bincount(label)


def probes(docs: DataFrame, n_parts: int) -> DataFrame:
    """Packed places of every rolling window of BLOCK words, dealt out by hash; those whose number is a multiple of BLOCK are the index's blocks."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, SLICE):
                body, offsets = utf8(piece.column(1))
                docs_ = doc_keys(piece.column(0))
                for key, first, base, size, more in stretches(body, offsets, SLICE):
                    count = np.maximum(0, size - (WINDOW if more else BLOCK) + 1) * (size >= WINDOW)
                    owner = np.repeat(np.arange(len(count)), count)
                    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    h = rolling(key, BLOCK)[nth + first[owner]]
                    at = nth + base[owner]
                    yield batch_of(COMPARE, packed_places(hash_part(h, n_parts), n_parts, docs_[owner], at, np.zeros(len(at), bool), (h, KEY)))

    return map_texts(docs, run, PACKED)


def hits(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Packed spans of the windows around every rolling window whose hash is that of a block elsewhere."""

    def run(batches):
        held, _ = by_part(batches)
        for part in sorted(held):
            doc, at, _, key = unpacked_places(held.pop(part), KEY)
            label, size = counted((key,))
            indexed = np.zeros(len(size), bool)
            indexed[label[at % BLOCK == 0]] = True
            pick = (indexed & (size > 1))[label]
            doc, at = doc[pick], at[pick].astype(np.int64)
            yield spans_batch(n_parts, doc, np.maximum(0, at - (WINDOW - BLOCK)), at)

    return map_texts(dealt.repartitionById(n_parts, "part"), run, PACKED)


def candidates(rows: DataFrame, n_parts: int) -> DataFrame:
    """Windows of the spans of (doc, z, spans), dealt out by hash; those that repeat in one slice become spans at once, and one of them goes out for all."""

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []  # document, first word, window starts, word hashes

        def flush():
            count = [len(x[2]) for x in held]
            doc, at = np.repeat(np.array([x[0] for x in held], np.int64), count), np.concatenate([x[1] + x[2] for x in held])
            place = np.concatenate([x[2] for x in held]) + np.repeat(np.cumsum([0] + [len(x[3]) for x in held[:-1]]), count)
            key = np.concatenate([x[3] for x in held])
            held.clear()
            h, g = rolling(key, WINDOW)[place], rolling(mix64(~key), WINDOW)[place] & np.uint64(0xFFFFFFFF)
            label, size = counted((h, g))
            again = size[label] > 1
            _, one = np.unique(label, return_index=True)
            yield spans_batch(n_parts, doc[again], at[again], at[again])
            yield batch_of(COMPARE, packed_places(hash_part(h[one], n_parts), n_parts, doc[one], at[one], again[one], (h[one], 8), (g[one], 4)))

        words = 0
        for batch in batches:
            for doc, z, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = np.frombuffer(unzip(z), np.uint8)
                pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
                for key, _, base, size, _ in stretches(body, np.array([0, len(body)]), SLICE):
                    cover = np.zeros(int(size[0]) + 1, np.int32)
                    low, high = np.clip(pairs[:, 0] - base[0], 0, len(key)), np.clip(pairs[:, 1] + 1 - base[0], 0, len(key))
                    np.add.at(cover, low, 1)
                    np.add.at(cover, high, -1)
                    starts = np.flatnonzero(np.cumsum(cover[:-1])[: max(0, len(key) - WINDOW + 1)] > 0)
                    if not len(starts):
                        continue
                    held.append((doc, int(base[0]), starts, key))
                    words += len(key)
                    if words >= WORDS:
                        yield from flush()
                        words = 0
        if held:
            yield from flush()

    return map_texts(rows.select("doc", "z", "spans"), run, PACKED)


def repeats(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Packed spans of the windows whose hash occurs in more than one place."""

    def run(batches):
        held, passed = by_part(batches)
        yield given_back(passed)
        for part in sorted(held):
            doc, at, known, *key = unpacked_places(held.pop(part), 8, 4)
            label, size = counted(tuple(key))
            pick = (size[label] > 1) & ~known
            yield spans_batch(n_parts, doc[pick], at[pick].astype(np.int64), at[pick].astype(np.int64))

    return map_texts(dealt.repartitionById(n_parts, "part"), run, PACKED)


def untouched(docs: DataFrame) -> DataFrame:
    """doc, doc_id, copies and the results of texts without repeats elsewhere; of rows that are repeated themselves every window repeats."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for copies, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = copies > 1 and len(words) >= WINDOW
                out.append((len(words), len(words) if gone else 0, hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc", "copies", "doc_id", "n_words", "gone", "sha"])

    return map_texts(docs, run, "doc long, copies int, doc_id long, n_words long, gone long, sha string")


def kept_words(rows: DataFrame, with_text: bool) -> DataFrame:
    """(doc, n_removed, kept_sha256): what is left of (doc, z, spans) without the words under the windows of the spans."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, kept, at = unzip(z).split(), [], 0
                for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    kept += words[at:a]
                    at = max(at, b + WINDOW)
                kept += words[at:]
                left = b" ".join(kept)
                out.append((len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc", "n_removed", "kept_sha256", "kept"])

    return map_texts(rows.select("doc", "z", "spans"), run, "doc long, n_removed long, kept_sha256 string, kept string")


def drop_repeated_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text); with_text adds the kept words, joined by one space, as kept.

    kept is null for a text that loses nothing: such a text stays as it is.
    """
    docs = identified(docs)
    n_parts = partitions(docs.sparkSession)
    around = per_document(hits(probes(docs.select("doc", "text"), n_parts), n_parts), n_parts)
    # only documents with hits move on, and are read twice from here
    rows = cut(compressed(docs.select("doc", "text")).join(around, "doc"))
    done = repeats(candidates(rows, n_parts), n_parts)
    left = kept_words(rows.drop("spans").join(per_document(done, n_parts), "doc"), with_text)
    out = untouched(docs).join(left, "doc", "left")
    gone = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    removed = F.when(gone, F.col("gone")).otherwise(F.coalesce("n_removed", "gone"))
    sha = F.when(gone, F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha"))
    kept = [F.when(gone, "").otherwise(F.col("kept")).alias("kept")] if with_text else []
    out = out.select("copies", "doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), *kept)
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")
