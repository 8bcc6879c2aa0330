"""Cross-tokenizer alignment with external spill counting.

A text is encoded by two tokenizers whose tokens cover the same bytes.  Places where tokens of both end cut it into groups; an A token and a B token are linked
where their bytes overlap.  A pair of ids counts the documents of the whole corpus that hold it linked.

1. Spill: each slice of texts writes its pair-document records as zstd runs, radix-partitioned by a hash of the A id and sorted side-major (by A id, then B id,
   then document).  The runs are written once to the shared folder, with what is known of the documents.
2. Count: only the pairs of the runs and their numbers of documents move to their partition.  A k-way heap merge over the runs' chunks adds them up; as runs
   are side-major, an A id's highest count is known as soon as its pairs have passed.
3. Stream back: each run's counts and which of them are its A id's highest return to its slice and meet its records there, in the run's order.

A pair that is in every document sends one number per slice, never one per document, so no partition holds a hot pair's documents.

Nulls: a null or empty text has no tokens, nor has one whose tokens' bytes differ from its own (after a leading space).  A null doc_id passes through.  Repeated rows
are documents of their own.  Ties: every pair with its A id's highest count is best.  A text of any length is encoded whole, in the memory of one task.  Empty tables
give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, mix64, partitions, slices

#: Bytes of text in a slice (a longer text is one of its own) and pairs in a chunk of a run.
SLICE, CHUNK = 2 << 20, 1 << 14
#: Bits of a B id in a pair's code.
B_BITS = 24
#: Part of the row that holds a slice's documents.
DOCS = -1
RUNS = "slice long, part int, pairs binary, records binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side:
    """Bytes of every id of a vocabulary, laid end to end, and the ids as decimal texts followed by each separator."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)
        # separators: another token of the side, the other side, the next group, the end
        self.texts = np.array([f"{k}{s}" for s in (",", "|", ";", "") for k in range(len(tokens))], object)
        self.size = len(tokens)

    def token(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.start[k] + self.length[k]].tobytes()

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        upto = np.cumsum(n)
        return self.bytes[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.start[ids] - upto + n, n)]


class Encoders:
    """The two tokenizers, their ids' bytes, and encoding of many texts at once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        byte = byte_of_character()
        vocabulary = self.a.get_vocab()
        names = dict(zip(vocabulary.values(), vocabulary.keys(), strict=True))
        self.side_a = Side([bytes(byte[c] for c in names[k]) if all(c in byte for c in names.get(k, "")) and k in names else b"" for k in range(max(names) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.side_b = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.ranked = ranked(a_path, self.side_a)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return [self.a.encode(t, add_special_tokens=False).ids if UNSETTLED.search(t) else self.ranked.encode_ordinary(t) for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


#: Ranges in which versions of Unicode differ about letters and digits: texts with any of these are left to the tokenizer as they are.
UNSETTLED = re.compile("[\u0530-\u1dff\u2080-\u209f\ua7c0-\uabff\U00010000-\U0010ffff]")


def ranked(a_path: str, side: "Side"):
    """A quicker encoder of the same ids, where the file is a plain byte-level one whose ids are the order of its merges; else None."""
    import json

    import public_tokenizers
    import tiktoken

    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    vocabulary = model.get("vocab", {})
    made = [vocabulary.get("".join(m.split(" ", 1) if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    if not plain or sorted(set(made)) != made or (made and made[0] < 256) or len(made) + 256 != len(vocabulary):
        return None
    ranks = {side.token(k): k for k in vocabulary.values()}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)


def aligned(encoders: Encoders, texts: list[str]):
    """Per text: n_a, n_b, n_groups, n_links and the digest of its groups; and the links of all texts as arrays: pair code and text number.

    Texts whose tokens' bytes differ from their own have no tokens.
    """
    spaced = [(" " + t) if t else "" for t in texts]
    a, n_a = flat(encoders.encode_a(spaced))
    b, n_b = flat(encoders.encode_b([t or "" for t in texts]))
    side_a, side_b = encoders.side_a, encoders.side_b
    want = [t.encode("utf-8", "surrogatepass") for t in spaced]
    size = np.array([len(w) for w in want], np.int64)
    owner_a, owner_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    good = size > 0
    joined = np.frombuffer(b"".join(want) or b"\0", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    for side, ids, owner in ((side_a, a, owner_a), (side_b, b, owner_b)):
        good &= np.bincount(owner, side.length[ids], len(texts)).astype(np.int64) == size
        good &= np.bincount(owner, side.length[ids] == 0, len(texts)) == 0
        fits = good[owner]
        mine = np.repeat(good, size)
        same = np.zeros(len(mine), bool)
        same[mine] = side.joined(ids[fits]) == joined[: bounds[-1]][mine]
        wrong = np.flatnonzero(mine & ~same)
        good[np.searchsorted(bounds, wrong, "right") - 1] = False
    keep_a, keep_b = good[owner_a], good[owner_b]
    a, b, owner_a, owner_b = a[keep_a], b[keep_b], owner_a[keep_a], owner_b[keep_b]
    n_a, n_b = n_a * good, n_b * good
    end_a, end_b = np.cumsum(side_a.length[a]), np.cumsum(side_b.length[b])  # good texts end together on both sides
    # all ends in order, those of both sides once: each ends one link, between the tokens that are open there
    order = np.argsort(np.concatenate([end_a, end_b]), kind="stable")
    is_a, every = order < len(a), np.concatenate([end_a, end_b])[order]
    twice = np.append(every[1:] == every[:-1], False)[: len(every)]  # an A end before the B end at the same byte
    lone = np.append(True, ~twice[:-1])[: len(every)]
    has_a, both = is_a[lone], twice[lone]
    has_b = ~has_a | both
    link_a, link_b = np.cumsum(has_a) - has_a, np.cumsum(has_b) - has_b
    owner = owner_a[link_a]
    n_links = np.bincount(owner, minlength=len(texts))
    n_groups = np.bincount(owner[both], minlength=len(texts))
    code = a[link_a] << B_BITS | b[link_b]

    # tokens in the order of the digest: by group, side and place, each followed by its separator
    group = np.cumsum(both) - both
    group_a, group_b = group[has_a], group[has_b]
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    ends_doc = np.append(owner_b[1:] != owner_b[:-1], True)[: len(b)]
    parts_a = side_a.texts[a + side_a.size * last_a]
    parts_b = side_b.texts[b + side_b.size * np.where(ends_doc, 3, np.where(last_b, 2, 0))]
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=1)) for g in (group_a, group_b))
    place_a = np.arange(len(a)) + np.append(0, upto_b)[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    parts = np.empty(len(a) + len(b), object)
    parts[place_a], parts[place_b] = parts_a, parts_b
    parts = parts.tolist()
    shas, at = [], 0
    for n in (n_a + n_b).tolist():
        shas.append(hashlib.sha256("".join(parts[at : at + n]).encode()).hexdigest() if n else "")
        at += n
    return n_a, n_b, n_groups, n_links, shas, code, owner


def planes(*columns: np.ndarray) -> bytes:
    """Whole numbers of equal count, differences of the first column, byte plane by byte plane, compressed."""
    import zstandard

    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    raw = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def from_planes(data: bytes, n_columns: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = [np.ascontiguousarray(c.reshape(8, -1).T).view("<u8").ravel() for c in raw.reshape(n_columns, -1)] if len(raw) else [np.zeros(0, np.uint64)] * n_columns
    return [np.cumsum(out[0]), *out[1:]]


def chunked(*columns: np.ndarray) -> bytes:
    """A run as chunks of CHUNK rows, each with its length in front."""
    out = []
    for i in range(0, len(columns[0]), CHUNK):
        body = planes(*(c[i : i + CHUNK] for c in columns))
        out += [len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def chunks(data: bytes, n_columns: int):
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        yield from_planes(data[at + 4 : at + 4 + n], n_columns)
        at += 4 + n


def table_bytes(columns: dict) -> bytes:
    """An Arrow table as bytes."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def spilled(docs: DataFrame, a_path: str, b_path: str, n_parts: int) -> DataFrame:
    """Runs of all slices: one row per slice and part with its pairs (and numbers of documents) and its records, and one row with the slice's documents."""

    def run(batches):
        import pyarrow as pa

        encoders, task, number = Encoders(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, SLICE):
                texts = piece.column(1).to_pylist()
                n_a, n_b, n_groups, n_links, shas, code, owner = aligned(encoders, texts)
                rows = [(DOCS, b"", table_bytes({"doc_id": piece.column(0), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": shas}))]
                # records: pair, document and how often the document links the pair
                record, times = np.unique(code * len(texts) + owner, return_counts=True)
                pair, doc = record // len(texts), record % len(texts)
                part = radix(pair, n_parts)
                order = np.argsort(part, kind="stable")
                begin = 0
                for p, n in enumerate(np.bincount(part, minlength=n_parts).tolist()):
                    if n:
                        pick = order[begin : begin + n]
                        each, docs_of = np.unique(pair[pick], return_counts=True)
                        rows.append((p, chunked(each, docs_of), planes(doc[pick], times[pick])))
                    begin += n
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task << 32 | number)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["slice", "part", "pairs", "records"])
                number += 1

    return map_texts(docs, run, RUNS)


def radix(pair: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of each pair, by its A id."""
    return ((mix64((pair >> B_BITS).astype(np.uint64)) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def merged_runs(runs: list[bytes]):
    """k-way merge of side-major runs, in steps of whole A ids: (pair, count, is best) of a step, and of each run that has pairs in it its number and its pairs' places there.

    A heap holds, for every run, the last A id of its chunks at hand.  Runs below the median read on until they reach it, so all pairs of A ids below the
    median are at hand, and a step takes a good part of every run's chunk.
    """
    sources = [chunks(r, 2) for r in runs]
    at_hand: list[list[np.ndarray]] = []
    heap: list[tuple[int, int]] = []
    end = 1 << 62

    def read_on(k: int) -> None:
        following = next(sources[k], None)
        if following is None:
            heapq.heappush(heap, (end, k))
            return
        at_hand[k] = [np.concatenate([x, y]) for x, y in zip(at_hand[k], following, strict=True)]
        heapq.heappush(heap, (int(at_hand[k][0][-1]) >> B_BITS, k))

    for k in range(len(runs)):
        at_hand.append([np.zeros(0, np.uint64)] * 2)
        read_on(k)
    while heap:
        bound = sorted(last for last, _ in heap)[len(heap) // 2]
        while heap[0][0] < bound:
            read_on(heapq.heappop(heap)[1])
        taken = []
        for r, (pair, n) in enumerate(at_hand):
            upto = int(np.searchsorted(pair, np.uint64(bound << B_BITS))) if bound < end else len(pair)
            if upto:
                taken.append((r, pair[:upto], n[:upto]))
                at_hand[r] = [pair[upto:], n[upto:]]
        if taken:
            pair, where = np.unique(np.concatenate([t[1] for t in taken]), return_inverse=True)
            count = np.zeros(len(pair), np.int64)
            np.add.at(count, where, np.concatenate([t[2] for t in taken]).astype(np.int64))
            a = pair >> np.uint64(B_BITS)
            new = np.append(True, a[1:] != a[:-1])
            best = count == np.maximum.reduceat(count, np.flatnonzero(new))[np.cumsum(new) - 1]
            ends = np.cumsum([len(t[1]) for t in taken]).tolist()
            yield count, best, [(t[0], where[e - len(t[1]) : e]) for t, e in zip(taken, ends, strict=True)]
        if bound == end:
            return
        while not taken and heap[0][0] == bound:  # every chunk at hand is of one A id: take in more of it
            read_on(heapq.heappop(heap)[1])


def counted(runs: DataFrame, n_parts: int) -> DataFrame:
    """(slice, part, answer): for every run, in its order, the count of each pair and whether it is the highest of its A id."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for number, part, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((number, pairs))
        for part in sorted(held):
            runs_ = held.pop(part)
            answers: list[list[bytes]] = [[] for _ in runs_]
            for count, best, places in merged_runs([r for _, r in runs_]):
                for k, where in places:
                    body = planes(count[where] << 1 | best[where])
                    answers[k] += [len(body).to_bytes(4, "little"), body]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in runs_], pa.int64()), pa.array([part] * len(runs_), pa.int32()), pa.array([b"".join(a) for a in answers], pa.binary())], ["slice", "part", "answer"])

    return map_texts(runs.filter(F.col("part") != DOCS).select("slice", "part", "pairs").repartitionById(n_parts, "part"), run, "slice long, part int, answer binary")


def contributions(runs: DataFrame, answers: DataFrame, n_parts: int) -> DataFrame:
    """The result's rows: each slice's records meet the answers of its runs, part by part, and add up to its documents."""
    none = F.lit(None).cast("binary")
    met = runs.select("slice", "part", F.lit(0).alias("kind"), "pairs", "records").unionByName(answers.select("slice", "part", F.lit(1).alias("kind"), none.alias("pairs"), F.col("answer").alias("records")))
    met = met.repartition(n_parts, "slice").sortWithinPartitions("slice", "part", "kind")

    def run(batches):
        import pyarrow as pa

        docs = None

        def flush():
            columns = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": docs.column("groups_sha256")}
            return pa.Table.from_pydict(columns).combine_chunks().to_batches()

        for batch in batches:
            for part, kind, pairs, records in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if part == DOCS:
                    if docs is not None:
                        yield from flush()
                    docs = pa.ipc.open_stream(records).read_all()
                    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                elif kind == 0:
                    doc, times = (x.astype(np.int64) for x in from_planes(records, 2))
                    docs_of = np.concatenate([c[1] for c in chunks(pairs, 2)]).astype(np.int64)
                else:
                    answer = np.concatenate([c[0] for c in chunks(records, 1)]).astype(np.int64)
                    each = np.repeat(answer, docs_of)
                    np.add.at(best, doc, times * (each & 1))
                    np.add.at(total, doc, times * (each >> 1))
        if docs is not None:
            yield from flush()

    return map_texts(met, run, RESULT)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    a_path is a byte-level tokenizer of the tokenizers library, b_path a sentencepiece model that puts a space in front.
    """
    n_parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = cut(spilled(rows, a_path, b_path, n_parts))
    return contributions(runs, counted(runs, n_parts), n_parts)
