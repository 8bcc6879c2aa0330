"""Token-ID output: one wavelet matrix per shard.

Documents are range-partitioned by doc_id, encoded with a public tokenizer, and packed in ascending doc_id order into
shards of a bounded number of tokens.  A shard is one file body: a header, the document table (ids and lengths), and the
bit-planes of the wavelet matrix (each compressed, with rank counts per 512 bits).  From the body alone one can read any
token, count a token in a range and find its k-th occurrence.  Shards travel in a binary column, so any store that Spark
can write holds them.

Encoding goes by the finest pieces that give the tokenizer's own ids (tested when it is loaded): parts of words, words, or whole texts.  The tokenizer encodes
each distinct piece once per task.

Nulls: a null text is empty (it only gets the end id); a null doc_id sorts first.  Repeated ids are ordered by a hash of the
text, then the text.  An empty table writes no shard.  A text of any length is encoded whole, and its shard grows with it.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, partitions, slices, utf8

MAGIC, BLOCK = b"WMX1", 512
#: Bytes of text that are encoded together.
SLICE = 1 << 20
SHARDS = "part int, seq int, n_docs long, n_tokens long, body binary"
DECODED = "part int, seq int, k long, doc_id long, local long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Succinct sequence of n symbols below 2**levels; plane[0] is the most significant bit."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, x: np.ndarray, levels: int) -> WaveletMatrix:
        planes, ranks, zeros, n = [], [], [], len(x)
        for b in range(levels - 1, -1, -1):
            bits = (x & x.dtype.type(1 << b)) != 0
            packed = np.packbits(bits, bitorder="little")
            planes.append(packed)
            ranks.append(cls.directory(packed))
            low = np.flatnonzero(~bits)
            zeros.append(len(low))
            x = np.concatenate([x.take(low), x.take(np.flatnonzero(bits))])
        return cls(n, planes, ranks, zeros)

    @staticmethod
    def directory(packed: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-max(1, len(packed)) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        tail = self.planes[level][block * (BLOCK // 8) : (i + 7) // 8]
        return int(self.ranks[level][block]) + int(np.unpackbits(tail, bitorder="little")[: i - block * BLOCK].sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of bit in a plane."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        symbol = 0
        for level in range(len(self.planes)):
            bit = self.planes[level][i // 8] >> (i % 8) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            symbol = symbol << 1 | int(bit)
        return symbol

    def _run(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's run starts in the last order, and where the occurrences before position end stop."""
        a, b = 0, end
        for level in range(len(self.planes)):
            a1, b1 = self.rank1(level, a), self.rank1(level, b)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                a, b = self.zeros[level] + a1, self.zeros[level] + b1
            else:
                a, b = a - a1, b - b1
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i."""
        if symbol >> len(self.planes) or not self.n:
            return 0
        a, b = self._run(symbol, i)
        return b - a

    def locate(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of symbol."""
        i = self._run(symbol, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out, zero = np.empty_like(x), self.zeros[level]
            out[np.flatnonzero(~bits)] = x[:zero]
            out[np.flatnonzero(bits)] = x[zero:] | x.dtype.type(1 << (len(self.planes) - 1 - level))
            x = out
        return x

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        out = [struct.pack("<QI", self.n, len(self.planes))]
        for plane, rank, zero in zip(self.planes, self.ranks, self.zeros, strict=True):
            body = pack(plane.tobytes())
            out.append(struct.pack("<QII", zero, len(body), len(rank)) + body + rank.tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> WaveletMatrix:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        n, levels = struct.unpack_from("<QI", data, at)
        at += 12
        planes, ranks, zeros = [], [], []
        for _ in range(levels):
            zero, size, blocks = struct.unpack_from("<QII", data, at)
            at += 16
            planes.append(np.frombuffer(unpack(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8))
            ranks.append(np.frombuffer(data, np.uint32, blocks, at + size))
            zeros.append(zero)
            at += size + 4 * blocks
        return cls(n, planes, ranks, zeros)


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, levels: int) -> bytes:
    head = MAGIC + struct.pack("<I", len(doc_ids)) + doc_ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + lengths.astype("<u4").tobytes()
    return head + WaveletMatrix.build(ids, levels).to_bytes()


def open_shard(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, validity, lengths and the wavelet matrix of a shard."""
    if body[:4] != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<I", body, 4)
    docs = np.frombuffer(body, "<i8", n, 8)
    valid = np.frombuffer(body, "u1", n, 8 + 8 * n).view(bool)
    lengths = np.frombuffer(body, "<u4", n, 8 + 9 * n)
    return docs, valid, lengths, WaveletMatrix.from_bytes(body, 8 + 13 * n)


#: Letters of two bytes, all of which begin with this one, that pieces() counts as letters.
LATIN, LATIN_LEAD = "".join(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7)), 0xC3
LETTERS = frozenset(LATIN + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def piece_classes() -> np.ndarray:
    """Class of each byte for pieces(): 0 gap, 1 letter, 2 digit, 3 other mark, 4 what only a whole word tells (quotes, markup, control and most non-ASCII bytes)."""
    table = np.full(256, 4, np.uint8)
    table[33:127] = 3
    table[[ord("'"), ord("<")]] = 4
    table[48:58] = 2
    table[65:91] = table[97:123] = 1
    table[[32, 10]] = 0
    return table


def pieces(body: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts laid end to end: their bytes without gaps, the bounds of the pieces in these, and pieces up to the end of each text.

    Words lie between spaces and line feeds.  With classes, a word of letters (ASCII and LATIN), digits and marks alone falls into letter runs, single digits and runs of
    marks; any other word stays whole.
    """
    kind = (piece_classes() if classes is None else classes)[body]
    inside = kind != 0
    new = np.zeros(len(body) + 1, bool)
    new[offsets[:-1]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new[1:-1]
    kept, first, at = kind[inside], first[inside], np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    body = body[inside]
    if classes is not None and len(kept):
        lead = np.flatnonzero(body[:-1] == LATIN_LEAD)
        lead = lead[(body[lead + 1] & 0xBF != 0x97) & (body[lead + 1] != 0xB7)]
        kept[lead] = kept[lead + 1] = 1
        words = np.flatnonzero(first)
        whole = np.maximum.reduceat(kept, words) == 4
        kept[np.repeat(whole, np.diff(np.append(words, len(kept))))] = 4
        first[1:] |= kept[1:] != kept[:-1]
        first |= kept == 2
    starts = np.flatnonzero(first)
    return body, np.append(starts, len(kept)).astype(np.int32), np.searchsorted(starts, at[offsets[1:]])


class Encoder:
    """Ids of texts, a piece at a time: each distinct piece is encoded once by the tokenizer and remembered.

    Which pieces give the ids of the whole text depends on the tokenizer.  When it is loaded, the finest of three cuts that does so on PROBES and on random strings is chosen:
    parts of words (see pieces()), words, or whole texts; whether the tokenizer's model alone does for plain letters is tested likewise.  The memory of pieces is two halves of at most half of memo_bytes and what one call of known()
adds: when the newer one is full, it takes the older one's place, into which a piece comes back when it is met again.  Pieces longer than LONG are not remembered.
    """

    LONG = 64
    PROBES = ("Two  words, it's 3.14!\nNext line\n\n  indented Été ÜBER", "a\u0301 \u0301b ﬁn ½ 10,000 x_y <|endoftext|> <|a|>", " lead and trail \n", "日本語 текст\tтаб\r\nend e\u0301", "×÷ aà×b ÷é É1é ¿Qué? «Où» –ñ", "don't  won't'll ''s ## $5 A1b2C3 x--y ... (a) [B] {c}; 1.2.3,4 e.g. a@b.c/d?e=f&g")

    def __init__(self, path: str, memo_bytes: int = 128 << 20):
        import random

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo_bytes = memo_bytes
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.mark_id, self.mark = (special[0][0], special[0][1].encode()) if special else (-1, None)
        rng = random.Random(1)
        # plain letters may reach the model without normaliser and pre-tokenizer, as they are or in lower case, in the pre-tokenizer's spelling of bytes
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        spelt = {ord(c): "".join(x for x, _ in pre.pre_tokenize_str(c)) for c in LATIN} | {i: i for i in range(128)} if pre is not None else {}
        letters = ["".join(rng.choice("etaoinshrdluETAOINzqxj" + LATIN * (i % 2)) for _ in range(rng.randrange(1, 15))) for i in range(400)]
        ways = [lambda w: w.decode().translate(spelt), lambda w: w.decode().lower().translate(spelt)]  # of one word, or of words with line feeds between
        direct = lambda way, w: array("I", [t.id for t in model.tokenize(way(w.encode()))]).tobytes()
        self.spell = next((f for f in ways if all(direct(f, w) == self.whole(w) for w in letters)), None)
        probes = [*self.PROBES, *("".join(chr(rng.randrange(32, 127)) for _ in range(rng.randrange(40))) for _ in range(200))]
        for self.by in ("parts", "words", "texts"):
            if all(self.cut_ids(t) == self.whole(t) for t in probes):
                break
        self.forget()

    def forget(self) -> None:
        self.memo, self.older = {}, {}

    def whole(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def cut_ids(self, text: str) -> bytes:
        """Ids of a text piece by piece."""
        data = text.encode("utf-8", "replace")
        if self.by == "texts":
            return self.whole(text)
        body, bounds, _ = pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]), piece_classes() if self.by == "parts" else None)
        flat = body.tobytes()
        self.forget()
        return b"".join(self.known([flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]))

    def together(self, found: list[bytes], at_once: int = 20) -> list[bytes]:
        """Ids of each of some pieces, a few to a call: a special token between them, which no piece may hold, tells where one ends."""
        if self.mark is None or any(self.mark[:1] in w for w in found):
            return [self.whole(w.decode("utf-8", "replace")) for w in found]
        out: list[bytes] = []
        groups = [found[i : i + at_once] for i in range(0, len(found), at_once)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            if len(cuts) != len(group) - 1:
                out += [self.whole(w.decode("utf-8", "replace")) for w in group]
                continue
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip([0, *(x + 4 for x in cuts)], [*cuts, len(flat)], strict=True)]
        return out

    def known(self, found: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        # with its id bytes and its place, an entry of LONG bytes takes no more than 300 bytes
        if 600 * len(self.memo) > self.memo_bytes:
            self.memo, self.older = {}, self.memo
        memo, older, spell, tokenize = self.memo, self.older, self.spell, self.tokenizer.model.tokenize
        out = list(map(memo.get, found))
        letters, rest = [], []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = found[k]
            ids = older.get(w)
            if ids is not None:
                out[k] = memo[w] = ids
            elif spell is not None and len(w) <= self.LONG and (w.isalpha() or set(w.decode("utf-8", "replace")) <= LETTERS):
                letters.append(k)
            else:
                rest.append(k)
        if letters:
            for k, w in zip(letters, spell(b"\n".join([found[k] for k in letters])).split("\n"), strict=True):
                out[k] = memo[found[k]] = array("I", [t.id for t in tokenize(w)]).tobytes()
        for i in range(0, len(rest), 500):
            part = rest[i : i + 500]
            words = [found[k] for k in part]
            for k, w, ids in zip(part, words, self.together(words), strict=True):
                out[k] = ids
                if len(w) <= self.LONG:
                    memo[w] = ids
        return out

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts (each followed by end_id) and the count per text; null counts as empty."""
        import pyarrow as pa

        if self.by == "texts":
            known = [self.whole(t or "") for t in texts.to_pylist()]
            at, ends = np.arange(len(known)), np.arange(1, len(known) + 1)
        else:
            body, bounds, ends = pieces(*utf8(texts), piece_classes() if self.by == "parts" else None)
            code = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(body)]).dictionary_encode()
            known, at = self.known(code.dictionary.to_numpy(zero_copy_only=False).tolist()), code.indices.to_numpy()
        # the end id is one more piece, which stands after each text's last
        places = np.full(len(at) + len(ends), len(known), np.int32)
        mine = np.ones(len(places), bool)
        mine[ends + np.arange(len(ends))] = False
        places[mine] = at
        known.append(array("I", [end_id]).tobytes())
        ids = pa.array(known, pa.large_binary()).take(pa.array(places))
        _, upto, flat = ids.buffers()
        upto = np.frombuffer(upto, np.int64)[: len(places) + 1] // 4
        flat = np.frombuffer(flat, np.uint32)[: upto[-1]] if len(places) else np.zeros(0, np.uint32)
        return flat, np.diff(upto[ends + np.arange(len(ends)) + 1], prepend=0)


#: The encoder of a Python worker, by its tokenizer's file: loaded once, and pieces of one task are known to the next.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]



def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 21, levels: int = 16, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Shards (part, seq, n_docs, n_tokens, body) of all documents in ascending order of the columns order, then of the text.

    part is the range partition, seq the shard within it; a shard closes after the slice (SLICE bytes) of texts with which it
    reaches shard_tokens tokens.  A task holds one Arrow batch and one open shard.  Token ids must be below 2**levels.
    """
    n = partitions(docs.sparkSession)
    places = [f"p{k}" for k in range(len(order))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)])
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *places, "h").sortWithinPartitions(*places, "h", "text").select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        open_ids: list[np.ndarray] = []
        open_docs: list[tuple] = []
        names = [x.split()[0] for x in SHARDS.split(", ")]

        def close():
            nonlocal seq, held
            ids = np.concatenate(open_ids)
            open_ids.clear()
            docs_, valid, lengths = (np.concatenate([x[i] for x in open_docs]) for i in range(3))
            open_docs.clear()
            body = shard_bytes(ids, docs_, valid, lengths, levels)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())], names)
            seq, held = seq + 1, 0
            return row

        for batch in batches:
            encoder = encoder_of(tokenizer_path)
            for piece in slices(batch, SLICE):
                ids, counts = encoder.encode(piece.column(1), end_id)
                if len(ids) and int(ids.max()) >> levels:
                    raise ValueError("a token id does not fit the given levels")
                column = piece.column(0)
                open_ids.append(ids.astype(np.uint16 if levels <= 16 else np.uint32))
                open_docs.append((column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_valid().to_numpy(zero_copy_only=False)), counts))
                held += len(ids)
                if held >= shard_tokens:
                    yield close()
        if open_docs:
            yield close()

    return map_texts(rows, run, SHARDS)


def write_shards(shards: DataFrame, path: str) -> None:
    """One Parquet file per shard."""
    shards.write.option("maxRecordsPerFile", 1).option("parquet.enable.dictionary", "false").option("compression", "uncompressed").mode("errorifexists").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def decode_documents(shards: DataFrame) -> DataFrame:
    """Per document of every shard: its place k, ids before it in the shard, token count and crc32 of its ids."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DECODED.split(", ")]
        for batch in batches:
            for part, seq, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                docs, valid, lengths, matrix = open_shard(body.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), lengths.tolist(), strict=True)]
                m = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, seq, np.int32)), pa.array(np.arange(m)), pa.array(docs, mask=~valid), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names,
                )

    return map_texts(shards, run, DECODED)


def with_starts(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: counts are summed per shard, then per range partition, before they add up."""
    shard = decoded.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    part = shard.groupBy("part").agg(F.sum("n").alias("n"))
    part = part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    shard = shard.join(part, "part").withColumn("base", F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).drop("n")
    return decoded.join(shard, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
