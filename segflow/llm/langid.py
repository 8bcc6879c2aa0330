"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the longest factors that
occur in the reference (a letter that never occurs there is a phrase of its own); the language that needs the fewest
phrases, normalised by text length and by the reference's size (phrases * log2(reference length) / text length), wins.  A letter that the reference
lacks also costs LITERAL, the bits of a code point: else a language with a tiny reference, whose phrases are cheap, would take every text.

Letters are lower-cased; a run of anything else counts as one separator.  Whole texts are parsed.  Every letter keeps its
own code: transitions on a language's most frequent letters lie in a dense table, all others in a sorted list of edges.  For
speed a text is parsed in segments that advance together, one letter at a time; a segment whose predecessor turns out to end
in another state than it was given is parsed again from that state, until nothing changes, so the phrases are those of
one parse from start to end.

Nulls: a null text, or one without a letter, gets `und` with score 0, and so does every text if no language was learned.
A null doc_id takes part in fitting like any other; a null lang is not learned, and a language is learned from labelled texts
of any length as long as they hold a letter.  Repeated rows get equal answers; equal rates go to the language that sorts first.
An empty table gives an empty result.  A text of any length is parsed whole, in the memory of one task.  Extra columns pass by
unused, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices

SEGMENT, LITERAL = 256, 21
#: Letters of a language that the dense table has columns for, and the bytes of all tables together.
DENSE, TABLE_BYTES = 40, 64 << 20


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return follow


def alphabet() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is not a letter."""
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def encode(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts end to end, runs of non-letters as one 0, and the offset of each text."""
    data = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    codes = table[np.concatenate(data)] if len(data) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(size)])
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    begins = offsets[:-1][size > 0]
    keep[begins] = codes[begins] != 0  # whatever the text before ends in
    upto = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], upto[offsets]


class Reference:
    """The suffix automaton of one language's text as arrays.

    States are numbered from 0 (the start); the last one, DEAD, follows a letter that the reference lacks and leaves by a new phrase only.
    """

    def __init__(self, codes: np.ndarray, width: int):
        follow = suffix_automaton(codes.tolist())
        letters, count = np.unique(codes, return_counts=True)
        frequent = letters[np.argsort(-count, kind="stable")[:width]]
        self.known, self.bits = letters, np.log2(max(2, len(codes)))
        self.dead, self.width = len(follow), len(frequent) + 1
        #: column of each letter; the last column stands for all that have none
        self.letters, self.columns = np.sort(frequent), np.argsort(np.argsort(frequent)).astype(np.int32)
        column = {int(c): k for k, c in enumerate(np.sort(frequent))}
        table = np.full((self.dead + 1, self.width), -1, np.int64)
        edges = []
        for state, out in enumerate(follow):
            for c, to in out.items():
                if c in column:
                    table[state, column[c]] = to
                else:
                    edges.append((state << 21 | c, to))
        restart = np.where(table[0] >= 0, table[0], self.dead)
        #: next state, or the complement of the state in which a new phrase begins
        self.table = np.where(table >= 0, table, ~restart[None, :]).astype(np.int32).ravel()
        edges.sort()
        self.keys, self.to = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32)

    def code(self, letters: np.ndarray) -> np.ndarray:
        """Column of each letter where it has one, else the complement of the letter."""
        at = np.searchsorted(self.letters, letters)
        at[at == len(self.letters)] = 0
        known = self.letters[at] == letters if len(self.letters) else np.zeros(len(letters), bool)
        return np.where(known, at, ~letters).astype(np.int32)

    def edge(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], -1) if len(self.keys) else np.full(len(key), -1, np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next state, or the complement of the state in which a new phrase begins."""
        rare = np.flatnonzero(code < 0)
        if not len(rare):
            return self.table.take(state * np.int32(self.width) + code)
        out = self.table.take(state * np.int32(self.width) + np.maximum(code, 0))
        letter = ~code[rare].astype(np.int64)
        to = self.edge(state[rare].astype(np.int64) << 21 | letter)
        begin = self.edge(letter)
        out[rare] = np.where(to >= 0, to, ~np.where(begin >= 0, begin, self.dead))
        return out

    def run(self, code: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New phrases in each segment (longest first) from the given states, and the states at their ends."""
        state, phrases = state.copy(), np.zeros(len(start), np.int32)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # segments longer than each step
        for k, m in enumerate(active.tolist()):
            to = self.step(state[:m], code[start[:m] + k])
            sign = to >> 31
            phrases[:m] -= sign
            state[:m] = to ^ sign
        return phrases, state

    def cost(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text: its phrases' references, and the letters that are not to be had from the reference."""
        at = np.searchsorted(self.known, letters)
        at[at == len(self.known)] = 0
        upto = np.concatenate([[0], np.cumsum(self.known[at] != letters)])
        return self.phrases(letters, offsets) * self.bits + LITERAL * (upto[offsets[1:]] - upto[offsets[:-1]])

    def phrases(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text, as of one greedy parse from start to end."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][owner] + within * SEGMENT
        length = np.minimum(offsets[1:][owner] - start, SEGMENT)
        code = self.code(letters)
        given, count, end = np.full(len(owner), -1, np.int32), np.zeros(len(owner), np.int64), np.full(len(owner), self.dead, np.int32)
        want = np.full(len(owner), self.dead, np.int32)
        while len(again := np.flatnonzero(given != want)):
            again = again[np.argsort(-length[again], kind="stable")]
            given[again] = want[again]
            count[again], end[again] = self.run(code, start[again], length[again], given[again])
            # a text begins in DEAD, where its first letter starts a phrase; the other segments go on where the one before ended
            want[1:] = np.where(within[1:] > 0, end[:-1], self.dead)
        return np.bincount(owner, weights=count, minlength=len(size))


class Model:
    """References of all languages.  Only their letters travel; each task builds the automata."""

    def __init__(self, codes: dict[str, np.ndarray]):
        self.codes = {lang: c for lang, c in sorted(codes.items()) if c.any()}
        self.langs = list(self.codes)

    def build(self) -> Model:
        self.letters = alphabet()
        states = 2 * sum(len(c) for c in self.codes.values())
        width = min(DENSE, max(1, TABLE_BYTES // 4 // max(1, states) - 1))
        self.references = [Reference(c, width) for c in self.codes.values()]
        return self

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised cost per text and language, and whether the text has a letter."""
        letters, offsets = encode(texts, self.letters)
        size = np.diff(offsets)
        upto = np.concatenate([[0], np.cumsum(letters != 0)])
        out = np.stack([r.cost(letters, offsets) / np.maximum(1, size) for r in self.references], 1)
        return out, upto[offsets[1:]] > upto[offsets[:-1]]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        rates, letters = self.rates(texts)
        best = rates.argmin(1)
        spread = np.exp(-8 * (rates - rates.min(1, keepdims=True)))
        score = np.where(letters, 1 / spread.sum(1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def reference(texts: list[str], chars: int) -> np.ndarray:
    """The letters of texts end to end, a separator after each, up to chars."""
    return encode([t + " " for t in texts], alphabet())[0][:chars]


def fit(labelled: DataFrame, reference_chars: int = 24_000, passage_chars: int = 3_000, seed: int = 11) -> Model:
    """Fit on (doc_id, text, lang) of labelled rows.

    A language's reference is filled up to reference_chars with its texts in a hashed order; a text longer than passage_chars gives a
    passage of that length that begins at a hashed place.  The rows that reach the driver are a hashed sample of each language, drawn so that
    about four times reference_chars are to be expected of it (all rows, if it has less).
    """
    order = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    n = F.length("text")
    place = F.when(n > passage_chars, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), n - passage_chars)).otherwise(0).cast("int")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    found: dict[str, list[str]] = {}
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.least(n, F.lit(passage_chars))).alias("n")).collect()}
    if total:
        most = {lang: 1 << 30 if 4 * reference_chars >= size else (4 * reference_chars << 30) // size for lang, size in total.items()}
        bound = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
        sample = rows.select("lang", order.alias("r"), F.substring(F.col("text"), place + 1, F.lit(passage_chars)).alias("text")).filter(F.col("r") < F.element_at(bound, F.col("lang")))
        for r in sorted(sample.collect(), key=lambda r: (r["r"], r["text"])):
            found.setdefault(r["lang"], []).append(r["text"])
    return Model({lang: reference(texts, reference_chars) for lang, texts in found.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of docs with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.codes)  # plain arrays: a broadcast may not name this package
    rows = docs.select(*keep, F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches):
        import pyarrow as pa

        model = None
        for batch in batches:
            model = model or Model(shared.value).build()
            for piece in slices(batch, 3 << 20):
                texts = [t or "" for t in piece.column(piece.num_columns - 1).to_pylist()]
                langs, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*piece.schema.names[:-1], "lang_pred", "score"])

    return map_texts(rows, run, schema)
