"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to `rate` of its length in edits.  Cut into one piece more than that budget, at least one piece
survives unchanged, so one Aho-Corasick pass over a text finds every place where an item can be; each such place is
verified with Myers' bit-parallel edit distance.  Both sides are lower-cased and every run of characters that are neither
letters nor digits counts as one space.

The test items are the stated query set: they go out in blocks of bounded size, each block against all documents, one block after
the other, so that neither the driver nor a task holds more than a block.

One rule holds for items of every length: the budget is floor(rate * length), and an item is matched with a space on either side, so that an end inside
another word costs an edit.  An item too short for a budget thus matches as whole words only.

Nulls: a null or blank text or item matches nothing, nor does one without a letter or digit; a null item_id or doc_id is reported as null.  Overlapping places
of one item in a document give one row.  Repeated documents or items each give their rows, ties between places go to the first.  A text of any length is searched
whole, in the memory of one task.  Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, numbered, slices

NOT_WORD = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the end of the first best one."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def matcher(items: list[tuple[int | None, str]], rate: float):
    """Function from a normalised text to {(item index): (edits, start, end)} of its best places."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    budgets = [int(rate * len(t)) for _, t in items]
    bounded = [f" {t} " for _, t in items]
    for k, t in enumerate(bounded):
        for at, piece in pieces(t, budgets[k]):
            automaton.add_word(piece, [*automaton.get(piece, []), (k, at + len(piece) - 1)])
    automaton.make_automaton()

    def find(text: str) -> dict[int, tuple[int, int, int]]:
        size, text = len(text), f" {text} "
        places: dict[int, set[int]] = {}
        for end, hits in automaton.iter(text):
            for k, back in hits:
                places.setdefault(k, set()).add(end - back)
        found = {}
        for k, starts in places.items():
            item, e = bounded[k], budgets[k]
            m, best = len(item), None
            run: list[list[int]] = []
            for s in sorted(starts):  # places whose windows overlap are verified together
                if run and s - e <= run[-1][1]:
                    run[-1][1] = s + m + e
                else:
                    run.append([max(0, s - e), s + m + e])
            for a, b in run:
                edits, end = myers(item, text[a:b])
                if edits <= e and (best is None or edits < best[0]):
                    back = myers(item[::-1], text[a : a + end][::-1])[1]
                    best = (edits, a + end - back, a + end)
                if best and best[0] == 0:
                    break
            if best:  # places without the spaces on either side
                found[k] = (best[0], min(best[1], size), max(min(best[1], size), min(best[2] - 2, size)))
        return found

    return find


def blocks(benchmark: DataFrame, block_chars: int):
    """The test items, a block of about block_chars characters at a time, as lists of (item_id, normalised text)."""
    sized = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    for block in range(n_blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        items = [(r["item_id"], t) for r in part if (t := normal(r["text"]))]
        yield n_blocks, sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each document and item that occurs in it, with its best place in the normalised text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for n_blocks, items in blocks(benchmark, block_chars):
        found = search(rows, items, rate)
        # a block's result is written before the next one is read
        found = cut(found) if n_blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def search(rows: DataFrame, items: list[tuple[int | None, str]], rate: float) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        find = matcher(items, rate) if items else None
        for batch in batches:
            for piece in slices(batch):
                hits = []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if find and text:
                        hits += [(doc, items[k][0], *place) for k, place in sorted(find(normal(text)).items())]
                columns = list(zip(*hits, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start", "end"])

    return map_texts(rows, run, "doc_id long, item_id long, edits long, start long, end long")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = 0.08, block_chars: int = 1_000_000) -> DataFrame:
    """docs without the rows that hold a test item.  Each row is searched and kept or dropped where it is: no join, no shuffle."""
    for n_blocks, items in blocks(benchmark, block_chars):
        docs = without(docs, items, text, rate)
        docs = cut(docs) if n_blocks > 1 else docs
    return docs


def without(docs: DataFrame, items: list[tuple[int | None, str]], text: str, rate: float) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        find = matcher(items, rate) if items else None
        for batch in batches:
            for piece in slices(batch, column=f"c{at}"):
                yield piece.filter(pa.array([not (find and t and find(normal(t))) for t in piece.column(at).to_pylist()], pa.bool_()))

    rows = numbered(docs)
    return map_texts(rows, run, rows.schema).toDF(*docs.columns)
