"""Quality rules as a short-circuit cascade.  DataFrame functions only.

A rule is a condition over measures of a document.  The base measures are part of the result, so every row pays for them and the
base rules come first.  The other rules have measures of their own, which are written into the rule's condition: all conditions
stand in one CASE, whose branches Spark evaluates in order, so a row that one rule rejects never pays for the measures
of later ones.  Their order comes from a bounded sample: rejections per second, where a rule's cost is the least time of several runs over the sample less
that of a run which evaluates nothing.  The verdict doesn't depend on the order, only the name of the first failed rule does.

Nulls: a null text has no words, so `too_short` rejects it.  Blank texts likewise.  A text of any length is measured whole.  Repeated rows are judged each for
itself.  Empty tables give empty results.  Extra columns pass through, whatever their names; those named like an output (a base measure,
failed_rule, base_failed, kept) are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, words


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(w: Column, n: int = 3) -> Column:
    """Words of array w that lie in an n-word window found twice or more in it.

    Windows become 64-bit hashes; hash and position share one long, so a primitive sort brings equal windows together
    (the full hashes are compared afterwards).  Everything happens within the row: nothing is shuffled.
    """
    position = lambda p, mask: p.bitwiseAND(mask).cast("int")

    def covered(h):
        mask = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(h) + F.lit(2.0)))).cast("long") - 1
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def marked(p):
            same = lambda x, i, d: F.get(h, position(x, mask)) == F.get(h, position(F.get(p, i + d), mask))
            hit = F.filter(p, lambda x, i: F.coalesce(same(x, i, F.lit(-1)), F.lit(False)) | F.coalesce(same(x, i, F.lit(1)), F.lit(False)))
            at = F.sort_array(F.transform(hit, lambda x: position(x, mask)))
            return let(at, lambda a: F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(n), F.get(a, i + 1) - x)), F.lit(0).cast("long"), lambda s, x: s + x))

        return let(packed, marked)

    def of(w):
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)])), 1, F.size(w) - (n - 1))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(let(w, of))


def text_lines(text: Column) -> Column:
    """Lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def base_measures(text: Column, w: Column) -> dict[str, Column]:
    """The measures that every row gets, from the text (not null) and its word array."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(text_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(w),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """name, and fails: the condition under which a document fails, from (text, words, base measures)."""

    name: str
    fails: Callable[[Column, Column, dict[str, Column]], Column]
    base: bool = False


#: Limits are wide: they catch junk and leave ordinary prose, tables and lists alone.  The base rules need base measures only.
RULES = (
    Rule("too_short", lambda t, w, m: m["n_words"] < 50, True),
    Rule("repetitive", lambda t, w, m: 100 * m["n_repeat_words"] > 50 * m["n_words"], True),
    Rule("symbols", lambda t, w, m: 100 * m["n_symbols"] > 20 * m["word_chars"]),
    Rule("word_length", lambda t, w, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
    Rule("duplicate_lines", lambda t, w, m: let(F.size(text_lines(t)), lambda n: (n >= 10) & (100 * m["n_dup_lines"] > 60 * n))),
    Rule("few_distinct_words", lambda t, w, m: F.size(F.array_distinct(w)) < 12),
    Rule("no_letters", lambda t, w, m: 100 * F.size(F.filter(w, lambda x: x.rlike("^[!-@\\[-`{-~]+$"))) > 70 * m["n_words"]),
    Rule("cut_off_lines", lambda t, w, m: let(text_lines(t), lambda x: (F.size(x) >= 5) & (100 * F.size(F.filter(x, lambda y: y.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))) > 60 * F.size(x)))),
)


class Measured:
    """Rows of docs with their words and base measures under names that docs doesn't have."""

    def __init__(self, docs: DataFrame, text: str):
        self.columns, self.text = docs.columns, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        w, base = fresh(docs, "words"), fresh(docs, "base")
        # explode of a one-element array keeps the split from being copied into each expression that uses it
        split = docs.select("*", F.explode(F.array(words(self.text))).alias(w))
        made = base_measures(self.text, F.col(w))
        # and this one keeps a measure from being evaluated again by each rule that reads it
        self.rows = split.select("*", F.explode(F.array(F.struct(*[e.alias(k) for k, e in made.items()]))).alias(base))
        self.words, self.base = F.col(w), {k: F.col(base).getField(k) for k in BASE}

    def fails(self, rule: Rule) -> Column:
        return F.coalesce(rule.fails(self.text, self.words, self.base), F.lit(False))


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = 1000, fraction: float = 0.05, seed: int = 7, text: str = "text", runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), base rules first, then best rejections per second.  The sample holds at most sample_rows rows."""
    sample = docs.select(text).sample(fraction, seed=seed).limit(sample_rows)
    m = Measured(sample, text)
    held = m.rows.repartition(4).persist()
    try:
        n = max(1, held.count())
        own = [r for r in rules if not r.base]
        rejected = held.agg(*[F.count_if(m.fails(r)).alias(f"r{k}") for k, r in enumerate(rules)]).first()

        def seconds(condition: Column) -> float:
            took = []
            for _ in range(runs):
                began = time.perf_counter()
                held.agg(F.count_if(condition)).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        nothing = seconds(m.base["n_words"] < 0)
        found = [(r, 0.0 if r.base else max(1e-4, seconds(m.fails(r)) - nothing), rejected[f"r{k}"] / n) for k, r in enumerate(rules)]
        return [x for x in found if x[0].base] + sorted((x for x in found if x[0] in own), key=lambda x: (-x[2] / x[1], x[1]))
    finally:
        held.unpersist()


def cascade(m: Measured, ordered: list[Rule]) -> DataFrame:
    """The columns of the measured rows with the base measures, failed_rule (the first in order that rejects, else null), base_failed and kept."""
    first = None
    base = F.lit(False)
    for r in ordered:
        first = F.when(m.fails(r), F.lit(r.name)) if first is None else first.when(m.fails(r), F.lit(r.name))
        base = base | m.fails(r) if r.base else base
    verdict = fresh(m.rows, "verdict")
    judged = m.rows.select("*", F.explode(F.array(first if first is not None else F.lit(None).cast("string"))).alias(verdict))
    made = m.base | {"failed_rule": F.col(verdict), "base_failed": base, "kept": F.col(verdict).isNull()}
    return judged.select(*[F.col(f"`{c}`") for c in m.columns if c.lower() not in made], *[e.alias(k) for k, e in made.items()])


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text", **sampling) -> DataFrame:
    """docs with the base measures, failed_rule, base_failed and kept; rule order comes from a sample of docs."""
    ordered = [r for r, _, _ in order_rules(docs, rules, text=text, **sampling)]
    return cascade(Measured(docs, text), ordered)
