"""Greedy packing of ordered rows: a row opens a new group when a rule on the group so far says so.

Where the rule looks only at the row before, a window finds the breaks.  Otherwise rows are cut at such hard breaks
first, and only the stretches in between are folded, each as an array of small structs.  Rules without hard breaks go by
blocks of rows whose jump tables compose (jumps.py), so a media item may be of any length and is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jumps import BLOCK_ROWS, grouped
from .scan import CELL_ROWS, scan


def groups_of(items: Column, state: dict[str, Column], breaks: Callable, update: Callable) -> Column:
    """Array of groups (arrays) of items.

    breaks(state, item) says whether item opens a new group; update(state, item, new) gives the next state's fields.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), *[v.alias(k) for k, v in state.items()])

    def step(s, x):
        new = (s["i"] == 0) | breaks(s, x)
        fields = update(s, x, new)
        return F.struct(F.when(new, F.array_append(s["starts"], s["i"])).otherwise(s["starts"]).alias("starts"), (s["i"] + 1).alias("i"), *[fields[k].cast(t).alias(k) for k, t in kinds.items()])

    kinds = {k: "string" if k in ("speaker",) else "long" for k in state}
    start = F.struct(start["starts"].alias("starts"), start["i"].alias("i"), *[start[k].cast(t).alias(k) for k, t in kinds.items()])
    starts = F.aggregate(items, start, step, lambda s: s["starts"])
    ends = lambda a, k: F.coalesce(F.get(a, k + 1), F.size(items))
    return F.element_at(F.transform(F.array(starts), lambda a: F.transform(a, lambda s, k: F.slice(items, s + 1, ends(a, k) - s))), 1)


def packed(rows: DataFrame, keys: list[str], order: list[str], state, breaks, update, group: str, base: list[str] | None = None) -> DataFrame:
    """rows with a group number (from 0) per keys; base are keys within keys whose stretches number on together."""
    others = [c for c in rows.columns if c not in keys]
    item = F.struct(*order, *[c for c in others if c not in order])
    arrays = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items")).withColumn("_items", F.explode(F.array("_items")))
    out = arrays.select(*keys, F.posexplode(groups_of(F.col("_items"), state, breaks, update)).alias("_g", "_rows"))
    if base is not None:
        number = F.row_number().over(Window.partitionBy(*base).orderBy(*[k for k in keys if k not in base], "_g")) - 1
        out = out.withColumn("_g", number)
    return out.select(*keys, F.col("_g").cast("long").alias(group), F.explode("_rows").alias("_row")).select(*keys, group, *[F.col(f"_row.{c}").alias(c) for c in others])


def merge_segments(segments: DataFrame, max_chars: int = 500, max_gap_ms: int = 300, extra: tuple[str, ...] = ()) -> DataFrame:
    """PK1: neighbours of one speaker with a gap of at most max_gap_ms become one segment of at most max_chars characters.

    The text joins with spaces, the end is the last piece's; columns named in extra (translations) join likewise; nulls among them
    are skipped.  Returns media_id, seg_idx (new numbering), speaker, text, start_ms, end_ms, n_pieces and extra.
    """
    by = Window.partitionBy("media_id").orderBy("start_ms", "seg_idx")
    hard = F.coalesce((F.lag("speaker").over(by) != F.col("speaker")) | (F.col("start_ms") - F.lag("end_ms").over(by) > max_gap_ms), F.lit(True))
    runs = segments.select("media_id", "seg_idx", "speaker", "text", "start_ms", "end_ms", *extra).withColumn("run", F.sum(hard.cast("int")).over(by))
    n = lambda x: F.length(x["text"])
    grouped = packed(runs, ["media_id", "run"], ["start_ms", "seg_idx"], {"chars": F.lit(0)}, lambda s, x: s["chars"] + n(x) + 1 > max_chars, lambda s, x, new: {"chars": F.when(new, n(x)).otherwise(s["chars"] + n(x) + 1)}, "piece")
    order = F.struct("start_ms", "seg_idx")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "seg_idx", F.col(c).alias("v")))), lambda x: x["v"]), " ").alias(c)
    merged = grouped.groupBy("media_id", "run", "piece").agg(F.min_by("speaker", order).alias("speaker"), joined("text"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), F.count("*").alias("n_pieces"), *[joined(c) for c in extra])
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("run", "piece")) - 1
    return merged.select("media_id", number.cast("int").alias("seg_idx"), "speaker", "text", "start_ms", "end_ms", "n_pieces", *extra)


def speaker_groups(segments: DataFrame, max_pause_ms: int = 3000, max_span_ms: int = 60_000) -> DataFrame:
    """PK2: per speaker, a new group after a pause of more than max_pause_ms or when the group would span more than max_span_ms."""
    by = Window.partitionBy("media_id", "speaker").orderBy("start_ms", "seg_idx")
    hard = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by) > max_pause_ms, F.lit(True))
    runs = segments.withColumn("run", F.sum(hard.cast("int")).over(by))
    return packed(runs, ["media_id", "speaker", "run"], ["start_ms", "seg_idx"], {"begin": F.lit(0)}, lambda s, x: x["end_ms"] - s["begin"] > max_span_ms, lambda s, x, new: {"begin": F.when(new, x["start_ms"]).otherwise(s["begin"])}, "grp", ["media_id", "speaker"]).drop("run")


def translation_chunks(segments: DataFrame, max_segments: int = 10, max_switches: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """PK3: segments with chunk numbers; a chunk holds max_segments segments and max_switches changes of speaker at most."""

    def step(state, speaker):
        if state is None:
            return True, (1, 0, speaker)
        n, switches, before = state
        switches += before is not None and speaker is not None and before != speaker
        new = n >= max_segments or switches > max_switches
        return new, (1, 0, speaker) if new else (n + 1, switches, speaker)

    return grouped(segments, ["media_id"], "seg_idx", ["speaker"], step, "chunk_idx", block_rows)


def chunk_summary(chunked: DataFrame) -> DataFrame:
    """Per chunk: number of segments, start, end and the sorted set of speakers."""
    return chunked.groupBy("media_id", "chunk_idx").agg(F.count("*").alias("n_segments"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))


def block_chunks(blocks: DataFrame, max_ms: int = 900_000, least_ms: int = 300_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """PK4: consecutive blocks (media_id, block_idx, dur_ms) in chunks of at most max_ms; a last chunk under least_ms joins the one before.

    Returns media_id, chunk_idx, offset_ms, dur_ms, n_blocks.
    """

    def step(state, dur):  # once a duration is null the sum is too, and nothing breaks any more
        total = dur if state is None else None if state[0] is None or dur is None else state[0] + dur
        new = state is None or (total is not None and total > max_ms)
        return new, (dur if new else total,)

    cut = grouped(blocks, ["media_id"], "block_idx", ["dur_ms"], step, "chunk_idx", block_rows)
    chunks = cut.groupBy("media_id", "chunk_idx").agg(F.sum("dur_ms").alias("dur_ms"), F.count("*").alias("n_blocks"))
    by = Window.partitionBy("media_id").orderBy("chunk_idx")
    last = F.lead("chunk_idx").over(by).isNull()
    chunks = chunks.withColumn("chunk_idx", F.when(last & (F.col("dur_ms") < least_ms) & (F.col("chunk_idx") > 0), F.col("chunk_idx") - 1).otherwise(F.col("chunk_idx")))
    chunks = chunks.groupBy("media_id", "chunk_idx").agg(F.sum("dur_ms").alias("dur_ms"), F.sum("n_blocks").alias("n_blocks"))
    return chunks.select("media_id", "chunk_idx", (F.sum("dur_ms").over(by) - F.col("dur_ms")).alias("offset_ms"), "dur_ms", "n_blocks")


def split_long_segments(segments: DataFrame, max_chars: int = 420, least_tail: int = 50) -> DataFrame:
    """PK5: segments with a words array whose text exceeds max_chars are split word by word.

    On overflow the piece ends at its last word that ends a sentence, unless all words left after that one have fewer than
    least_tail characters; without such a word it ends before the overflowing word.  Times come from its words.
    """
    w = F.col("words")
    long = (F.length("text") > max_chars) & (F.size("words") > 0)
    # state: pieces so far as (from, to) word numbers, first word of the open piece, its length, its last sentence end
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(-1).alias("stop"), F.lit(0).alias("i"))
    ends = F.aggregate(w, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + F.length(x["word"]) + 1))
    rows = segments.filter(long).withColumn("_upto", F.explode(F.array(ends)))
    upto, total = F.col("_upto"), F.element_at(F.col("_upto"), -1)

    def step(s, x):
        n = F.length(x["word"])
        stop = F.when(x["word"].rlike("[.!?]$"), s["i"]).otherwise(s["stop"])
        grown = F.when(s["n"] == 0, n).otherwise(s["n"] + 1 + n)
        ended = stop >= s["a"]
        cut = (grown > max_chars) & ~(ended & (total - F.get(upto, stop + 1) - 1 < least_tail))
        b = F.when(ended, stop).when(s["i"] > s["a"], s["i"] - 1).otherwise(s["i"])
        a = F.when(cut, b + 1).otherwise(s["a"])
        length = F.when(cut, F.greatest(F.lit(0), F.get(upto, s["i"] + 1) - F.get(upto, a) - 1)).otherwise(grown)
        # what follows the cut may overflow with this word at once
        again = cut & (length > max_chars) & (s["i"] > a)
        piece = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
        done = F.when(cut, F.array_append(s["done"], piece(s["a"], b))).otherwise(s["done"])
        done = F.when(again, F.array_append(done, piece(a, s["i"] - 1))).otherwise(done)
        return F.struct(done.alias("done"), F.when(again, s["i"]).otherwise(a).alias("a"), F.when(again, n).otherwise(length).alias("n"), F.when(cut, -1).otherwise(stop).alias("stop"), (s["i"] + 1).alias("i"))

    pieces = F.aggregate(w, start, step, lambda s: F.filter(F.array_append(s["done"], F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b"))), lambda p: p["a"] <= p["b"]))
    rows = rows.select("*", F.posexplode(pieces).alias("piece_idx", "_p"))
    part = F.slice("words", F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a") + 1)
    rows = rows.withColumn("_part", part)
    split = rows.select("media_id", "seg_idx", "piece_idx", "speaker", F.array_join(F.transform("_part", lambda x: x["word"]), " ").alias("text"), F.col("_part")[0]["start_ms"].alias("start_ms"), F.element_at("_part", -1)["end_ms"].alias("end_ms"))
    whole = segments.filter(~long).select("media_id", "seg_idx", F.lit(0).alias("piece_idx"), "speaker", "text", "start_ms", "end_ms")
    return whole.unionByName(split)


def halve_failed(lines: DataFrame, keys: tuple[str, ...] = ("media_id", "chunk_idx")) -> DataFrame:
    """PK8: each failed chunk (rows with line_no from 0) as two, cut at n // 2; half says which."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return lines.withColumn("half", F.when(F.col("line_no") < F.floor(n / 2), 0).otherwise(1).cast("int"))


def align_sentences(sentence_table: DataFrame, tokens: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """JN5: sentences (media_id, sent_idx, n_words, text) with the times of the word tokens (media_id, tok_idx, start_ms, end_ms) they take up.

    Sentence k takes tokens from where k-1 stopped, as many as it has words; sentences beyond the last token drop out, and so do tokens
    beyond the last sentence.  A running count gives each sentence its first and last token; it is marked in each cell of cell_rows tokens
    that it reaches, and the last mark in a token's cell is its sentence's.  Texts stay out of this and join the sentences' few times.
    """
    counted = scan(sentence_table.select("media_id", "sent_idx", F.col("n_words").cast("long").alias("n_words")), ["media_id"], ["sent_idx"], cell_rows, sums={"_upto": F.col("n_words")})
    spans = counted.filter("n_words > 0").select("media_id", "sent_idx", (F.col("_upto") - F.col("n_words")).alias("first_tok"), (F.col("_upto") - 1).alias("last_tok"))
    cells = F.sequence(F.floor(F.col("first_tok") / cell_rows), F.floor(F.col("last_tok") / cell_rows))
    marks = spans.select("media_id", F.explode(cells).alias("cell"), F.col("first_tok").alias("at"), F.lit(0).alias("kind"), F.struct("sent_idx", "last_tok").alias("s"))
    rows = tokens.select("media_id", F.col("tok_idx").cast("long").alias("at"), F.lit(1).alias("kind"), "start_ms", "end_ms").withColumn("cell", F.floor(F.col("at") / cell_rows))
    # dealt anew, so that no sort stands over both sides' sorts in one task
    both = rows.unionByName(marks, allowMissingColumns=True).repartition("media_id", "cell")
    found = both.withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy("media_id", "cell").orderBy("at", "kind"))).filter("kind = 1 AND at <= s.last_tok")
    parts = found.groupBy("media_id", "cell", F.col("s.sent_idx").alias("sent_idx")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("start_ms", "at").alias("start_ms"), F.max_by("end_ms", "at").alias("end_ms"), F.count("*").alias("n"))
    texts = sentence_table.select("media_id", "sent_idx", "text")
    whole = parts.drop("cell").unionByName(texts, allowMissingColumns=True).groupBy("media_id", "sent_idx")
    return whole.agg(F.min("text").alias("text"), F.min_by("start_ms", "first").alias("start_ms"), F.max_by("end_ms", "last").alias("end_ms"), F.sum("n").alias("n_tokens")).filter("n_tokens > 0")
