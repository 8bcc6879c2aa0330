"""Mixing sources to target weights with a low-discrepancy source schedule.  DataFrame functions only.

Each source's documents are laid end to end in a fixed shuffled order and that stream is cut into blocks of equal
word counts.  Slot i of the mix takes the golden-ratio point frac(i * phi); the cumulative target shares say which
source owns that point, and the k-th slot of a source plays its k-th block.  The few blocks that find no slot of
their own fill the slots that a source could not use, so every source ends exactly at its rounded target.

A document's place in the mix is the first slot that plays words of it; mixed_documents() returns the mix in that order.

Nulls: a null source is a source of its own (last in order); a null or blank text has size 0, takes part in nothing
and is returned with 0 and no slot.  An empty table gives an empty result.  Repeated rows and repeated ids count as documents of
their own: ties are ordered by a hash of all columns, so only rows that are equal throughout can stand for each other.  A text of any length is cut at blocks.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, row_hash, whole_row, words

#: Modulus and multiplier of the integer golden-ratio sequence (multiplier / modulus = 0.6180339887).
PERIOD, GOLDEN = 2**31, 1327217885


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(3, 1, 2)) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of share * total, none above cap * its size.

    Sharing out the excess again and again by weight ends where every uncapped source gets level * weight; the level
    is found directly: sort sources by cap / weight, and take the first place whose level stays below its own ratio.
    Works on one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("level", (total * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", F.least("most", F.coalesce(level * F.col("weight"), "most")).alias("target"))


def running_start(df: DataFrame, keys: list[str], coarse: str, order: list, size: str, out: str) -> DataFrame:
    """Exclusive running sum of size per keys over (coarse, order), in two steps so that a hot key spreads over its coarse parts."""
    parts = df.groupBy(*keys, coarse).agg(F.sum(size).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(coarse)
    parts = parts.withColumn("_base", F.sum("_n").over(upto) - F.col("_n")).drop("_n")
    joined = df.join(parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(coarse).alias("_coarse"), "_base"), [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys] + [df[coarse] == F.col("_coarse")])
    inner = Window.partitionBy(*keys, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_base") + F.sum(size).over(inner) - F.col(size)).drop(*[f"_{k}" for k in keys], "_coarse", "_base")


def mix_schedule(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(3, 1, 2), block_words: int = 1024, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, pieces).

    documents: row_id, doc_id, same (hash of the row), source, size, source_size, target.
    pieces: slot (place in the mix), source_no, block, row_id, doc_id, p (pass over the source), from_word, n_words; ordering by slot, then block offset,
    gives the mix.  Every piece is a run of words of one document.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("row.doc_id").cast("string")))
    sized = docs.select(whole_row(docs).alias("row"), F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = sized.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", key.alias("key"), row_hash(docs, "row").alias("same"))
    sized = cut(sized)
    targets = source_targets(sized, share, cap, weights)
    # The rest of the plan only handles numbers: one row per document, then one per block.
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * F.lit(int(cap)))
    targets = targets.withColumn("source_no", no).withColumn("quota", quota)
    targets = targets.withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    everything = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    all_blocks = F.greatest(F.sum("blocks").over(Window.partitionBy()), F.lit(1))
    upto = F.sum("blocks").over(everything)
    targets = cut(targets.withColumn("lo", F.floor((upto - F.col("blocks")) / all_blocks * F.lit(float(PERIOD))).cast("long")).withColumn("hi", F.floor(upto / all_blocks * F.lit(float(PERIOD))).cast("long")))
    n_slots = targets.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]

    # Documents in stream order: [start, start + size) of their source's shuffled stream.
    t = targets.select(F.col("source").alias("_s"), "source_no", "source_size", "target", "quota")
    placed = sized.join(t, sized["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumn("coarse", F.substring("key", 1, 3))
    placed = running_start(placed, ["source_no"], "coarse", ["key", "doc_id", "size", "same"], "size", "start")
    placed = cut(placed.withColumn("row_id", F.monotonically_increasing_id()).drop("key", "coarse"))

    # Blocks of each document in both passes over the stream, cut off at the quota.
    passes = placed.filter("size > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(int(cap) - 1))))
    passes = passes.withColumn("a", F.col("start") + F.col("p") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), "quota")).filter("a < b")
    pieces = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words))))
    begin = F.greatest("a", F.col("block") * block_words)
    pieces = pieces.select("source_no", "block", "row_id", "doc_id", "p", (begin - F.col("a")).alias("from_word"), (F.least("b", (F.col("block") + 1) * block_words) - begin).alias("n_words"))

    # Slots: golden-ratio points through the cumulative shares.  Cells turn the range look-up into an equi-join.
    cell = PERIOD // 4096
    cells = targets.filter("hi > lo").select("source_no", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    u = (F.col("slot") % PERIOD) * GOLDEN % PERIOD
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", u).withColumn("cell", F.floor(F.col("u") / cell)).join(cells, "cell").filter("lo <= u AND u < hi").select("slot", "source_no", "blocks", F.floor(F.col("slot") / 65536).alias("chunk"), F.lit(1).alias("one"))
    ranked = cut(running_start(slots, ["source_no"], "chunk", ["slot"], "one", "block"))
    own = ranked.filter("block < blocks").select("slot", "source_no", "block")
    # A source met fewer slots than blocks by the sequence's discrepancy (a few dozen at most); others had as many too many.
    met = ranked.groupBy("source_no").agg(F.count("*").alias("met"))
    short = targets.join(met, "source_no", "left").filter(F.col("blocks") > F.coalesce("met", F.lit(0))).select("source_no", F.explode(F.sequence(F.coalesce("met", F.lit(0)), F.col("blocks") - 1)).alias("block"))
    short = short.withColumn("r", F.row_number().over(Window.orderBy("block", "source_no")))
    spare = ranked.filter("block >= blocks").select("slot", F.row_number().over(Window.orderBy("slot")).alias("r"))
    schedule = own.unionByName(short.join(spare, "r").select("slot", "source_no", "block"))
    return placed.select("row_id", "doc_id", "same", "source", "size", "source_size", "target"), pieces.join(schedule, ["source_no", "block"])


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words that the mix takes from it), first_slot (place of the first of them in
    the schedule, null if none) and n_pieces (runs of words that its slots play)."""
    documents, pieces = mix_schedule(docs, **options)
    taken = pieces.groupBy("row_id").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    out = documents.join(taken, "row_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "source", "size", "source_size", "target", number("taken"), "first_slot", number("n_pieces"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with docs' columns: a row for each pass that takes words of a document, in the order of first slots.

    Partitions hold consecutive stretches of the schedule, each sorted, so files written from the result hold the mix in order.  Only a document in which a source
    reaches its target is cut (after the words taken, which single spaces then join); all others stay whole.  n_chars, if there, follows the text.
    """
    documents, pieces = mix_schedule(docs, **options)
    taken = pieces.groupBy("row_id", "p").agg(F.sum("n_words").alias("n"), F.min("slot").alias("slot"))
    # equal rows are told apart by number
    number = lambda d, order: d.withColumn("r", F.row_number().over(Window.partitionBy("id", "same").orderBy(order)))
    takes = number(documents.select(F.col("doc_id").alias("id"), "same", "row_id", "size"), "row_id").join(taken, "row_id")
    takes = takes.select(F.col("id").alias("i"), F.col("same").alias("s"), F.col("r").alias("k"), "n", "size", "slot", "p", "row_id")
    rows = docs.select(whole_row(docs).alias("row")).select("row", F.col("row.doc_id").alias("id"), row_hash(docs, "row").alias("same"))
    rows = number(rows, F.lit(1))
    # the number is compared outside the join keys, so the rows numbered above need no second shuffle
    joined = rows.join(takes, rows["id"].eqNullSafe(F.col("i")) & (rows["same"] == F.col("s")) & (F.abs(F.col("r") - F.col("k")) < 1))
    whole = F.col("row.text")
    text = F.when(F.col("n") >= F.col("size"), whole).otherwise(F.array_join(F.slice(words(whole), 1, F.col("n").cast("int")), " "))
    n_parts = partitions(docs.sparkSession)
    n_slots = taken.agg(F.max("slot")).first()[0] or 0
    joined = joined.select("row", text.alias("text"), "slot", "row_id", "p", F.floor(F.col("slot") * n_parts / (n_slots + 1)).cast("int").alias("part"))
    joined = joined.repartitionById(n_parts, "part").sortWithinPartitions("slot", "row_id", "p")
    made = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
