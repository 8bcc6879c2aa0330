"""The translation job around a pluggable model: contexts, prompts, checks, repair and cached calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import map_texts, pieces
from ..functions.text import strip
from .cache import look_up
from .packing import halve_failed

PAIRS = "array<struct<speaker:string,text:string>>"
REFINED = "array<struct<speaker:string,text:string,very_short:string,short:string,long:string>>"
CONTEXT = "struct<domain:string,terminology:array<string>,tone:string,themes:array<string>,chapters:array<struct<title:string,summary:string,start_time:string>>,overall_summary:string>"


def chunk_text(chunked: DataFrame) -> DataFrame:
    """SC15: per chunk its 'speaker: text' lines, and the lines as an array of pairs."""
    lines = F.sort_array(F.collect_list(F.struct("seg_idx", "speaker", "text")))
    rows = chunked.groupBy("media_id", "chunk_idx").agg(lines.alias("l"))
    joined = F.array_join(F.transform("l", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n")
    return rows.select("media_id", "chunk_idx", joined.alias("text"), F.transform("l", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("pairs"))


def with_context(chunks: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """WN3: chunks with the texts of up to `before` chunks before and `after` chunks behind them (blank-line separated)."""
    by = Window.partitionBy("media_id").orderBy("chunk_idx")
    return chunks.withColumn("context_before", F.concat_ws("\n\n", *[F.lag("text", k).over(by) for k in range(before, 0, -1)])).withColumn("context_after", F.concat_ws("\n\n", *[F.lead("text", k).over(by) for k in range(1, after + 1)]))


def glossary_section(glossary: dict[str, str]) -> str:
    return "".join(f"- {k} = {v}\n" for k, v in glossary.items())


def render(template: Column, values: dict[str, Column]) -> Column:
    """SC16: the template with every {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


#: Own prompt texts: what each persona asks of a translation; one that is not listed falls back to normal.
PERSONAS = {
    "normal": "Translate faithfully.",
    "casual_manager": "Speak like a relaxed colleague in a meeting: plain verbs, no slogans.",
    "child": "Use words that a ten-year-old knows, and short sentences.",
    "housewife": "Keep it warm and practical, with comparisons from home life.",
    "science_popularizer": "Explain terms in passing and keep the wonder of the subject.",
    "it_buddy": "Talk like a fellow developer; common technical words stay as they are.",
    "ai_buddy": "Talk like a friend who works on machine learning; its usual terms stay as they are.",
    "pedantic": "Be exact: full sentences, no contractions, every qualification kept.",
    "ai_visioner": "Sound confident about the future, without adding claims.",
    "poet": "Give the lines rhythm and images, without losing a fact.",
    "pushkin_style": "Use the measured, slightly archaic tone of classical verse tales.",
    "adhd_clarity": "One thought a sentence; the point first, the detail after it.",
}
#: The heading under which a prompt states its persona's rules; the next heading ends them.
RULES_HEADING = "# Rules of the persona"
TEMPLATES = {
    "translate": "{persona}\nTranslate from {source} to {target}.\nTerms:\n{glossary}Before:\n{before}\nText:\n{text}\nAfter:\n{after}",
    "refine": "Polish a translation from {source} to {target} for speaking aloud.\n\n" + RULES_HEADING + "\n{persona}\n\n# Terms\n{glossary}\n# About\n{domain}; {tone}\n{summary}\n\n# Before\n{before}\n\n# Original\n{text}\n\n# Translation\n{translated}\n\n# After\n{after}\n\nGive every line a very short, a short and a long form too.",
    "adjust": "Say the {source} text in {target} in about {target_chars} characters.\n{persona_rules}\nTerms:\n{glossary}Text:\n{text}",
}


def persona_rules(prompt: Column) -> Column:
    """SC16: what a prompt says under the persona's heading, up to the next heading or its end; empty if it has none."""
    return strip(F.regexp_extract(prompt, r"(?s)" + RULES_HEADING + r"\n(.*?)(?=\n# |$)", 1))


def prompts(chunks: DataFrame, source: str, target: str, glossary: dict[str, str] | None = None, persona: str = "normal", template: str = "translate") -> DataFrame:
    """SC16: chunks (with context; to refine, with their translation too) and their prompt.  Columns that a template names and chunks lack are left empty."""
    rules = F.lit(PERSONAS.get(persona, PERSONAS["normal"]))
    fixed = {"persona": rules, "source": F.lit(source), "target": F.lit(target), "glossary": F.lit(glossary_section(glossary or {}))}
    own = {"before": "context_before", "after": "context_after", "domain": "domain", "tone": "tone", "summary": "summary", "translated": "translated", "target_chars": "target_chars", "persona_rules": "persona_rules", "text": "text"}
    named = {k: F.col(c).cast("string") if c in chunks.columns else F.lit("") for k, c in own.items()}
    return chunks.withColumn("prompt", render(F.lit(TEMPLATES[template]), fixed | named))


def check_translation(rows: DataFrame, raw: str = "raw", pairs: str = "pairs") -> DataFrame:
    """VAL1: parsed (array of pairs) and reason: null if the answer is JSON with as many lines as asked and the same speakers in order."""
    parsed = rows.withColumn("parsed", F.from_json(raw, PAIRS))
    same = F.forall(F.zip_with("parsed", pairs, lambda a, b: F.coalesce(a["speaker"] == b["speaker"], F.lit(False))), lambda x: x)
    reason = (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty")
        .when(F.col("parsed").isNull(), "not json")
        .when(F.size("parsed") != F.size(pairs), "line count")
        .when(~same, "speaker")
    )
    return parsed.withColumn("reason", reason)


def repair_refinement(rows: DataFrame, last_attempt: bool = False) -> DataFrame:
    """VAL2: refined pairs with bad ones replaced by the original, wrong speakers corrected, missing short and long texts filled.

    needs_retry if anything was repaired, unless it is the last attempt; failed if the counts differ, and then the original stays.
    """
    counts = F.col("refined").isNotNull() & (F.size("refined") == F.size("pairs"))

    def fix(r, o):
        bad = r.isNull() | (F.trim(F.coalesce(r["text"], F.lit(""))) == "")
        text = F.when(bad, o["text"]).otherwise(r["text"])
        return F.struct(o["speaker"].alias("speaker"), text.alias("text"), F.coalesce(r["very_short"], text).alias("very_short"), F.coalesce(r["short"], text).alias("short"), F.coalesce(r["long"], text).alias("long"), (bad | ~F.coalesce(r["speaker"] == o["speaker"], F.lit(False)) | r["short"].isNull() | r["long"].isNull()).alias("repaired"))

    plain = F.transform("pairs", lambda o: F.struct(o["speaker"].alias("speaker"), o["text"].alias("text"), o["text"].alias("very_short"), o["text"].alias("short"), o["text"].alias("long"), F.lit(False).alias("repaired")))
    out = rows.withColumn("failed", ~counts).withColumn("lines", F.when(counts, F.zip_with("refined", "pairs", fix)).otherwise(plain))
    return out.withColumn("needs_retry", F.lit(not last_attempt) & (F.col("failed") | F.exists("lines", lambda x: x["repaired"])))


def zip_lines(rows: DataFrame, left: str = "pairs", right: str = "lines") -> DataFrame:
    """JN8: line i of left beside line i of right per chunk; chunks whose counts differ give one row with line_no null."""
    fits = F.size(left) == F.size(right)
    pairs = F.when(fits, F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b")))
    z = rows.select("media_id", "chunk_idx", F.posexplode_outer(pairs).alias("line_no", "z"))
    return z.select("media_id", "chunk_idx", "line_no", F.col("z.a.speaker").alias("speaker"), F.col("z.a.text").alias("original"), F.col("z.b.text").alias("translation"))


def context_info(raw: Column) -> Column:
    """SC21: context JSON with defaults: empty lists, 'general' domain, chapters from 00:00:00."""
    c = F.from_json(raw, CONTEXT)
    chapters = F.transform(F.coalesce(c["chapters"], F.array().cast("array<struct<title:string,summary:string,start_time:string>>")), lambda x: F.struct(F.coalesce(x["title"], F.lit("")).alias("title"), F.coalesce(x["summary"], F.lit("")).alias("summary"), F.coalesce(x["start_time"], F.lit("00:00:00")).alias("start_time")))
    return F.struct(F.coalesce(c["domain"], F.lit("general")).alias("domain"), F.coalesce(c["terminology"], F.array().cast("array<string>")).alias("terminology"), F.coalesce(c["tone"], F.lit("neutral")).alias("tone"), F.coalesce(c["themes"], F.array().cast("array<string>")).alias("themes"), chapters.alias("chapters"), F.coalesce(c["overall_summary"], F.lit("")).alias("overall_summary"))


def lines_text(pairs: str | Column) -> Column:
    """'speaker: text' lines of an array of pairs."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.coalesce(x["speaker"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")


#: Columns of chunks that their prompts use, and that parts of a chunk inherit.
CONTEXT_COLUMNS = ("context_before", "context_after", "domain", "tone", "summary", "translated")


def asked(rows: DataFrame, model: Callable, source: str, target: str, glossary: dict[str, str] | None, persona: str, template: str) -> DataFrame:
    """rows (pairs and any of CONTEXT_COLUMNS) with prompt, rendered over their own lines, and raw: model's answers to requests {prompt, pairs}."""
    asking = prompts(rows.withColumn("text", lines_text("pairs")), source, target, glossary, persona, template)
    asking = asking if "text" in rows.columns else asking.drop("text")
    return call_model(asking.withColumn("_request", F.struct("prompt", "pairs")), model, "_request", "raw").drop("_request")


def call_model(rows: DataFrame, model: Callable, column: str, out: str) -> DataFrame:
    """UD1-UD7: rows with out = model(list of values of column), called once per piece of an Arrow batch, of about a megabyte: requests and answers are Python objects."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    at, names = rows.columns.index(column), [*rows.columns, out]

    def run(batches: Iterator):
        import pyarrow as pa

        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers(model, b.column(at).to_pylist()), pa.string())], names)

    return map_texts(rows, run, schema)


def answers(model: Callable, asked: list) -> list[str | None]:
    """model's answers as text, JSON if they are none."""
    import json

    return [a if a is None or isinstance(a, str) else json.dumps(a, ensure_ascii=False) for a in model(asked)]


def lines_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("media_id", "chunk_idx", F.posexplode("pairs").alias("line_no", "p")).select("media_id", "chunk_idx", "line_no", F.col("p.speaker").alias("speaker"), F.col("p.text").alias("original"))


def answered(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """The lines of chunks with what the tries of log (first, parsed, reason) made of them."""
    found = log.filter("reason IS NULL").select("media_id", "chunk_idx", F.posexplode("parsed").alias("k", "t"), "first").select("media_id", "chunk_idx", (F.col("first") + F.col("k")).alias("line_no"), F.col("t.text").alias("translation"))
    out = lines_of(chunks).join(found, ["media_id", "chunk_idx", "line_no"], "left")
    return out.select("media_id", "chunk_idx", "line_no", "speaker", "original", F.coalesce("translation", "original").alias("translation"), F.col("translation").isNotNull().alias("ok"))


def translate(chunks: DataFrame, model: Callable, source: str, target: str, rounds: int = 4, attempts: int = 5, glossary: dict[str, str] | None = None, persona: str = "normal") -> tuple[DataFrame, DataFrame]:
    """UD1 with SC16, VAL1, VAL3 and PK8: (lines, log).

    model takes a list of requests {prompt, pairs} and gives an answer for each.  The prompt holds the glossary, the persona, the lines asked for and the context that
    chunks have (CONTEXT_COLUMNS, with_context); the halves of a chunk keep its context.

    Same-language jobs pass through without a call.  A part (a chunk at first) is tried up to `attempts` times; one that fails them all is halved, rounds
    times at most, and its halves are tried alike.  Each try runs only over failed rows, whose results are written before the next.  lines: media_id, chunk_idx, line_no,
    speaker, original, translation (the original where all failed) and ok.  log: media_id, chunk_idx, part (which half of which half), attempt (from 1 within the part),
    prompt, raw, reason.
    """
    from .graph import shared_folder_set

    shared_folder_set(chunks)
    context = [c for c in CONTEXT_COLUMNS if c in chunks.columns]
    chunks = chunks.select("media_id", "chunk_idx", "pairs", *context).checkpoint()
    if source == target:
        return lines_of(chunks).withColumn("translation", F.col("original")).withColumn("ok", F.lit(True)), chunks.sparkSession.createDataFrame([], "media_id long, chunk_idx long, part string, attempt int, prompt string, raw string, reason string")
    todo = chunks.select("media_id", "chunk_idx", F.lit("").alias("part"), F.lit(0).alias("first"), "pairs", *context)
    tries = []
    for half in range(rounds + 1):
        for attempt in range(1, attempts + 1):
            tried = check_translation(asked(todo, model, source, target, glossary, persona, "translate")).withColumn("attempt", F.lit(attempt)).checkpoint()
            tries.append(tried)
            todo = tried.filter("reason IS NOT NULL").select(todo.columns)
            if not todo.take(1):
                break
        failed = todo.filter("size(pairs) > 1")
        if half == rounds or not failed.take(1):
            break
        flat = failed.select("media_id", "chunk_idx", "part", "first", *context, F.posexplode("pairs").alias("line_no", "p"))
        halved = halve_failed(flat, ("media_id", "chunk_idx", "part"))
        pairs = F.sort_array(F.collect_list(F.struct("line_no", "p")))
        todo = halved.groupBy("media_id", "chunk_idx", F.concat("part", F.col("half").cast("string")).alias("part")).agg(F.min(F.col("first") + F.col("line_no")).alias("first"), F.transform(pairs, lambda x: x["p"]).alias("pairs"), *[F.first(c).alias(c) for c in context])
    log = tries[0]
    for t in tries[1:]:
        log = log.unionByName(t)
    return answered(chunks, log), log.select("media_id", "chunk_idx", "part", "attempt", "prompt", "raw", "reason")


def read_answer(raw: str | None, pairs: list[dict]) -> list[str | None] | None:
    """The texts of an answer that check_translation() finds no fault with, else None: what it says of a column, said of one answer where the next prompt needs it.

    A number given as a text may be written another way than there.
    """
    import json
    import re

    def text(v):
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    # Spark takes strings in single quotes too, and leaves what follows the value unread
    double = re.sub(r"""("(?:\\.|[^"\\])*")|'((?:\\.|[^'\\])*)'""", lambda m: m[1] or '"' + m[2].replace("\\'", "'").replace('"', '\\"') + '"', (raw or "").lstrip(" \t\r\n"))
    try:
        found = json.JSONDecoder().raw_decode(double)[0]
    except ValueError:
        return None
    found = [found] if isinstance(found, dict) else found
    if not isinstance(found, list) or len(found) != len(pairs) or not all(isinstance(f, dict) for f in found):
        return None
    same = all(p["speaker"] is not None and text(f.get("speaker")) == p["speaker"] for f, p in zip(found, pairs, strict=True))
    return [text(f.get("text")) for f in found] if same else None


def tries(chunks: list[dict], ask: Callable, template: str, rounds: int, attempts: int) -> Iterator[dict]:
    """Every try at chunks (pairs and the values of a prompt), as translate() makes them; said of a chunk gets its lines' translations."""
    todo = [(c, "", 0, c["pairs"]) for c in chunks]
    for c in chunks:
        c["said"] = [p["text"] for p in c["pairs"]]
    for half in range(rounds + 1):
        for attempt in range(1, attempts + 1):
            prompts_ = []
            for c, _, _, pairs in todo:
                prompt = template
                for name, value in (c["values"] | {"text": "\n".join(f"{p['speaker'] or ''}: {p['text'] or ''}" for p in pairs)}).items():
                    prompt = prompt.replace("{" + name + "}", value or "")
                prompts_.append(prompt)
            failed = []
            for (c, part, first, pairs), prompt, raw in zip(todo, prompts_, ask([{"prompt": p, "pairs": t[3]} for p, t in zip(prompts_, todo, strict=True)]), strict=True):
                yield {"media_id": c["media_id"], "chunk_idx": c["chunk_idx"], "part": part, "first": first, "pairs": pairs, "attempt": attempt, "prompt": prompt, "raw": raw}
                texts = read_answer(raw, pairs)
                if texts is None:
                    failed.append((c, part, first, pairs))
                else:
                    c["said"][first : first + len(texts)] = [p["text"] if t is None else t for t, p in zip(texts, pairs, strict=True)]
            todo = failed
            if not todo:
                return
        if half < rounds:
            todo = [(c, part + str(h), first + h * (len(p) // 2), p[len(p) // 2 :] if h else p[: len(p) // 2]) for c, part, first, p in todo if len(p) > 1 for h in (0, 1)]
        if not todo:
            return


def translate_in_rounds(
    chunks: DataFrame, model: Callable, source: str, target: str, before: int = 2, rounds: int = 4, attempts: int = 5, glossary: dict[str, str] | None = None, persona: str = "normal", together: int = 64
) -> tuple[DataFrame, DataFrame]:
    """UD1 where each chunk sees the *translations* of up to `before` chunks before it, and the source text of the next: (lines, log) as of translate().

    About `together` media items are dealt to a task at a time, in the order of their chunks' places: it asks for their first chunks in one call, then for their second ones, and
    keeps the last translations of these items only.  So all chunks take one stage however long an item is; only an item's own chunks wait for each other.
    Chunks (media_id, chunk_idx, text, pairs) may have the other columns of a context too.
    """
    from collections import deque
    from itertools import groupby

    from .graph import shared_folder_set

    if source == target:
        return translate(chunks, model, source, target)
    shared_folder_set(chunks)
    by = Window.partitionBy("media_id").orderBy("chunk_idx")
    own = [c for c in CONTEXT_COLUMNS if c in chunks.columns and not c.startswith("context_")]
    chunks = chunks.select("media_id", "chunk_idx", "pairs", (F.row_number().over(by) - 1).alias("_round"), F.coalesce(F.lead("text").over(by), F.lit("")).alias("after"), *[F.col(c).cast("string").alias(c) for c in own]).checkpoint()
    cohorts = max(1, chunks.filter("_round = 0").count() // together)
    dealt = chunks.withColumn("_cohort", F.pmod(F.xxhash64("media_id"), F.lit(cohorts))).repartition("_cohort").sortWithinPartitions("_cohort", "_round", "media_id")
    fixed = {"persona": PERSONAS.get(persona, PERSONAS["normal"]), "source": source, "target": target, "glossary": glossary_section(glossary or {})}
    typed = {f.name: f.dataType for f in chunks.schema}
    out = T.StructType([T.StructField("media_id", typed["media_id"]), T.StructField("chunk_idx", typed["chunk_idx"]), T.StructField("part", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("pairs", typed["pairs"]), T.StructField("attempt", T.IntegerType()), T.StructField("prompt", T.StringType()), T.StructField("raw", T.StringType())])
    template, last = TEMPLATES["translate"], before

    def run(batches: Iterator):
        import pyarrow as pa

        schema, held, said, open_cohort = None, [], {}, None

        def rows():
            nonlocal schema
            for b in pieces(batches):
                kinds = {n: b.schema.field(n).type for n in ("media_id", "chunk_idx", "pairs")}
                schema = pa.schema([(n, kinds.get(n, pa.int32() if n in ("first", "attempt") else pa.string())) for n in out.names])
                yield from b.to_pylist()

        for (cohort, _), wave in groupby(rows(), lambda r: (r["_cohort"], r["_round"])):
            if cohort != open_cohort:
                open_cohort, said = cohort, {}
            wave = list(wave)
            for c in wave:
                then = said.setdefault(c["media_id"], deque(maxlen=last))
                c["pairs"] = c["pairs"] or []
                c["values"] = fixed | {"before": "\n\n".join(then), "after": c["after"]} | {n: c.get(n) for n in ("domain", "tone", "summary", "translated", "target_chars", "persona_rules")}
            for row in tries(wave, lambda asked: answers(model, asked), template, rounds, attempts):
                held.append(row)
                if len(held) == 256:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            for c in wave:
                said[c["media_id"]].append("\n".join(f"{p['speaker'] or ''}: {t or ''}" for p, t in zip(c["pairs"], c["said"], strict=True)))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    log = check_translation(map_texts(dealt, run, out).checkpoint())
    return answered(chunks, log), log.select("media_id", "chunk_idx", "part", "attempt", "prompt", "raw", "reason")


def translate_cached(chunks: DataFrame, cache: DataFrame, model: Callable, source: str, target: str, key: str = "key", **options) -> tuple[DataFrame, DataFrame]:
    """UD1 through the cache of SRC11 (key, translated_pairs): (lines as of translate(), new cache rows).

    Only the misses reach the model, each key once; a chunk is new in the cache if all its lines were translated.  SNK9 appends the new rows.
    """
    from .graph import shared_folder_set

    context = [c for c in CONTEXT_COLUMNS if c in chunks.columns]
    hits, misses = look_up(chunks.select("media_id", "chunk_idx", key, "pairs", *context), cache.select(key, "translated_pairs"), key)
    shared_folder_set(chunks)
    # a chunk without a key is asked for by itself, and leaves nothing in the cache
    own = F.concat(F.lit("chunk "), F.col("media_id").cast("string"), F.lit("/"), F.col("chunk_idx").cast("string"))
    misses = misses.withColumn("_asked", F.coalesce(F.concat(F.lit("key "), F.col(key).cast("string")), own))
    once = misses.dropDuplicates(["_asked"]).checkpoint()
    made, _ = translate(once, model, source, target, **options)
    made = made.join(once.select("media_id", "chunk_idx", key, "_asked"), ["media_id", "chunk_idx"]).select(key, "_asked", "line_no", "speaker", "translation", "ok")
    said = F.sort_array(F.collect_list(F.struct("line_no", "speaker", F.col("translation").alias("text"))))
    new = made.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_and("ok").alias("ok"), F.transform(said, lambda x: F.struct(x["speaker"], x["text"])).cast(PAIRS).alias("translated_pairs")).filter("ok").select(key, "translated_pairs")
    wanted = misses.select("media_id", "chunk_idx", "_asked", F.posexplode("pairs").alias("line_no", "p"))
    fresh = wanted.join(made.select("_asked", "line_no", "translation", "ok"), ["_asked", "line_no"])
    kept = hits.select("media_id", "chunk_idx", F.posexplode("pairs").alias("line_no", "p"), F.col("translated_pairs").alias("t"))
    kept = kept.withColumn("translation", F.get("t", F.col("line_no"))["text"])
    kept = kept.withColumn("ok", F.col("translation").isNotNull())
    columns = ["media_id", "chunk_idx", "line_no", F.col("p.speaker").alias("speaker"), F.col("p.text").alias("original"), F.coalesce("translation", "p.text").alias("translation"), "ok"]
    return fresh.select(*columns).unionByName(kept.select(*columns)), new


def refine(chunks: DataFrame, model: Callable, source: str = "", target: str = "", attempts: int = 3, glossary: dict[str, str] | None = None, persona: str = "normal") -> DataFrame:
    """UD2 with SC16 and VAL2: chunks (media_id, chunk_idx, pairs) with prompt and refined lines; those that needed a repair are asked for again, and the last attempt is
    kept as repaired.  model takes requests {prompt, pairs}, as translate() makes them."""
    from .graph import shared_folder_set

    shared_folder_set(chunks)
    todo, done = chunks, None
    for attempt in range(1, attempts + 1):
        answers = asked(todo, model, source, target, glossary, persona, "refine").withColumn("refined", F.from_json("raw", REFINED))
        tried = repair_refinement(answers, attempt == attempts).withColumn("attempt", F.lit(attempt)).checkpoint()
        ready = tried.filter(~F.col("needs_retry"))
        done = ready if done is None else done.unionByName(ready)
        todo = tried.filter("needs_retry").select(chunks.columns)
        if attempt == attempts or not todo.take(1):
            return done


def adjust_lengths(rows: DataFrame, model: Callable, source: str, target: str, text: str = "text", chars: str = "target_chars", attempts: int = 3, glossary: dict[str, str] | None = None, persona: str = "normal") -> DataFrame:
    """UD3: rows with adjusted, text said in about `chars` characters, and ok.

    model takes requests {prompt, text, target_chars}.  Its answer is a JSON object with a text, or the text itself if it doesn't look like one; rows without a usable answer are
    asked for again, `attempts` times in all, and then keep their text.  A null or blank text, or a null target, is kept without a call.
    """
    from .graph import shared_folder_set

    shared_folder_set(rows)
    rules = F.lit("Rules:\n" + PERSONAS.get(persona, PERSONAS["normal"]))
    able = (F.trim(F.coalesce(text, F.lit(""))) != "") & F.col(chars).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    every = rows.select(row, F.col(text).cast("string").alias("text"), F.col(chars).cast("long").alias("target_chars"), able.alias("_able")).checkpoint()
    kept = lambda df, said, ok: df.select("_row.*", said.alias("adjusted"), F.lit(ok).alias("ok"))
    out, todo = kept(every.filter(~F.col("_able")), F.col("text"), False), every.filter("_able").drop("_able")
    for attempt in range(1, attempts + 1):
        asking = prompts(todo.withColumn("persona_rules", rules), source, target, glossary, persona, "adjust").drop("persona_rules")
        answered = call_model(asking.withColumn("_request", F.struct("prompt", "text", "target_chars")), model, "_request", "raw")
        plain = F.when(~F.ltrim("raw").startswith("{"), F.col("raw"))
        said = strip(F.coalesce(F.from_json("raw", "text string")["text"], plain))
        tried = answered.withColumn("_said", F.when(said != "", said)).checkpoint()
        out = out.unionByName(kept(tried.filter("_said IS NOT NULL"), F.col("_said"), True))
        todo = tried.filter("_said IS NULL").select("_row", "text", "target_chars")
        if attempt == attempts or not todo.take(1):
            return out.unionByName(kept(todo, F.col("text"), False))


def spoken_ms(rows: DataFrame, estimate: Column, engine: Callable | None = None, text: str = "text", measured: str | None = None) -> DataFrame:
    """UD4: rows with spoken_ms: the measured length where there is one, else the engine's own estimate (a function of a list of texts; None where it has none), else
    the native estimate."""
    known = F.col(measured).cast("double") if measured else F.lit(None).cast("double")
    if engine is None:
        return rows.withColumn("spoken_ms", F.coalesce(known, estimate))
    asked = call_model(rows, lambda texts: [None if x is None else str(x) for x in engine(texts)], text, "engine_ms")
    return asked.withColumn("spoken_ms", F.coalesce(known, F.col("engine_ms").cast("double"), estimate)).drop("engine_ms")


#: Emotion codes and their labels.
EMOTIONS = {"neu": "Neutral", "ang": "Angry", "hap": "Happy", "sad": "Sad"}


def emotion_label(code: Column, enabled: bool = True) -> Column:
    """JN12: label of an emotion code; 'None' gives null, an unknown code or no code 'Neutral'; switched off it is 'Neutral' throughout."""
    if not enabled:
        return F.lit("Neutral")
    known = F.create_map(*[F.lit(x) for kv in EMOTIONS.items() for x in kv])
    return F.when(code == "None", F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, F.coalesce(code, F.lit(""))), F.lit("Neutral")))


def speakable(rows: DataFrame, text: str = "text") -> DataFrame:
    """FL5, FL6: rows whose speaker and text are both there and not blank."""
    return rows.filter((F.trim(F.coalesce("speaker", F.lit(""))) != "") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
