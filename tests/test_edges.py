"""Odd inputs of sources, the translation job, caches and the incremental run."""

from pyspark.sql import functions as F
from segflow.functions import timefmt
from segflow.operators import cache, frames, intervals, translate, variants
from segflow.plans.fixtures import Inputs
from segflow.sinks import files
from segflow.sources import media, transcripts
from segflow.streaming.incremental import apply_to_new_media


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_srt_entries_good_and_bad(spark):
    content = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\nx\n00:00:03,000 --> 00:00:04,000\nbad index\n\n3\nnonsense\ntext\n\n4\r\n00:00:05,000 --> 00:00:06,000\r\nlast"
    good, bad = transcripts.srt_cues(spark.createDataFrame([("f", content), ("g", ""), ("h", None)], "file string, content string"))
    assert values(good, "index", "start_ms", "end_ms", "text") == [(1, 1000, 2500, "Hello\nthere"), (4, 5000, 6000, "last")]
    assert bad.count() == 2


def test_ranges_and_clocks(spark):
    rows = spark.createDataFrame([(1, "30-45,1:05-1:15,0:10:00-0:10:20,50-40,x-3,,7"), (2, None)], "media_id long, ranges string")
    assert values(media.ranges(rows), "start_ms", "end_ms") == [(30_000, 45_000), (65_000, 75_000), (600_000, 620_000)]
    t = spark.createDataFrame([("1.5",), ("1:2:3.25",), ("1:2:3:4",), ("",), (None,)], "t string").select(timefmt.parse_clock(F.col("t")).alias("v"))
    assert [r["v"] for r in t.collect()] == [1500, 3_723_250, None, None, None]


def test_silence_log_pairs(spark):
    log = "silence_start: 1.5\nsilence_end: 2.0\nsilence_start: 3\nsilence_end: 2.5\nsilence_start: 9"
    rows = spark.createDataFrame([(1, log, 10_000), (2, "", 5), (3, None, 5)], "media_id long, log string, duration_ms long")
    assert values(media.silences(rows), "start_ms", "end_ms") == [(1500, 2000), (9000, 10_000)]


def test_probe_without_streams(spark):
    rows = spark.createDataFrame([(1, '{"streams":[],"format":{"duration":"1.25"}}'), (2, "oops"), (3, None)], "media_id long, probe string")
    assert sorted((r["media_id"], r["duration_ms"], r["width"]) for r in media.probe_info(rows).collect()) == [(1, 1250, None), (2, None, None), (3, None, None)]


def test_asr_fallbacks(spark):
    rows = [(1, [("A", " hi ", 5, 9), (None, "", 9, 10), ("B", "x", 12, 12)], None, None, "t", 20), (2, [], [("s", 1, 2)], None, "t", 20), (3, None, None, [("a", None, 0, 1), ("b", None, 1, 2), ("c", "Z", 2, 3)], " whole ", 20), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "media_id long, " + transcripts.ASR)
    assert values(transcripts.asr_segments(df), "media_id", "speaker", "text", "start_ms", "end_ms") == [(1, "SPEAKER_A", "hi", 5, 9), (2, "SPEAKER_00", "s", 1, 2), (3, "SPEAKER_00", "whole", 0, 20)]
    assert values(transcripts.asr_rolls(df).filter("media_id = 3"), "start_ms", "end_ms", "speaker") == [(0, 2, "SPEAKER_00"), (2, 3, "SPEAKER_Z")]


def test_mapping_strings(spark):
    rows = spark.createDataFrame([("a:1, b : 2",), ('{"a":"1"}',), ("junk",), (None,), ("",)], "t string")
    assert [r["m"] for r in rows.select(media.mapping(F.col("t")).alias("m")).collect()] == [{"a": "1", "b": "2"}, {"a": "1"}, None, None, None]


def test_failed_chunks_are_halved_until_they_pass(spark):
    pairs = [("A", f"line {i}") for i in range(7)]
    chunks = spark.createDataFrame([(1, 0, pairs), (1, 1, [("B", "bad")])], "media_id long, chunk_idx long, pairs " + translate.PAIRS)

    def model(batch):  # answers only requests of up to two lines, and never the word bad
        return [None if len(p) > 2 or p[0]["text"] == "bad" else [{"speaker": x["speaker"], "text": x["text"].upper()} for x in p] for p in (r["pairs"] for r in batch)]

    lines, log = translate.translate(chunks, model, "en", "fr")
    got = values(lines, "chunk_idx", "line_no", "translation", "ok")
    assert got == [(0, i, f"LINE {i}", True) for i in range(7)] + [(1, 0, "bad", False)]
    assert log.agg(F.max(F.length("part"))).first()[0] == 2
    same, none = translate.translate(chunks, model, "en", "en")
    assert same.filter("translation = original AND ok").count() == 8 and none.count() == 0


def test_cache_round(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "i int, key string")
    known = spark.createDataFrame([("a", "A"), ("a", "A")], "key string, result string")
    full, new = cache.cached(rows, known, lambda m: m.select("key", F.upper("key").alias("result")))
    assert values(full, "i", "result") == [(1, "A"), (2, "B"), (3, "B"), (4, "C")]
    cache.append(new, str(tmp_path / "c"))
    assert cache.hit_counts(rows, spark.read.parquet(str(tmp_path / "c"))).first().asDict() == {"hits": 3, "misses": 1, "new_keys": 1}


def test_prompts_reach_the_model_with_context_and_halves_keep_it(spark):
    chunks = spark.createDataFrame([(1, 0, [("A", f"line {i}") for i in range(3)], "was", "comes"), (1, 1, [("B", "x")], None, None)], f"media_id long, chunk_idx long, pairs {translate.PAIRS}, context_before string, context_after string")

    def model(batch):  # answers single lines, with its prompt
        return [None if len(r["pairs"]) > 1 else [{"speaker": r["pairs"][0]["speaker"], "text": r["prompt"]}] for r in batch]

    lines, log = translate.translate(chunks, model, "en", "fr", attempts=1, glossary={"sea": "mer"}, persona="poet")
    want = lambda text, before, after: f"{translate.PERSONAS['poet']}\nTranslate from en to fr.\nTerms:\n- sea = mer\nBefore:\n{before}\nText:\n{text}\nAfter:\n{after}"
    assert values(lines, "chunk_idx", "line_no", "translation") == [(0, i, want(f"A: line {i}", "was", "comes")) for i in range(3)] + [(1, 0, want("B: x", "", ""))]
    assert want("A: line 0\nA: line 1\nA: line 2", "was", "comes") in {r["prompt"] for r in log.filter("part = ''").collect()}


def test_a_model_call_is_bounded_by_bytes(spark):
    rows = spark.range(0, 4000, 1, 1).select("id", F.rpad(F.col("id").cast("string"), 2000, "x").alias("ask"))
    got = translate.call_model(rows, lambda asked: [f"{len(asked)} {a.rstrip('x')}" for a in asked], "ask", "said").select("id", F.split("said", " ").alias("s")).collect()
    assert len(got) == 4000 and all(int(r["s"][1]) == r["id"] for r in got)
    assert max(int(r["s"][0]) for r in got) <= 600


def test_rounds_use_translated_chunks(spark):
    chunks = spark.createDataFrame([(m, c, f"A: t{c}", [("A", f"t{c}")]) for m, n in ((1, 4), (2, 1)) for c in range(n)], f"media_id long, chunk_idx long, text string, pairs {translate.PAIRS}")

    def model(batch):
        return [[{"speaker": "A", "text": r["pairs"][0]["text"].upper() + "(" + r["prompt"].split("Before:\n")[1].split("\nText:")[0].replace("\n\n", "+") + "/" + r["prompt"].split("After:\n")[1] + ")"}] for r in batch]

    got = dict(values(translate.translate_in_rounds(chunks.filter("media_id = 1"), model, "en", "fr", before=2)[0], "chunk_idx", "translation"))
    assert got[0] == "T0(/A: t1)" and got[1] == f"T1(A: {got[0]}/A: t2)" and got[2] == f"T2(A: {got[0]}+A: {got[1]}/A: t3)" and got[3] == f"T3(A: {got[1]}+A: {got[2]}/)"
    assert translate.translate_in_rounds(chunks, model, "en", "fr")[0].count() == 5
    assert translate.translate_in_rounds(chunks.limit(0), model, "en", "fr")[0].count() == 0


def test_rounds_take_one_stage_and_halve_as_translate_does(spark):
    chunks = spark.createDataFrame([(m, c, f"A: t{c}", [("A", f"l{i}") for i in range(n)]) for m, k, n in ((1, 40, 1), (2, 2, 7)) for c in range(k)], f"media_id long, chunk_idx long, text string, pairs {translate.PAIRS}")
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(1)
        return [None if len(r["pairs"]) > 2 or r["pairs"][0]["text"] == "l3" else [{"speaker": "A", "text": p["text"].upper()} for p in r["pairs"]] for r in batch]

    group = "rounds"
    spark.sparkContext.setJobGroup(group, group)
    lines, log = translate.translate_in_rounds(chunks, model, "en", "fr", rounds=3, attempts=2)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain, tried = translate.translate(chunks, model, "en", "fr", rounds=3, attempts=2)
    assert values(lines, *lines.columns) == values(plain, *plain.columns)
    same = ("media_id", "chunk_idx", "part", "attempt", "raw", "reason")
    assert sorted(map(str, values(log, *same))) == sorted(map(str, values(tried, *same)))


def test_an_answer_is_read_as_a_column_of_them(spark):
    raws = [None, " ", "\n", "no", "[]", "{}", "null", "5", "[5]", "[null]", '[{"speaker":"A","text":"x"}]', '{"speaker":"A","text":"x"}', '[{"speaker":"A","text":"x"}] ok', '[{"speaker":"A"', '[{"speaker":"A"}]', '[{"text":"x"}]']
    raws += ['[{"speaker":"A","text":5}]', '[{"speaker":"A","text":{"a": [1, 2]}}]', '[{"speaker":"A","text":true}]', "[{'speaker':'A','text':'it\\'s \"x\"'}]", '[{"speaker":"A","text":"it\'s a\'"}]', '[{speaker:"A"}]', '[{"speaker":"A","text":"a\nb"}]', '[{"speaker":"A","text":"x"},]', '[{"speaker":"A","text":"x"},5]', '[{"speaker":5}]', '[{"speaker":"A","text":"\\u00e9"}]']
    rows = spark.createDataFrame([(i, r, [("A", "o")]) for i, r in enumerate(raws)], f"i int, raw string, pairs {translate.PAIRS}")
    want = [None if r["reason"] else [p["text"] for p in r["parsed"]] for r in translate.check_translation(rows).orderBy("i").collect()]
    assert [translate.read_answer(r, [{"speaker": "A", "text": "o"}]) for r in raws] == want


def test_lengths_are_adjusted_or_kept(spark):
    rows = spark.createDataFrame([(1, "json", 3), (2, "plain", 9), (3, "bad", 4), (4, " ", 4), (5, None, 4), (6, "json", None), (7, "later", 5)], "i int, text string, target_chars long")
    tries = spark.sparkContext.accumulator(0)

    def model(batch):
        tries.add(len(batch))
        return [{"json": {"text": f" {r['target_chars']} in {r['prompt'].split(chr(10))[0]}"}, "plain": "just text", "later": "  "}.get(r["text"], "{") for r in batch]

    got = values(translate.adjust_lengths(rows, model, "en", "fr", attempts=2), "i", "adjusted", "ok")
    assert got == [(1, "3 in Say the en text in fr in about 3 characters.", True), (2, "just text", True), (3, "bad", False), (4, " ", False), (5, None, False), (6, "json", False), (7, "later", False)]
    assert tries.value == 4 + 2


def test_rows_without_a_cache_key_keep_their_results(spark):
    chunks = spark.createDataFrame([(1, 0, None, [("A", "a")]), (1, 1, None, [("A", "b")]), (2, 0, "k", [("A", "c")]), (3, 0, "k", [("A", "c")])], f"media_id long, chunk_idx long, key string, pairs {translate.PAIRS}")
    none = spark.createDataFrame([], f"key string, translated_pairs {translate.PAIRS}")
    model = lambda batch: [[{"speaker": p["speaker"], "text": p["text"].upper()} for p in r["pairs"]] for r in batch]
    lines, new = translate.translate_cached(chunks, none, model, "en", "fr")
    assert values(lines, "media_id", "chunk_idx", "translation") == [(1, 0, "A"), (1, 1, "B"), (2, 0, "C"), (3, 0, "C")]
    assert [r["key"] for r in new.collect()] == ["k"]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, key string")
    full, fresh = cache.cached(rows, spark.createDataFrame([("a", "A")], "key string, result string"), lambda m: m.select("key", F.lit("made").alias("result")))
    assert values(full, "i", "result") == [(1, "A"), (2, "made")] and fresh.count() == 0


def test_a_tie_in_reselection_goes_to_the_shorter(spark):
    attempts = spark.createDataFrame([(1, 0, 0, "t", "long", 250, 1000), (1, 0, 1, "s", "short", 1500, 1000)], "media_id long, seg_idx int, ord int, track string, text string, slot_ms long, spoken_ms long")
    got = [variants.reselect(attempts, prefer, 0.5, 1.0).first() for prefer in (True, False)]
    assert [(r["text"], r["deviation"]) for r in got] == [("short", -0.5), ("long", 0.5)]


def test_retime_without_removals_and_clamping(spark):
    rows = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 4000, 4500), (1, 2, 9000, 9100), (2, 0, 5, 6)], "media_id long, seg_idx int, start_ms long, end_ms long")
    pauses = spark.createDataFrame([(1, 1000, 5000)], "media_id long, start_ms long, end_ms long")
    got = values(intervals.retime(rows, intervals.pause_removals(pauses)), "media_id", "seg_idx", "new_start_ms", "new_end_ms")
    assert got == [(1, 0, 100, 200), (1, 1, 2500, 2500), (1, 2, 6500, 6600), (2, 0, 5, 6)]


def test_silent_and_short_audio(spark):
    rows = [(1, i, 0.0) for i in range(20)] + [(2, i, 0.5) for i in range(20)] + [(3, i, 0.5) for i in range(3)] + [(4, i, 0.5 if i < 5 else 1e-6) for i in range(20)]
    got = {r["media_id"]: r["reason"] for r in frames.trailing_silence(spark.createDataFrame(rows, "media_id long, frame_idx long, rms double")).collect()}
    assert got == {1: "no energy", 2: "flat", 3: "short", 4: "silence"}


def test_files_written(spark, tmp_path):
    s = Inputs(spark, "/root/testdata/sf0.001").segments().withColumn("cue_no", F.col("seg_idx") + 1)
    files.write_srt(s, str(tmp_path / "srt"))
    back = transcripts.srt_cues(transcripts.read_srt(spark, str(tmp_path / "srt" / "*")))[0]
    assert back.count() == s.count()


def test_incremental_run(spark, tmp_path):
    rolls = Inputs(spark, "/root/testdata/sf0.001").rolls()
    rolls.filter("media_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), rolls.schema, intervals.merge_turns, str(tmp_path / "out"), str(tmp_path / "state"))
    apply_to_new_media(spark, *args).awaitTermination()
    rolls.filter("media_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    apply_to_new_media(spark, *args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").exceptAll(intervals.merge_turns(rolls)).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == intervals.merge_turns(rolls).count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "media_id long, roll_idx long, seg_idx int, speaker string, text string, start_ms long, end_ms long")
    from segflow.operators import packing, speakers

    assert intervals.merge_turns(empty).count() == 0
    assert intervals.overlap_pairs(empty).count() == 0
    assert packing.merge_segments(empty).count() == 0
    assert packing.translation_chunks(empty).count() == 0
    assert speakers.rename_by_time(empty).count() == 0


def test_speaker_states_of_batches_equal_a_full_run(spark):
    from segflow.operators import speakers

    rows = spark.range(60_000).select((F.col("id") % 50).alias("media_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), (F.col("id") * 31 % 20_011).cast("string"))).alias("speaker"))
    rows = rows.unionByName(spark.createDataFrame([(None, "x"), (None, None), (99, None)], "media_id long, speaker string"))
    full = speakers.speakers_of_states(speakers.speaker_states(rows)).first()
    parts = [speakers.speaker_states(rows.filter(c)) for c in ("media_id < 20", "media_id >= 20 OR media_id IS NULL", "media_id % 3 = 0 OR media_id IS NULL")]
    states = parts[0]
    for p in parts[1:]:
        states = speakers.with_arrived(states, p)
    got = speakers.speakers_of_states(states).first()
    assert got["n_media"] == full["n_media"] == 52
    assert sorted((str(r["media_id"]), r["n_speakers"]) for r in states.collect()) == sorted((str(r["media_id"]), r["n_speakers"]) for r in speakers.speaker_states(rows).collect())
    exact = rows.select("speaker").dropna().distinct().count()
    assert speakers.catalogue_speakers(rows).first()["n_speakers"] == exact and all(abs(x["n_speakers"] - exact) < 0.04 * exact for x in (got, full))
    assert tuple(speakers.speakers_of_states(speakers.speaker_states(rows.limit(0))).first()) == (0, 0)
