"""Ordered folds against plain loops over the stated rules."""

import random
import re

import pytest
from segflow.functions import text as T
from segflow.operators import packing, subtitles, voices
from pyspark.sql import functions as F


def pack_plain(text, limit):
    text = re.sub(r"^\s+|\s+$", "", text or "")
    if not text:
        return []
    if len(text) <= limit:
        return [text]

    def pack(pieces):
        out, cur = [], ""
        for p in pieces:
            if not cur:
                cur = p
            elif len(cur) + 1 + len(p) <= limit:
                cur += " " + p
            else:
                out.append(cur)
                cur = p
        return out + [cur] if cur else out

    pieces = []
    for s in re.findall(r"[^.!?]+[.!?]*", text):
        s = s.strip()
        if not s:
            continue
        if len(s) <= limit:
            pieces.append(s)
        else:
            words = [w[i : i + limit] for w in s.split() for i in range(0, len(w), limit)]
            pieces += pack(words)
    return pack(pieces)


def test_pack_sentences(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "x" * 50, "a. b! c?", "one two three. " * 9]
    for _ in range(150):
        texts.append("".join(rng.choice("abcdé  .!?\n") * rng.choice([1, 1, 1, 7]) for _ in range(rng.randrange(120))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (5, 12, 40):
        got = {r["i"]: list(r["p"]) for r in rows.select("i", T.pack_sentences(F.col("t"), limit).alias("p")).collect()}
        assert got == {i: pack_plain(t, limit) for i, t in enumerate(texts)}


def split_plain(words, limit, tail=50):
    out, i = [], 0
    if len(" ".join(w for w, _, _ in words)) <= limit or not words:
        return [words]
    while i < len(words):
        a, n, stop, end = i, 0, -1, None
        while i < len(words):
            grown = n + (1 if n else 0) + len(words[i][0])
            if words[i][0][-1:] in ".!?":
                stop = i
            if grown > limit:
                if stop >= a:
                    end = len(words) - 1 if len(" ".join(w for w, _, _ in words[stop + 1 :])) < tail else stop
                else:
                    end = i - 1 if i > a else i
                break
            n = grown
            i += 1
        if end is None:
            end = len(words) - 1
        out.append(words[a : end + 1])
        i = end + 1
    return out


def test_split_long_segments(spark):
    rng = random.Random(5)
    rows, want = [], []
    for m in range(120):
        words, t = [], 0
        for _ in range(rng.randrange(1, 60)):
            w = "w" * rng.randrange(1, 9) + rng.choice(["", "", "", ".", "!", ","])
            words.append((w, t, t + 10))
            t += rng.randrange(10, 20)
        rows.append((m, 0, "S", " ".join(w for w, _, _ in words), 0, t, [(w, a, b, 1.0) for w, a, b in words]))
        pieces = split_plain(words, 60)
        whole = len(rows[-1][3]) <= 60
        want += [(m, k, " ".join(w for w, _, _ in p), 0 if whole else p[0][1], t if whole else p[-1][2]) for k, p in enumerate(pieces)]
    df = spark.createDataFrame(rows, "media_id long, seg_idx int, speaker string, text string, start_ms long, end_ms long, words array<struct<word:string,start_ms:long,end_ms:long,confidence:double>>")
    got = sorted((r["media_id"], r["piece_idx"], r["text"], r["start_ms"], r["end_ms"]) for r in packing.split_long_segments(df, 60).collect())
    assert got == sorted(want)


def test_merge_segments_random(spark):
    rng = random.Random(6)
    rows, want = [], []
    for m in range(60):
        t, cur = 0, None
        for k in range(rng.randrange(1, 40)):
            t += rng.choice([0, 100, 300, 301, 900])
            s = (rng.choice("AB"), "x" * rng.randrange(1, 30), t, t + rng.randrange(1, 500))
            t = s[3]
            rows.append((m, k, *s))
            if cur and cur[0] == s[0] and s[2] - cur[3] <= 300 and len(cur[1]) + len(s[1]) + 1 <= 60:
                cur[1] += " " + s[1]
                cur[3] = s[3]
                cur[4] += 1
            else:
                cur = [*s, 1]
                want.append((m, cur))
    df = spark.createDataFrame(rows, "media_id long, seg_idx int, speaker string, text string, start_ms long, end_ms long")
    got = sorted((r["media_id"], r["seg_idx"], r["speaker"], r["text"], r["start_ms"], r["end_ms"], r["n_pieces"]) for r in packing.merge_segments(df, 60).collect())
    number, expect = {}, []
    for m, c in want:
        expect.append((m, number.get(m, 0), *c))
        number[m] = number.get(m, 0) + 1
    assert got == sorted(expect)


def test_exclusive_voices(spark):
    cand = spark.createDataFrame([(1, "a", "v1", 1), (1, "a", "v2", 2), (1, "b", "v1", 1), (1, "b", "v2", 2), (1, "c", "v1", 1), (1, "d", "v2", 1), (2, "a", "v1", 1)], "media_id long, speaker string, voice string, rank int")
    order = spark.createDataFrame([(1, "a", 0, 2000), (1, "b", 1, 5000), (1, "c", 2, 5000), (1, "d", 3, 5000), (1, "e", 4, 5000), (2, "a", 0, 5000)], "media_id long, speaker string, first_idx int, ref_ms int")
    got = {(r["media_id"], r["speaker"]): r["voice"] for r in voices.exclusive_voices(cand, order).collect()}
    # a's reference is short: it uses v1 without taking it
    assert got == {(1, "a"): "v1", (1, "b"): "v1", (1, "c"): "default", (1, "d"): "v2", (1, "e"): "default", (2, "a"): "v1"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_catalogue_voices_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    order = [(m, s, rng.randrange(5), rng.choice([2000, 5000, 5000, 3000, None])) for m in range(6) for s in "abcd"]
    cand = [(m, s, v, k) for m, s, *_ in order if rng.random() < 0.9 for k, v in enumerate(rng.sample(["v1", "v2", "v3", "v4", "v5", "v6", "gone"], rng.randrange(1, 7)))]
    if seed == 3:  # all want the same voices in the same order
        cand = [(m, s, f"v{k}", k) for m, s, *_ in order for k in range(1, 7)]
    taken, want = {"gone"}, {}
    for m, s, _, ms in sorted(order, key=lambda x: (x[0], x[2], x[1])):
        free = [v for _, v in sorted((k, v) for a, b, v, k in cand if (a, b) == (m, s)) if v not in taken]
        want[m, s] = free[0] if free else "default"
        if free and ms is not None and ms >= 3000:
            taken.add(free[0])
    got = voices.catalogue_voices(spark.createDataFrame(cand, "media_id long, speaker string, voice string, rank int"), spark.createDataFrame(order, "media_id long, speaker string, first_idx int, ref_ms int"), spark.createDataFrame([("gone",), ("gone",)], "voice string"))
    assert {(r["media_id"], r["speaker"]): r["voice"] for r in got.collect()} == want


def test_cues_cover_their_segment(spark):
    rows = [(1, 0, 0, 1000, "Short one"), (1, 1, 1000, 5000, "First sentence. Second, rather longer sentence here! Third"), (1, 2, 5000, 5100, "word " * 40), (1, 3, 6000, 7000, None), (1, 4, 7000, 8000, "")]
    df = spark.createDataFrame(rows, "media_id long, seg_idx int, start_ms long, end_ms long, text string")
    got = sorted(tuple(r) for r in subtitles.cues(df, max_chars=30).select("seg_idx", "part", "start_ms", "end_ms", "text").collect())
    assert got[0] == (0, 0, 0, 1000, "Short one")
    second = [r for r in got if r[0] == 1]
    assert [r[4] for r in second] == ["First sentence.", "Second, rather longer sentence", "here!", "Third."]
    assert second[0][2] == 1000 and second[-1][3] == 5000 and all(a[3] == b[2] for a, b in zip(second, second[1:], strict=False))
    third = [r for r in got if r[0] == 2]
    assert all(len(r[4]) <= 30 for r in third) and third[-1][3] == 5100


def test_chunk_offsets_and_short_tail(spark):
    blocks = spark.createDataFrame([(1, k, 300_000) for k in range(7)] + [(2, 0, 100_000)] + [(3, 0, 2_000_000), (3, 1, 10_000)], "media_id long, block_idx int, dur_ms long")
    got = sorted(tuple(r) for r in packing.block_chunks(blocks).collect())
    assert got == [(1, 0, 0, 900_000, 3), (1, 1, 900_000, 900_000, 3), (1, 2, 1_800_000, 300_000, 1), (2, 0, 0, 100_000, 1), (3, 0, 0, 2_010_000, 2)]


def test_chunks_of_long_media(spark):
    rng = random.Random(8)
    segments, blocks, want, want_blocks = [], [], [], []
    for m, n in ((1, 25_000), (2, 1), (3, 40), (None, 30)):
        count, switches, before, chunk, ms, block = 0, 0, None, -1, 0, -1
        for k in range(n):
            speaker, dur = rng.choice(["A", "A", "A", "B", "C", None]), rng.choice([0, 1_000, 90_000, 400_000, 950_000])
            switches += before is not None and speaker is not None and speaker != before
            if k == 0 or count == 10 or switches > 3:
                count, switches, chunk = 0, 0, chunk + 1
            count, before = count + 1, speaker
            if k == 0 or ms + dur > 900_000:
                ms, block = 0, block + 1
            ms += dur
            segments.append((m, k, speaker))
            blocks.append((m, k, dur))
            want.append((m, chunk, k, speaker))
            want_blocks.append((m, block, dur))
    rng.shuffle(segments)
    got = packing.translation_chunks(spark.createDataFrame(segments, "media_id long, seg_idx int, speaker string"))
    assert got.columns == ["media_id", "chunk_idx", "seg_idx", "speaker"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    expect = {}
    for m, b, dur in want_blocks:
        expect.setdefault(m, {}).setdefault(b, []).append(dur)
    for chunks in expect.values():
        last = max(chunks)
        if last and sum(chunks[last]) < 300_000:
            chunks[last - 1] += chunks.pop(last)
    found = packing.block_chunks(spark.createDataFrame(blocks, "media_id long, block_idx int, dur_ms long"))
    rows = sorted(((r["media_id"], r["chunk_idx"], r["dur_ms"], r["n_blocks"]) for r in found.collect()), key=str)
    assert rows == sorted(((m, b, sum(d), len(d)) for m, chunks in expect.items() for b, d in chunks.items()), key=str)
    # no media item is gathered in one row
    for df in (got, found):
        assert "collect_list" not in df._jdf.queryExecution().toString()
