"""Substring dedup against brute force over all windows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from segflow.llm import common, suffixdedup

LENGTH = suffixdedup.LENGTH


def brute(rows):
    seen, out = set(), []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    result = {}
    for row in order:
        text = (row[1] or "").encode()
        gone = bytearray(len(text))
        for p in range(len(text) - LENGTH + 1):
            w = text[p : p + LENGTH]
            if w in seen:
                gone[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        result[row] = (row[0], len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    out = [result[r] for r in rows]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, key string")
    return sorted(map(tuple, suffixdedup.drop_repeats(df).collect()), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "of", "été", "über", "a", "thing", "tion", "x", "\n", "con"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    passages = [text(rng.choice([12, 15, 16, 17, 40])) for _ in range(6)]
    hot = text(60)
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        if rng.random() < 0.4:
            t += hot[rng.choice([0, 0, 0, 3, 50]) :]
        if rows and rng.random() < 0.2:
            t = rng.choice(rows)[1]
            if rng.random() < 0.5 and t:
                at = rng.randrange(len(t))
                t = t[:at] + "#" + t[at + 1 :]
        rows.append((i * 7 % n, t))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_many_splitters_on_a_hot_passage(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        rows = corpus(2, 300)
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edge_cases(spark):
    long = "abcdefghij" * 30
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 101), (6, "a" * 1000), (7, long), (7, long), (7, long + "!"), (None, long), (8, "é" * 60), (9, "é" * 60 + "x")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_multikey_quicksort_is_lexicographic():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500, 6000):
        keys = [rng.integers(0, 4, n) for _ in range(6)]
        for small in (1, 64, 1024):
            order = suffixdedup.multikey_quicksort(keys, small)
            assert sorted(order.tolist()) == list(range(n))
            assert all((k[order] == k[np.lexsort(keys[::-1])]).all() for k in keys)


def test_equal_hashes_remove_nothing_wrong(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "content_hash", lambda rows: np.zeros(len(rows), np.uint64))
    rows = corpus(3, 60)
    assert run(spark, rows) == brute(rows)


def test_equal_gram_hashes_remove_nothing_wrong(spark, monkeypatch):
    # all grams have one of four hashes, so every suffix is compared
    real = suffixdedup.gram_hashes
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda body: real(body) & np.uint64(3 << 60))
    rows = corpus(4, 40)
    assert run(spark, rows) == brute(rows)


def test_long_texts_go_in_stretches(spark):
    rng = random.Random(5)
    own = "".join(rng.choice("abcdefghij klmno") for _ in range(3 << 20))
    passage = "".join(rng.choice("pqrst uvwxyz") for _ in range(150))
    cut = (2 << 20) - 70  # a passage over the end of a stretch
    long = own[:cut] + passage + own[cut:]
    rows = [(1, passage), (2, long), (3, own[1_000_000:1_000_300]), (4, long[-(1 << 20) - 60 :])]
    got = {r[0]: r[1:4] for r in run(spark, rows)}
    assert got == {1: (150, 0, 0), 2: (len(long), 150, 1), 3: (300, 300, 1), 4: (len(rows[3][1]), len(rows[3][1]), 1)}


def test_equal_checksums_of_one_id_are_told_apart(spark):
    rng = random.Random(6)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2)]
    seen, pair = {}, None
    while pair is None:  # a birthday search for two texts with one crc32
        text = own[rng.randrange(2)] + "".join(rng.choice("ijklmnop") for _ in range(12))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other[:150] != text[:150]:
            pair = (other, text)
    rows = [(5, pair[0]), (5, pair[1]), (9, pair[0][:120]), (None, pair[0]), (None, pair[1])]
    assert {r[0]: r[2] for r in run(spark, rows) if r[0] == 9} == {9: 120}
    assert run(spark, [(5, pair[0]), (5, pair[1]), (1, pair[0][:120])]) == brute([(5, pair[0]), (5, pair[1]), (1, pair[0][:120])])


@pytest.mark.parametrize("nulls_last", [False, True])
def test_repeated_ids_are_numbered_in_order(spark, nulls_last):
    rows = [(7, "b"), (None, "n"), (7, "b"), (7, "a"), (-2, None), (None, "m")]
    found = common.identified(spark.createDataFrame(rows, "doc_id long, text string"), nulls_last).orderBy("doc").collect()
    null = [(None, t, 1) for t in sorted("mn", key=lambda t: zlib.crc32(t.encode()))]
    known = [(-2, None, 1), *[(7, t, 1 + (t == "b")) for t in sorted("ab", key=lambda t: zlib.crc32(t.encode()))]]
    assert [(r["doc_id"], r["text"], r["copies"]) for r in found] == (known + null if nulls_last else null + known)
