"""Word-window dedup by fixed blocks against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from segflow.llm import blockdedup
from segflow.llm.queries import op11_block_dedup

W = blockdedup.WINDOW


def brute(rows):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + W]) for w in texts for i in range(len(w) - W + 1))
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - W + 1):
            if seen[tuple(words[i : i + W])] > 1:
                gone[i : i + W] = [True] * W
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, b"x", "y") for d, t in rows], "doc_id long, text string, copies int, z binary, spans string")
    return sorted(map(tuple, blockdedup.drop_repeated_passages(df).collect()), key=str)


def corpus(seed, n=150, vocabulary=40):
    rng = random.Random(seed)
    words = [rng.choice("abcdéü") * rng.randrange(1, 4) + str(k) for k in range(vocabulary)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(k) for k in (17, 18, 34, 35, 36, 53, 90)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.2:
            t = rng.choice(rows)[1].split()
            if t and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
        rows.append((i * 7 % n, rng.choice([" ", "\n", "  \t"]).join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    t = " ".join(f"w{k}" for k in range(60))
    same = " ".join(["again"] * 36)
    rows = [(1, None), (2, ""), (3, " \n "), (4, " ".join(["a"] * 34)), (5, same), (6, t), (7, " ".join(f"v{k}" for k in range(40))), (None, t + " x"), (8, " ".join(["n"] * 80)), (9, " ".join(["b"] * 35))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_equal_ids_and_repeated_rows(spark):
    t, u = (" ".join(f"{c}{k}" for k in range(50)) for c in "tu")
    rows = [(1, t), (1, t), (1, u), (None, u + " z"), (None, None), (None, ""), (2, "short one"), (2, "short one"), (3, " ".join(f"own{k}" for k in range(99)))]
    assert run(spark, rows) == brute(rows)


def test_long_texts_go_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(blockdedup, "SLICE", 2000)
    monkeypatch.setattr(blockdedup, "WORDS", 300)
    rng = random.Random(3)
    own = [f"o{rng.randrange(10**6)}" for _ in range(6000)]
    passage = [f"p{k}" for k in range(50)]
    rows = [(1, " ".join(passage)), (2, " ".join(own)), (3, " ".join(own[2000:2040]))]
    for at in (0, 290, 1111, 4000):
        rows.append((10 + at, " ".join(own[:at][::-1] + passage + ["x" * 5000] + own[at:][::-1])))
    assert run(spark, rows) == brute(rows)


def test_equal_block_hashes_remove_nothing_wrong(spark, monkeypatch):
    real = blockdedup.rolling
    monkeypatch.setattr(blockdedup, "rolling", lambda key, n: real(key, n) & np.uint64(3 << 60) if n == blockdedup.BLOCK else real(key, n))
    rows = corpus(4, 40)
    assert run(spark, rows) == brute(rows)


def test_kept_text_is_returned(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, "a b " + t), (2, t + " c"), (3, "d  e")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in blockdedup.drop_repeated_passages(df, with_text=True).collect()} == {1: "a b", 2: "c", 3: None}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_block_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
