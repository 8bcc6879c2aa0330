"""The blocked product against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from segflow.llm import ngramjoin


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cls string")
    return sorted(map(tuple, ngramjoin.jaccard_components(df).collect()), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    bases = [rng.choices(words, k=rng.choice([3, 4, 5, 9, 30, 120, 300])) for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w = passage + w[:40]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin.links, "__defaults__", (7, 500))
    rows = corpus(2, 120)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A B"), (6, "a"), (7, "a b c d"), (8, "a b c d"), (9, "x " * 3000), (10, "x x x x"), (None, "a b"), (None, "q r s t u"), (7, "a b c d")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def brute_groups(rows, n, percent):
    """The least id of each row's component, by all pairs."""

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and least[i] != least[j]:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return sorted((rows[i][0], len(s), rows[k][0]) for i, (s, k) in enumerate(zip(sets, least, strict=True)))


def near_pairs(seed):
    """corpus() and pairs of 45 to 80 words that differ in one or two: about 0.8 of their 5-grams, 0.85 of their 4-grams."""
    rng = random.Random(seed)
    rows = [(d, t) for d, t in corpus(seed)]
    for size in range(45, 80):
        w = [f"{seed}.{size}.{i}" for i in range(size)]
        for _ in range(2):
            x = list(w)
            x[rng.randrange(5, size - 5)] = f"y{rng.random()}"
            rows.append((len(rows), " ".join(x)))
        rows.append((len(rows), " ".join(w)))
    return rows


def test_other_lengths_and_thresholds(spark, monkeypatch):
    rows = near_pairs(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    found = {}
    for n, percent in ((5, 80), (4, 85), (3, 60)):
        found[n] = sorted(map(tuple, ngramjoin.jaccard_components(df, n, percent).collect()))
        assert found[n] == brute_groups(rows, n, percent)
    assert found[5] != found[4]
    monkeypatch.setattr(ngramjoin.links, "__defaults__", (7, 500))
    assert sorted(map(tuple, ngramjoin.jaccard_components(df, 5, 80).collect())) == found[5]


def test_stage_drops_five_word_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = near_pairs(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [d for d, _, least in brute_groups(rows, 5, 80) if d == least]
    assert got != [d for d, _, least in brute_groups(rows, 4, 85) if d == least]


def test_one_large_group_costs_in_proportion(spark, monkeypatch):
    """A group of near copies much larger than a block: rows dealt to tasks stay a small multiple of its rows."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(9000 + i, " ".join(f"y{rng.random()}" if rng.random() < 0.2 else x for x in base)) for i in range(40)]  # in the group, linked with few
    monkeypatch.setattr(ngramjoin.links, "__defaults__", (50, 10**9))
    dealt, real = [], ngramjoin.multiply

    def counted(tasks, sets, percent):
        dealt.append(tasks.count())
        return real(tasks, sets, percent)

    monkeypatch.setattr(ngramjoin, "multiply", counted)
    assert run(spark, rows) == brute(rows)
    assert max(dealt) < 8 * len(rows)


def test_clashing_names_and_equal_rows_in_the_stage(spark):
    rows = [(1, "a b c d e f", k) for k in range(3)] + [(1, "a b c d e f", 0), (2, "A b c d e f", 9), (None, "q r s t u v", 1), (None, None, 1), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for c in ("_h", "_id", "key", "row", "text_hash", "component_id", "cls", "part", "body", "root"):
        df = df.withColumn(c, F.concat(F.lit(c), F.col("n").cast("string")))
    out = ngramjoin.one_of_each_group(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, "a b c d e f"), (None, "q r s t u v"), (None, None), (3, "")], key=str)
    assert all(r[c] == f"{c}{r['n']}" for r in got for c in ("_h", "_id", "key", "row", "text_hash", "component_id", "cls", "part", "body", "root"))
    again = ngramjoin.one_of_each_group(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_near_copies_of_repeated_and_null_ids_go(spark):
    from segflow.llm.ngramjoin import one_of_each_group

    t, u = (" ".join(f"{c}{k}" for k in range(60)) for c in "tu")
    for rows, want in (
        ([(5, t), (None, t + " word"), (None, u)], [(5, t), (None, u)]),
        ([(3, t), (7, t + " word"), (7, u)], [(3, t), (7, u)]),
        ([(7, t), (7, t), (7, t + " word"), (None, t), (None, ""), (None, None), (7, "")], [(7, None), (7, ""), (None, ""), (None, None)]),
    ):
        docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key int")
        got = [(r["doc_id"], r["text"]) for r in one_of_each_group(docs, 5, 80).collect()]
        if want[0] == (7, None):  # of the two near copies with one id either may stay
            assert len(got) == 4 and sum(bool(x[1]) for x in got) == 1 and {x for x in got if not x[1]} == set(want[1:])
        else:
            assert sorted(got, key=str) == sorted(want, key=str)
