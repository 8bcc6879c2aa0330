"""Source divergence against plain Python and against dense matrices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from segflow.llm import divergence


def brute(rows, least):
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for x, s, t in rows]
    df, count, every = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for x, s, w in docs:
        df[x].update(set(w))
        count[x, s].update(w)
        every[x].update(w)
    out = []
    for x, s in {d[:2] for d in docs}:
        kept = [t for t, n in df[x].items() if n >= least]
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))  # noqa: B023, E731
        pair = sorted(((-sum(abs(p(count[x, s], t) - p(count[x, o], t)) for t in kept), o.encode(), o) for y, o in {d[:2] for d in docs} if y == x and o != s))
        term = sorted((p(every[x], t) - p(count[x, s], t), t.encode(), t) for t in kept if count[x, s][t] and p(count[x, s], t) > p(every[x], t))
        out += [(x, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)] + [(x, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(term[:50])]
    return sorted(out)


def corpus(seed, n, n_sources):
    rng = random.Random(seed)
    words = [rng.choice(["été", "Über", "a", "The", "naïve", "x"]) + rng.choice(["", "s", "ß", "É"]) + "".join(rng.choice("abc") for _ in range(rng.randrange(3))) for _ in range(200)]
    sources = [f"s{k}" for k in range(n_sources)] + [None, "", "é"]
    rows = []
    for _ in range(n):
        here = rng.randrange(200)
        rows.append((rng.choice(["en", "de", None]), rng.choice(sources), rng.choice([" ", "-", "1"]).join(words[(here + rng.randrange(60)) % 200] for _ in range(rng.randrange(40)))))
    return [*rows, ("xx", "only", "rare words"), ("xx", "other", None), ("en", "nothing", "123 !"), ("yy", "lone", "")]


def run(spark, rows, least, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, item string")
    return sorted(map(tuple, divergence.source_divergence(df, least, **options).collect()))


@pytest.mark.parametrize(("side", "n_sources"), [(128, 6), (4, 23)])
def test_matches_plain_python(spark, monkeypatch, side, n_sources):
    monkeypatch.setattr(divergence, "SIDE", side)
    rows = corpus(side, 300, n_sources)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_nothing_kept_and_empty_table(spark):
    rows = corpus(3, 20, 3)
    assert run(spark, rows, 10_000) == brute(rows, 10_000)
    assert run(spark, [], 1) == []


@pytest.mark.parametrize("seed", range(6))
def test_trees_give_the_dense_distances(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(divergence, "SIDE", 16)
    rows, others, columns = (int(rng.integers(1, 17)) for _ in range(3))
    dense, trees, zeros = [], [], []
    for n in (rows, others):
        zero = np.zeros(16, np.int64)
        zero[:n] = rng.integers(1, 50, n)
        hit = rng.random((n, columns)) < rng.choice([0, 0.05, 0.5, 1])
        value = rng.integers(50, 10**9, (n, columns))
        dense.append(np.where(hit, value, zero[:n, None]))
        i, j = np.nonzero(hit)
        mixed = rng.permutation(len(i))
        trees.append(divergence.Tree(i[mixed], j[mixed], value[i, j][mixed]))
        zeros.append(zero)
    out = np.zeros((16, 16), np.int64)
    divergence.add_distances(out, *trees, *zeros, columns)
    assert (out[:rows, :others] == np.abs(dense[0][:, None] - dense[1][None]).sum(2)).all()


def test_large_counts_stay_exact(spark):
    row = spark.range(1).selectExpr(f"{divergence.share('9000000000000000', '9100000000000000', '7')} AS p").first()
    assert row["p"] == 1 + 1_000_000_000 * (9_000_000_000_000_005) // (9_100_000_000_000_035)
