"""Language ID, quality and token shards: held-out accuracy, exact round trips and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from segflow.llm import langid, quality, queries, tokenbin

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_rate(text, codes):
    """Phrases of one greedy parse from start to end, normalised, letter by letter."""
    held, cur, n = "".join(map(chr, codes.tolist())), "", 0
    letters = langid.encode([text], langid.alphabet())[0].tolist()
    for c in map(chr, letters):
        if cur and cur + c in held:
            cur += c
        else:
            n, cur = n + 1, c if c in held else ""
    unseen = sum(chr(c) not in held for c in letters)
    return (n * np.log2(max(2, len(codes))) + 21 * unseen) / max(1, len(letters))


@pytest.mark.parametrize("dense", [1, 5, 40])
def test_phrases_match_a_plain_parse(monkeypatch, dense):
    import random

    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "SEGMENT", 64)
    rng = random.Random(dense)
    words = [" ".join(rng.choice(["cat", "sat", "mat", "über", "dog", "the", "жук", "x"]) for _ in range(400)) for _ in range(2)]
    codes = {"aa": langid.reference(words[:1], 1500), "bb": langid.reference([words[1][::-1], "日本語の本"], 5000), "cc": langid.reference(["z"], 10)}
    model = langid.Model(codes).build()
    texts = ["the mat", "THE--CAT", "a zebra", "日本", "q", "12 3", "", words[0], words[0][300:900] + words[1][:700], words[1][::-1] * 2, "жук" * 300, "qqq" * 100, "".join(rng.choice("abcdstx 語") for _ in range(1500))]
    rates, letters = model.rates(texts)
    for i, t in enumerate(texts):
        assert letters[i] == any(c.isalpha() for c in t)
        for j, lang in enumerate(model.langs):
            assert rates[i, j] == pytest.approx(plain_rate(t, model.codes[lang])), (t[:20], lang)
    assert model.predict(["the cat", "12 3", ""])[0] == ["aa", "und", "und"]


def test_large_scripts_are_told_apart():
    # two scripts of 600 letters each, and a third language that shares one of them in other orders
    import random

    rng = random.Random(1)
    one, two = [chr(0x4E00 + i) for i in range(600)], [chr(0xAC00 + i) for i in range(600)]
    text = lambda letters: "".join(rng.choice(letters) for _ in range(3000))
    texts = {"zh": text(one), "ko": text(two), "xx": text(one)}
    model = langid.Model({k: langid.reference([v], 24_000) for k, v in texts.items()}).build()
    assert model.predict([texts["zh"], texts["ko"], texts["xx"], texts["zh"][500:900]])[0] == ["zh", "ko", "xx", "zh"]


def test_short_labelled_texts_are_learned(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat", "en"), ("a dog", "en"), ("le chat", "fr"), ("un chien", "fr"), ("12", "no")] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    assert model.build().predict(["the dog", "le chien", "cat", "un chat"])[0] == ["en", "fr", "en", "fr"]


def test_long_texts_give_passages_to_the_reference(spark):
    rows = [(1, "header " * 3000 + "body of the text " * 3000, "en"), (2, "kurz und gut", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), passage_chars=500)
    assert len(model.codes["en"]) == 501 or len(model.codes["en"]) == 500


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op3_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog went to the house and " * 3, "en"), (2, "le chat et le chien sont dans la maison et " * 3, "fr"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, "the dog", None), (None, "la maison", "fr"), (6, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.identify(df, langid.fit(df)).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out) == [(0, "fr"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert all(0 <= r["score"] <= 1 for r in out)
    nothing = langid.fit(df.filter("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), nothing).count() == 0


def test_quality_held_out_accuracy(spark):
    out = queries.op7_quality_mil(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_quality_gradients():
    rng = np.random.default_rng(1)
    m = quality.Model(hidden=4, gate=3)
    x, owner, y = rng.standard_normal((9, quality.WIDTH)).astype(np.float64), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    m.p = {k: np.asarray(v, np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean(y * np.log(s := m.forward(x, owner, 4)[-1]) + (1 - y) * np.log(1 - s))
    g = m.gradients(x, owner, y)
    for k in m.NAMES:
        flat = m.p[k].reshape(-1)
        at = int(np.abs(np.asarray(g[k]).reshape(-1)).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert (up - down) / 2e-5 == pytest.approx(np.asarray(g[k]).reshape(-1)[at], rel=1e-3)


def test_attention_sums_to_one_and_odd_rows(spark):
    x, owner = quality.encode(np.frombuffer(b"a" * 1300, np.uint8), np.array([0, 0, 1300, 1300]))
    assert owner.tolist() == [0, 1, 1, 1, 2]
    m = quality.Model()
    assert np.allclose(np.bincount(owner, weights=m.attention(x, owner, 3)), 1)
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c" * 900, 0.5), (3, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (2, None)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(df, quality.fit(df, labels)).collect())
    assert {r["score"] for r in quality.score(df, quality.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), m).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 49408, n)).astype(np.uint16)
    w = tokenbin.WaveletMatrix.from_bytes(tokenbin.WaveletMatrix.build(x, 16).to_bytes())
    assert (w.decode() == x).all()
    for i in range(0, n, 97):
        assert w.access(i) == x[i] and w.rank(7, i) == (x[:i] == 7).sum()
    for k, at in enumerate(np.flatnonzero(x == 7)[::41].tolist()):
        assert w.locate(7, k * 41) == at
    assert w.rank(60000, n) == (x == 60000).sum() and w.rank(70000, n) == 0


@pytest.fixture(scope="module")
def path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name, by", [("word_bpe_49k.json", "parts"), ("byte_bpe_50k.json", "texts")])
def test_encoder_equals_the_tokenizer(name, by):
    import random

    import pyarrow as pa

    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    alphabet = list(" \n\t'eEéÉßİΣςσab12 .,!-$(×÷µªº\x85 \x00\x7f") + ["\u0301", "'s", "<|endoftext|>", "😀", "中", "ñ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 20))) for _ in range(3000)] + ["", None, "word " * 5000, "x" * 5000]
    encoder = tokenbin.Encoder(public_tokenizers.path(name), memo_bytes=100_000)
    assert encoder.by == by
    for part in (texts[:1500], texts[1500:], [], [None]):
        ids, counts = encoder.encode(pa.array(part, pa.string()), 2)
        ends = np.cumsum(counts)
        for t, e, c in zip(part, ends, counts, strict=True):
            assert ids[e - c : e].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def test_pieces_stay_known_when_the_memory_is_full(path, monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorstéèÉA") for _ in range(12))
    often, rare = [word() for _ in range(200)], [word() for _ in range(3000)]
    encoder = tokenbin.Encoder(path, memo_bytes=600 * 400)
    calls = []
    real = encoder.spell
    monkeypatch.setattr(encoder, "spell", lambda w: calls.extend(w.split(b"\n")) or real(w))
    for i in range(0, len(rare), 100):
        text = " ".join(often + rare[i : i + 100])
        ids, _ = encoder.encode(pa.array([text]), 2)
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert len(encoder.memo) + len(encoder.older) <= 2 * 400 + 2 * 300
    # the words of each text are asked of the tokenizer once, however many others come between
    assert len(calls) <= len(set(often)) + len(rare)


def test_shards_in_order(spark, path, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = [(i * 37 % 200, f"text number {i} " * (i % 13), 1) for i in range(200)] + [(None, "null id", 1), (5, None, 1), (5, "twin", 1), (5, "twin", 1), (-3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    tokenbin.write_shards(tokenbin.token_shards(df, path, shard_tokens=300), str(tmp_path / "s"))
    shards = tokenbin.read_shards(spark, str(tmp_path / "s"))
    assert shards.count() > 1
    got = sorted(map(tuple, tokenbin.with_starts(tokenbin.decode_documents(shards)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    crc = lambda text: zlib.crc32(np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((str(d), c) for d, _, _, c in got) == sorted((str(d), crc(x)) for d, x, _ in rows)
    assert tokenbin.token_shards(df.limit(0), path).count() == 0
