"""Tokenizer alignment against a plain version that walks over bytes."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from segflow.llm import alignment
from segflow.llm.queries import op13_tokenizer_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(tokenizers, rows):
    a_model, b_model = tokenizers
    to_byte = alignment.byte_of_character()
    linked, out, held = [], [], defaultdict(int)
    for doc, text in rows:
        want = (" " + text).encode() if text else b""
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a = [bytes(to_byte[c] for c in a_model.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b_model.id_to_piece(k)) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append([doc, 0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        of_a, of_b = ([k for k, t in enumerate(side) for _ in t] for side in (bytes_a, bytes_b))
        links = Counter((a[i], b[j]) for i, j in set(zip(of_a, of_b, strict=True)))
        cuts = [p for p in range(1, len(want) + 1) if p == len(want) or (of_a[p] != of_a[p - 1] and of_b[p] != of_b[p - 1])]
        groups = []
        for x, y in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(of[x:y]))) for ids, of in ((a, of_a), (b, of_b))))
        out.append([doc, len(a), len(b), len(cuts), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        linked.append(links)
        for pair in links:
            held[pair] += 1
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for r, links in zip(out, linked, strict=True):
        r[5:5] = [sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items())]
    return sorted(map(tuple, out), key=str)


TEXTS = [
    None, "", " ", "\n", "a", "two words", " leading", "trailing ", "double  space", "tab\tand\nline", "it's we'll DON'T", "été Über naïve ﬁn", "日本語テキスト", "emoji 👍🏽 ok", "𐍈 rare 𠮷", "�", "é",
    "<|endoftext|> plain", "<s> </s> <unk> <0x41>", "▁ under", "numbers 12345 3.14", "x" * 300, "ᚠᛇᚻ Ꞗ ꭬", " nbsp　wide", "A\u0000B", "क्षत्रिय ไทย ა", "…—“quotes”", "foo_bar(baz)[1] != {};", "same text", "same text",
]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, part int, records binary")
    return sorted(map(tuple, alignment.align_tokenizers(df, A, B).collect()), key=str)


def test_matches_plain_version(spark, tokenizers):
    rng = random.Random(1)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice([t for t in TEXTS if t]) for _ in range(rng.randrange(1, 8)))) for k in range(60)]
    assert run(spark, rows) == brute(tokenizers, rows)
    assert run(spark, []) == []


def test_small_slices_and_chunks(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "CHUNK", 3)
    rows = list(enumerate(TEXTS * 3))
    assert run(spark, rows) == brute(tokenizers, rows)


def test_query_matches_plain_version(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(tokenizers, rows)


def test_quick_encoder_gives_the_tokenizers_ids(tokenizers):
    encoders = alignment.Encoders(A, B)
    assert encoders.ranked is not None
    chars = [c for k in range(0x10000) if not 0xD800 <= k < 0xE000 and not alignment.UNSETTLED.search(c := chr(k))]
    for i in range(0, len(chars), 16):
        text = "".join(f"x{c}1 {c}{c} z{c}'s\n" for c in chars[i : i + 16])
        assert encoders.ranked.encode_ordinary(text) == tokenizers[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_runs_merge_to_counts_and_maxima(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(alignment, "CHUNK", int(rng.integers(1, 9)))
    tables = []
    for _ in range(int(rng.integers(1, 9))):
        a, b = rng.integers(0, rng.integers(1, 30), 60), rng.integers(0, 40, 60)
        pair = np.unique((a << alignment.B_BITS) | b)[: int(rng.integers(1, 60))]
        tables.append((pair, rng.integers(1, 5, len(pair))))
    total, most = Counter(), defaultdict(int)
    for pair, n in tables:
        for p, k in zip(pair.tolist(), n.tolist(), strict=True):
            total[p] += k
    for p, n in total.items():
        most[p >> alignment.B_BITS] = max(most[p >> alignment.B_BITS], n)
    got = [[] for _ in tables]
    for count, best, places in alignment.merged_runs([alignment.chunked(*t) for t in tables]):
        for k, where in places:
            got[k] += zip(count[where].tolist(), best[where].tolist(), strict=True)
    assert got == [[(total[p], total[p] == most[p >> alignment.B_BITS]) for p in pair.tolist()] for pair, _ in tables]
