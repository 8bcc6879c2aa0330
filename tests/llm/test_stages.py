"""Pipeline stages, one by one, against plain Python over the same small tables, with odd rows and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from segflow.llm import quality
from segflow.llm.queries import op7_quality_mil

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, or give their results.
CLASHES = ("score", "_id", "_h", "_r", "_same", "key", "row", "text_hash", "file", "slot", "n", "p", "size", "id", "same", "cls", "component_id", "taken", "a.b", "part")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=70):
    """(rows, labels, items): prose, junk, near copies, leaked items, nulls, blanks, a long text and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [prose(k) for k in (3, 9, 14, 20)] + ["x"]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        t = prose(rng.randrange(40, 160)) if good else " ".join(rng.choice(["#$%", "|||", "BUY!!!", "12<>34"]) for _ in range(60))
        if good and i % 10 == 1:
            x = list(rng.choice(items[1:4]))
            x[rng.randrange(len(x))] = "z"
            t = t[: len(t) // 2] + " " + "".join(x).upper() + "; " + t[len(t) // 2 :]
        if good and i % 10 == 2:
            t += " " + items[0] + "."
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(good), 0))
        if good and i % 4 == 0:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + i, " ".join(w), "en", "s1", len(t)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, " \n\t", "en", None, 3), (2003, prose(6000), "en", "s2", 1), (None, prose(80), "en", "s0", 1), (2004, "a few words", "en", "s0", 11)]
    rows += [rows[1], rows[1]]
    return rows, labels, items


def table(spark, rows):
    """rows as documents with a column for every clashing name, whose value tells the row."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, None), (None, "!?"), (None, items[1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def run(spark, pipeline, name, rows, folder, tmp_path):
    """The stage over rows read from files, as the pipeline runs it; the clashing columns must come through unharmed."""
    source = str(tmp_path / f"in-{name}")
    table(spark, rows).repartition(3).write.parquet(source)
    docs = spark.read.parquet(source)
    dict(pipeline.STAGES)[name](spark, docs, folder).write.parquet(str(tmp_path / name))
    out = spark.read.parquet(str(tmp_path / name))
    if name != "token_shards":
        assert out.columns == docs.columns
        for c in CLASHES:
            assert out.filter(F.col(f"`{c}`") != F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string"))).count() == 0, c
    return out


def ids(out):
    return sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str)


# --- quality -----------------------------------------------------------------------------------------------------------


def plain_passages(text):
    """Features of each passage of a text, byte by byte."""
    b, size = (text or "").encode(), quality.PASSAGE
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
    classes = quality.byte_classes()
    out = []
    for p in range(max(1, math.ceil(len(b) / size))):
        piece = range(p * size, min((p + 1) * size, len(b)))
        length, f = max(1, len(piece)), [0.0] * quality.WIDTH
        for i in piece:
            f[classes[b[i]]] += 1 / length
            if i + 1 < len(b):
                f[quality.CLASSES + ((b[i] * 2654435 + b[i + 1] * 40503) % 2**32 >> 7 & quality.PAIRS - 1)] += 1 / length
        mine = [k for k, (at, _) in enumerate(words) if at in piece]
        n = max(1, len(mine))
        same = sum(k - 1 in mine and words[k][1] == words[k - 1][1] for k in mine)
        f[-4:] = [same / n, sum(len(words[k][1]) for k in mine) / n / 10, n / length * 5, min(1, length / size)]
        out.append(f)
    return out


def plain_score(model, text):
    """Gated attention over passages in plain Python."""
    p = {k: np.asarray(v, float).tolist() for k, v in model.p.items()}
    mean, scale = model.mean.tolist(), model.scale.tolist()
    times = lambda x, m: [sum(a * row[j] for a, row in zip(x, m, strict=True)) for j in range(len(m[0]))]
    hidden, weight = [], []
    for f in plain_passages(text):
        x = [(a - m) / s for a, m, s in zip(f, mean, scale, strict=True)]
        h = [math.tanh(a + b) for a, b in zip(times(x, p["W"]), p["b"], strict=True)]
        gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(times(h, p["V"]), times(h, p["U"]), strict=True)]
        hidden.append(h)
        weight.append(math.exp(sum(a * b for a, b in zip(gate, p["w"], strict=True))))
    total = sum(weight)
    z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / total for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["d"]))


def test_quality_scores_match_a_plain_forward_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, labels.filter(~held))
    got = {r["doc_id"]: r for r in op7_quality_mil(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        s = plain_score(model, r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(s, abs=1e-4)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_stage(spark, pipeline, folder, tmp_path):
    rows, labels, _ = corpus()
    out = run(spark, pipeline, "quality_classifier", rows, folder, tmp_path)
    model = quality.fit(spark.read.parquet(str(tmp_path / "in-quality_classifier")), spark.read.parquet(f"{folder}/labels.parquet"))
    want = [d for d, t, *_ in rows if plain_score(model, t) >= 0.3]
    assert ids(out) == sorted(want, key=str)
    good = {d for d, q, _ in labels if q}
    assert good - set(want) == set() and len(want) < len(rows)


# --- near copies ---------------------------------------------------------------------------------------------------------


def test_near_copy_stage(spark, pipeline, folder, tmp_path):
    rows, _, _ = corpus()
    out = run(spark, pipeline, "near_copies", rows, folder, tmp_path)

    def shingles(text):
        w = WORD.findall((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    one = sorted(set(rows), key=str)
    sets, group = [shingles(r[1]) for r in one], list(range(len(one)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = [min((one[i][0] for i in range(len(one)) if group[i] == g), key=lambda d: (d is None, d or 0)) for g in sorted(set(group))]
    assert ids(out) == sorted(want, key=str)
    assert len(want) < len(one)


# --- decontamination -----------------------------------------------------------------------------------------------------


def plain_normal(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def plain_leak(item, text):
    """Whether item is in text: within 8 % of edits, or word for word if it is short."""
    item, text = plain_normal(item), plain_normal(text)
    if not item or not text:
        return False
    if len(item) < 30:
        return f" {item} " in f" {text} "
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([c != d for d in text]))
        new = np.concatenate([[i + 1], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min() <= int(0.08 * len(item))


def test_decontamination_stage(spark, pipeline, folder, tmp_path):
    rows, _, items = corpus()
    out = run(spark, pipeline, "decontamination", rows, folder, tmp_path)
    want = [d for d, t, *_ in rows if not any(plain_leak(x, t) for x in items)]
    assert ids(out) == sorted(want, key=str)
    assert 5 < len(rows) - len(want) < len(rows) / 2


# --- mix -----------------------------------------------------------------------------------------------------------------


def plain_mix(rows, block=1024):
    """[(row, pass, first slot, words taken)] of the mix, slot by slot."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: 2.0 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        over = {s for s in sources if s not in full and target[s] > 2 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    quota = {s: min(math.floor(target[s] + 0.5), 2 * total[s]) for s in sources}
    blocks = {s: -(-quota[s] // block) for s in sources}
    n, at, bounds = sum(blocks.values()), 0, []
    for s in sources:
        bounds.append((math.floor(at / n * 2**31), math.floor((at + blocks[s]) / n * 2**31), s))
        at += blocks[s]
    owner, met, late = {}, dict.fromkeys(sources, 0), []
    for slot in range(n):
        u = slot * 1327217885 % 2**31
        s = next(s for lo, hi, s in bounds if lo <= u < hi)
        if met[s] < blocks[s]:
            owner[s, met[s]] = slot
        else:
            late.append(slot)
        met[s] += 1
    short = sorted((b, sources.index(s)) for s in sources for b in range(met[s], blocks[s]))
    for slot, (b, k) in zip(late, short, strict=True):
        owner[sources[k], b] = slot
    out = []
    for s in sources:
        mine = sorted((i for i in range(len(rows)) if rows[i][3] == s), key=lambda i: (hashlib.md5(("mix:" + str(rows[i][0])).encode() if rows[i][0] is not None else b"mix").hexdigest(), rows[i][0] or 0))
        for k in range(2):
            a = k * total[s]
            for i in mine:
                b = min(a + size[i], quota[s])
                if a < b:
                    out.append((rows[i][0], k, min(owner[s, x] for x in range(a // block, (b - 1) // block + 1)), b - a))
                a += size[i]
    return out


def test_mix_stage(spark, pipeline, folder, tmp_path):
    rows = [r for r in corpus()[0]]
    out = run(spark, pipeline, "source_mix", rows, folder, tmp_path)
    got = out.select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    want = plain_mix(rows)
    assert sorted(((r["doc_id"], len(WORD.findall(r["text"]))) for r in got), key=str) == sorted(((d, n) for d, _, _, n in want), key=str)
    first = {}
    for d, _, slot, n in want:
        first.setdefault((d, n), []).append(slot)
    slots = []
    for r in got:  # rows of one id and size take their slots in turn
        slots.append(sorted(first[r["doc_id"], len(WORD.findall(r["text"]))])[sum(x["doc_id"] == r["doc_id"] and x["text"] == r["text"] for x in got[: len(slots)])])
    assert slots == sorted(slots)


# --- tokens --------------------------------------------------------------------------------------------------------------


def test_token_stage(spark, pipeline, folder, tmp_path):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, _, _ = corpus()
    got = run(spark, pipeline, "token_shards", rows, folder, tmp_path).orderBy("start").collect()
    order = spark.read.parquet(str(tmp_path / "in-token_shards")).select("doc_id", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    start, want = 0, []
    for r in order:
        x = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("more", [(), ("_metadata",), ("_metadata", "a.b")])
def test_token_stage_goes_by_file_numbers(spark, pipeline, folder, tmp_path, more):
    """part-100000 comes after part-99999, and a column called _metadata doesn't hide the order."""
    at = tmp_path / "many"
    at.mkdir()
    for k, doc in ((99_999, 7), (100_000, 3), (5, 9)):
        one = str(tmp_path / f"one-{k}")
        rows = spark.createDataFrame([(doc, "a b"), (doc - 1, "c")], "doc_id long, text string")
        rows.select("*", *[F.lit("x").alias(c) for c in more]).coalesce(1).write.parquet(one)
        next(Path(one).glob("*.parquet")).rename(at / f"part-{k:05d}-x.parquet")
    got = dict(pipeline.STAGES)["token_shards"](spark, spark.read.parquet(str(at)), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [9, 8, 7, 6, 3, 2]


def test_tables_between_stages_go_when_a_stage_fails(spark, pipeline, folder, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(pipeline, "shared_dir", lambda _: str(shared))
    monkeypatch.setattr(pipeline, "table", lambda *_: table(spark, corpus()[0]))

    def fail(*_):
        raise ValueError("stage")

    monkeypatch.setattr(pipeline, "STAGES", [("first", lambda spark, docs, _: docs), ("second", fail), ("third", fail)])
    with pytest.raises(ValueError):
        pipeline.run(spark, folder)
    assert list(shared.iterdir()) == []


def test_token_stage_of_a_table_without_files(spark, pipeline, folder):
    docs = spark.createDataFrame([(3, "c"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = dict(pipeline.STAGES)["token_shards"](spark, docs, folder).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 1), (1, 1, 3), (3, 4, 2)]


def test_stages_take_tables_that_are_not_read_from_files(spark, pipeline, folder):
    docs = table(spark, corpus()[0])
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0


def test_empty_tables(spark, pipeline, folder, tmp_path):
    for name, _ in pipeline.STAGES:
        assert run(spark, pipeline, name, [], folder, tmp_path).count() == 0


def test_run_is_its_stages(spark, pipeline, folder, tmp_path):
    rows, _, _ = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(tuple, pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
