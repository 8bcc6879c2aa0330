"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from .alignment import align_tokenizers
from .blockdedup import drop_repeated_passages
from .chat import format_turns, probe_rows, read_back, text_parts
from .common import cut, remove, shared_dir, table
from .decontaminate import leaks
from .divergence import source_divergence
from .linededup import drop_widespread_lines
from .mixing import mix_counts
from .ngramjoin import jaccard_components
from .rules import quality_rules
from .suffixdedup import drop_repeats
from .tokenbin import decode_documents, read_shards, token_shards, with_starts, write_shards


def held_out(n: int, k: int):
    """Whether crc32 of the id leaves k modulo n; a null id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == k, F.lit(False))


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe_rows(spark))
    written = cut(format_turns(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    return read_back(written)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(3, 1)).select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_widespread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_read_back(table(spark, sf_dir, "documents"))


def tokens_read_back(docs: DataFrame, path: str | None = None, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs written as token shards in the given order and read back: doc_id, start, n_tokens and ids_crc32 of each.

    The shards stay in path if one is given; else they go to a new folder of the shared one and are removed once they are read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    place = path or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    try:
        write_shards(token_shards(docs, public_tokenizers.path("word_bpe_49k.json"), order=order), place)
        return with_starts(cut(decode_documents(read_shards(spark, place))))
    finally:
        if path is None:
            remove(spark, place)


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_pigeonhole_decontamination, op2_source_mix, op3_language_id, op4_line_dedup, op5_suffix_dedup, op6_token_shards, op7_quality_mil, op8_quality_rules, op9_ngram_jaccard, op10_chat_format, op11_block_dedup, op12_source_divergence, op13_tokenizer_alignment)}

WS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op2_source_mix": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WS}')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER () * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT min_by(level, most / weight) FROM r WHERE level * weight <= most) * weight, most)) AS target FROM r
), q AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS quota, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM t
), b AS (
  SELECT *, CAST(ceil(quota / 1024) AS BIGINT) AS blocks FROM q
), c AS (
  SELECT *, CAST(floor((sum(blocks) OVER o - blocks) / greatest(sum(blocks) OVER (), 1) * 2147483648.0::DOUBLE) AS BIGINT) AS lo,
         CAST(floor(sum(blocks) OVER o / greatest(sum(blocks) OVER (), 1) * 2147483648.0::DOUBLE) AS BIGINT) AS hi
  FROM b WINDOW o AS (ORDER BY no)
), slots AS (
  SELECT i AS slot, no, blocks, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS block
  FROM (SELECT i, (i % 2147483648) * 1327217885 % 2147483648 AS u FROM range((SELECT CAST(sum(blocks) AS BIGINT) FROM c)) x(i)) JOIN c ON lo <= u AND u < hi
), short AS (
  SELECT no, block, row_number() OVER (ORDER BY block, no) AS r
  FROM (SELECT c.no, unnest(range(CAST(coalesce(met, 0) AS BIGINT), blocks)) AS block FROM c LEFT JOIN (SELECT no, count(*) AS met FROM slots GROUP BY no) m USING (no))
), spare AS (
  SELECT slot, row_number() OVER (ORDER BY slot) AS r FROM slots WHERE block >= blocks
), plan AS (
  SELECT no, block, slot FROM slots WHERE block < blocks UNION ALL SELECT no, block, slot FROM short JOIN spare USING (r)
), p AS (
  SELECT d.rid, d.doc_id, d.size, c.source_size, c.target, c.quota, c.no,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), w AS (
  SELECT rid, no, a + n * source_size AS x, least(a + n * source_size + size, quota) AS y FROM p, (SELECT unnest([0, 1]) AS n) WHERE size > 0
), z AS (
  SELECT rid, count(*) AS n_pieces, min(slot) AS first_slot FROM (SELECT rid, no, unnest(range(x // 1024, (y - 1) // 1024 + 1)) AS block FROM w WHERE x < y) JOIN plan USING (no, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size, quota - source_size) - a) AS BIGINT) AS taken,
       first_slot, coalesce(n_pieces, 0) AS n_pieces
FROM p LEFT JOIN z USING (rid)""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT rid, doc_id, source, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, unnest(range(1, len(ls) + 1)) AS i, ls
  FROM (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS ls, NULL AS line FROM documents)
), x AS (
  SELECT rid, doc_id, source, i, ls[i] AS line, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l
), g AS (
  SELECT t FROM x WHERE length(t) >= 20 GROUP BY t HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 8
)
SELECT doc_id, count(*) AS n_lines, count(g.t) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.t IS NULL), '')) AS kept_md5
FROM x LEFT JOIN g ON x.t = g.t GROUP BY rid, doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op8_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WS}')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_full_match(x, '[!-@\\[-`{{-~]+'))) AS n_no_letters,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_cut_off
  FROM d LEFT JOIN rep USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR (n_lines >= 10 AND 100 * n_dup_lines > 60 * n_lines) OR n_distinct < 12 OR 100 * n_no_letters > 70 * n_words
            OR (n_lines >= 5 AND 100 * n_cut_off > 60 * n_lines)) AS kept
FROM b""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL) p
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)
), e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)""",
    "op11_block_dedup": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WS}') AS w FROM documents
), win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM dup, (SELECT unnest(range(35)) AS k)
), word AS (
  SELECT rid, i, w[i] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, sum(n) AS every FROM c GROUP BY lang, term HAVING sum(docs) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(every) AS total FROM k GROUP BY lang
), s AS (
  SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY c.lang, c.source
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (k.every + 5)) // (g.total + 5 * g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50""",
    "op10_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
