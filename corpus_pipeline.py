"""Training-corpus pipeline: filter by quality, drop near copies, drop benchmark leaks, mix sources, write token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of `documents`, and further columns of docs with them, whatever their names.

Nulls, blank and long texts, repeated rows and empty tables (details in each operator's module): the classifier scores a null or blank text like any
other; near copies never include a document without words, and of rows with equal id and text one stays; a null or blank text leaks nothing; the mix takes
nothing of a text without words, so such documents end there; a null source is a source of its own.  The token stage keeps every row it gets.  Whole texts are
worked on throughout, and an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.llm import quality
from segflow.llm.common import fresh, remove, shared_dir, table
from segflow.llm.decontaminate import clean_documents
from segflow.llm.mixing import mixed_documents
from segflow.llm.ngramjoin import one_of_each_group
from segflow.llm.queries import tokens_read_back

LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at LEAST_SCORE or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.score(docs, model, name=score).filter(F.col(score) >= LEAST_SCORE).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-gram Jaccard of 0.8 or more)."""
    return one_of_each_group(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of the mix."""
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix in its order, read back: doc_id, start, n_tokens and ids_crc32 of every row.

    The order is that of the files, by the number in a name such as part-00012, and of their rows; a column called _metadata doesn't hide it.  A table that is
    not read from files goes by doc_id.
    """
    part, file, row = (fresh(docs, x) for x in ("part", "file", "row"))
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select("*", meta.getField("file_name").alias(file), meta.getField("row_index").alias(row))
    except AnalysisException:
        return tokens_read_back(docs)
    numbered = placed.withColumn(part, F.expr(f"try_cast(regexp_extract(`{file}`, '^part-([0-9]+)', 1) AS BIGINT)"))
    return tokens_read_back(numbered, order=(part, file, row))


STAGES = [("quality_classifier", keep_quality), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("source_mix", mix_sources), ("token_shards", write_tokens)]

#: SQL can't express the classifier, the edit matching or the tokenizer; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  The tables between the stages go to a new folder of the shared one, which is removed at the end."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(spark, folder)
