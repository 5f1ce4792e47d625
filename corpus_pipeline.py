"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing by source, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. What a
stage writes for itself, and each result once the next one is written, is deleted; the last result stays, as it is
what ``run`` returns.

Cases, in all stages: a null text counts as empty; null ids, languages and sources are values like others; an empty
table gives an empty result; all columns stay up to the last stage, whatever their names.

One setting of the session changes: rows meet Python in batches of 1,000, unless the session names a number itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from tidemark.llm.base import read, small_batches
from tidemark.llm.queries import tokenizer_path
from tidemark.runtime import remove, scratch, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows that are predicted as toxic. Empty texts have the score of the bias and stay; repeated rows
    are scored each; without usable labels nothing goes."""
    small_batches(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, equal but for A-Z: that of the largest doc_id. Of rows that repeat doc_id and text one
    stays; all empty texts are one text; a null doc_id is less than others."""
    return exact_dedup.dedup(docs, keep="most")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each class of similar texts: that of the least doc_id. Texts without words all stay; of rows that
    repeat doc_id and words one stays; a null doc_id is greater than others."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (up to twice), shuffled: one file for each shard, in the order of the mix.
    Texts without words are never taken; a null source is one of its own; rows that repeat doc_id, source and size are
    taken equally often."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the tokens and of the text decoded from them, for each row."""
    small_batches(spark)
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None  # a learned filter and a drawn mix aren't SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    folder, docs, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
