"""A training corpus from documents, stage by stage; each stage is read back from Parquet by the next.

Defined cases: rows without a doc_id and rows that share one are judged, kept and taken row by row; a text that is null or
has no letter has no language and goes; very long texts are handled whole; of equal texts the row with the smallest doc_id
stays; columns beside those of documents are carried, whatever their names, up to the last stage; an empty table gives
an empty result.

What a stage returns is read from tables that it wrote for itself, so write it before the next stage; these tables are deleted
once the returned DataFrame is gone. ``run`` returns a table of its own, which no later run deletes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from feedscope.llm import decontam, language_id, ngram_join, source_mix, token_shards
from feedscope.llm.common import drop_with, drop_written, load, materialise, written, written_since
from feedscope.llm.queries import tokenizer_path


def stage(work: Callable) -> Callable:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        start = written()
        out = work(spark, docs, sf_dir)
        return drop_with(out, written_since(start))

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language."""
    return language_id.in_known_language(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones."""
    return ngram_join.distinct_documents(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents so that sources meet their target weights; a document may come twice."""
    return source_mix.mix(docs)


@stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token shards; a row for each document stored."""
    return token_shards.shard_digest(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mixing),
    ("token_output", token_output),
]

#: The stages' classifier, MinHash join and tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = load(spark, sf_dir, "documents"), []
    for name, work in STAGES:
        found = work(spark, docs, sf_dir)
        start = written()
        docs = materialise(found, name)
        drop_written(spark, own)  # the stage's input: what came out of it is written
        own = written_since(start)
        del found
    return docs
