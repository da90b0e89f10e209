"""The pipeline over documents: five stages, each written as Parquet and read again before the next.

1. language_id: documents without a language, or whose words agree on none, go.
2. line_dedup: lines on many sites go from all documents but one.
3. near_dedup: of each group of near-duplicates, by SimHash and what its links leave apart, the document with the smallest id stays.
4. mixing: each source's documents are taken as often as its target weight asks for.
5. packing: the mixture's tokens in sequences of a fixed length.

All but the last return the columns of documents. Every stage works on all rows that it is given.

Cases: null and empty texts, and those without a letter, have no language and go in the first stage; null sources are a source of
their own in mixing and no site in line_dedup; documents that share a doc_id or have none stay apart unless their texts are near
duplicates; equal rows are one after near_dedup; very long texts pass whole; an empty table gives an empty result; further columns
of documents, whatever their names, pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import langid, lines, mixing, near, packing
from siftline.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs, langid.learned(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The language model and the tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
