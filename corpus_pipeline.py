"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before it wrote. All but the last return the columns of
``documents``; the last returns one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm.common import materialise, named
from cohortlab.llm.line_dedup import line_dedup
from cohortlab.llm.mixing import curriculum
from cohortlab.llm.packing import pack
from cohortlab.llm.quality_rules import quality_rules
from cohortlab.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their boilerplate lines."""
    return quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines cut; documents of which no word is left go."""
    out = line_dedup(docs).select(*named(docs.columns))
    return out.filter(out["text"].rlike(r"[^\x20\x09-\x0D]"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return one_of_each(docs, shingle=4, distance=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, in training order; a document that the mix
    takes twice is there twice."""
    return curriculum(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of power-of-two lengths: doc_id, start, length, doc_tokens, ids,
    sequence_id, offset."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_copies), ("mixing", mix), ("packing", packed)]

#: Tokens and fingerprints are not for SQL. A test holds each stage against SQL or plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
