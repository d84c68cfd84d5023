"""A corpus from raw documents to packed sequences: quality, language, near copies, packing.

Every stage takes the documents its predecessor kept and returns those it keeps, with the columns of
`documents`; the last returns the pieces of the packed sequences, with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadlens.llm import langid, packing, quality, simhash
from roadlens.llm.queries import with_shared_folder
from roadlens.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the limits of their language and source."""
    return quality.good_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on the stage's own input."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 3-word shingles at 2 bits or fewer."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of at most 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality rules", quality_rules), ("language", language), ("near duplicates", near_duplicates), ("packing", pack)]

# Fingerprints (XXH64), kernel regression and byte-pair tokens have no SQL; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read by the next."""
    with_shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
