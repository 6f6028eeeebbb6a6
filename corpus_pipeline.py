"""Training-corpus pipeline: raw documents to packed sequences, in five stages.

Every stage works on all rows its predecessor kept, and is written as Parquet in the
shared folder before the next one reads it. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import jaccard, packing, quality, suffixes, toxicity
from duelframe.llm.queries import toxicity_model
from duelframe.llm.texts import documents, table
from duelframe.session import discard, materialised

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy of the rule ledger."""
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of held-out documents are not learned from."""
    return toxicity.keep_civil(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the least id."""
    return jaccard.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that also occur elsewhere; ``n_chars`` is counted anew."""
    return suffixes.drop_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]

#: Tokens and fitted scores cannot be expressed in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the ``documents`` of ``sf_dir``."""
    given = docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        done = materialised(stage(spark, docs, sf_dir))
        if docs is not given:
            discard(docs)  # the next table is written and reads nothing of this one
        docs = done
    return docs
