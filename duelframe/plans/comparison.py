"""Two prediction files in, their comparison out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from duelframe.layout import DEFAULT
from duelframe.operators import compare as A
from duelframe.sources.files import read_csv

SUFFIXES = ("_logreg", "_gbdt")


@dataclass(frozen=True)
class Comparison:
    """Joined predictions with ``agree`` and ``prob_diff``, the agreement, and the largest gaps."""

    rows: DataFrame
    agreement: DataFrame
    gaps: DataFrame


def compare_files(
    spark: SparkSession,
    first: str,
    second: str,
    on: Sequence[str] = (DEFAULT.red_entity, DEFAULT.blue_entity),
    suffixes: tuple[str, str] = SUFFIXES,
    top: int = A.TOP_DISAGREEMENTS,
) -> Comparison:
    """Compare two prediction CSVs on the columns ``on``; ties among the gaps go by the first of them."""
    joined = A.compare_join(read_csv(spark, first), read_csv(spark, second), on, suffixes)
    rows = A.with_agreement(joined, suffixes)
    return Comparison(rows, A.agreement_rate(rows), A.top_disagreements(rows, on[0], top))
