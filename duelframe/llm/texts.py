"""Columns and small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.layout import c

#: The white space that separates words, as a Java and as an RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(c(key).cast("string"), F.lit(""))) % F.lit(modulus)


def whole(text: str) -> Column:
    """A text, or the empty text where it is null."""
    return F.coalesce(c(text).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def boxed(docs: DataFrame, name: str = "_doc") -> Column:
    """All columns of a row in one struct, so that no working column can clash with them."""
    return F.struct(*[c(n) for n in docs.columns]).alias(name)


def unboxed(df: DataFrame, columns: list[str], name: str = "_doc") -> DataFrame:
    return df.select([F.col(name).getField(n).alias(n) for n in columns])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int | None = None) -> Iterator[None]:
    """Hand at most ``rows`` rows, and about ``size`` bytes of them, to a Python worker at once while tables are written
    inside; the settings are put back after.

    Rows that carry shingle sets or whole texts are large, and a batch is held more than once while it is converted.
    The setting is the session's: jobs of other threads see it meanwhile, which changes their batches and not their
    results. Frames that are returned unwritten run without it.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name, most in limits.items() if most is not None}
    for name, old in before.items():
        spark.conf.set(name, str(min(limits[name], int(old)) if old.isdigit() and int(old) > 0 else limits[name]))
    try:
        yield
    finally:
        for name, old in before.items():
            spark.conf.set(name, old)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal ``keys`` in sorted batches, each as arrays by column; holds one batch and one group."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        columns = {n: pdf[n].to_numpy() for n in keys}
        if held and any(held[-1][n].iloc[-1] != v[0] for n, v in columns.items()):
            yield {n: np.concatenate([h[n].to_numpy() for h in held]) for n in pdf.columns}
            held = []
        changed = np.zeros(len(pdf) - 1, bool)
        for v in columns.values():
            changed |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(pdf)]
        if held and len(edges) > 2:
            held.append(pdf.iloc[: edges[1]])
            yield {n: np.concatenate([h[n].to_numpy() for h in held]) for n in pdf.columns}
            held, edges = [], edges[1:]
        whole_columns = {n: pdf[n].to_numpy() for n in pdf.columns}
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield {n: v[a:b] for n, v in whole_columns.items()}
        held.append(pdf.iloc[edges[-2] :])
    if held:
        yield {n: np.concatenate([h[n].to_numpy() for h in held]) for n in held[0].columns}
