"""Stratified hold-outs, folds and class weights.

Rows are ranked by ``md5(key-seed)``: a reproducible shuffle that survives
recomputation. Nothing ranks a class as a whole, and the table is not shuffled: the
hash at a wanted rank is found by counting rows per hash prefix, with longer prefixes
until a prefix is small, and rows are compared with those few cuts. A null label is a
class of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.layout import DEFAULT, c

HOLDOUT = 0.2
FOLDS = 5
SEED = 42
_DIGITS = 3  # hex digits a prefix grows by
_RANKED = 100_000  # rows of a prefix that one task may rank


def _code(key: str, seed: int) -> Column:
    return F.md5(F.concat(c(key).cast("string"), F.lit(f"-{seed}")))


def _class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class; one row per class comes to the driver."""
    return {r["_label"]: r["n"] for r in df.groupBy(c(label).alias("_label")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _codes_at(df: DataFrame, label: str, key: str, seed: int, ranks: Mapping[object, Sequence[int]], ranked: int = _RANKED) -> dict[tuple[object, int], str]:
    """The hash at each (class, 1-based rank)."""
    codes = df.select(c(label).alias("_label"), _code(key, seed).alias("_code"))
    spark, kind = df.sparkSession, df.schema[label].dataType.simpleString()
    at = {(y, r): ("", r) for y, wanted in ranks.items() for r in wanted}
    growing = set(at)

    def under(prefixes: set) -> DataFrame:
        """Rows below the prefixes; at most one prefix per wanted rank, so that side is small."""
        few = spark.createDataFrame(sorted(prefixes, key=str), f"y {kind}, prefix string")
        return codes.join(F.broadcast(few), F.col("_label").eqNullSafe(F.col("y")) & F.col("_code").startswith(F.col("prefix")))

    while growing:
        level = under({(y, at[y, r][0]) for y, r in growing})
        longer = F.expr(f"substring(_code, 1, length(prefix) + {_DIGITS})")
        sizes: dict = {}
        for row in level.groupBy("y", "prefix", longer.alias("next")).agg(F.count(F.lit(1)).alias("n")).collect():
            sizes.setdefault((row["y"], row["prefix"]), []).append((row["next"], row["n"]))
        for y, r in sorted(growing, key=str):
            prefix, left = at[y, r]
            for nearer, n in sorted(sizes[y, prefix]):
                if left <= n:
                    at[y, r] = (nearer, left)
                    if n <= ranked or len(nearer) >= 32:
                        growing.discard((y, r))
                    break
                left -= n
    if not at:
        return {}
    w = Window.partitionBy("y", "prefix").orderBy("_code")
    wanted = spark.createDataFrame([(y, p, r) for (y, p, r) in {(y, *at[y, k]) for y, k in at}], f"wy {kind}, wprefix string, wrank long")
    placed = under({(y, at[y, r][0]) for y, r in at}).withColumn("_at", F.row_number().over(w))
    same = F.col("y").eqNullSafe(F.col("wy")) & (F.col("prefix") == F.col("wprefix")) & (F.col("_at") == F.col("wrank"))
    found = {(r["y"], r["prefix"], r["_at"]): r["_code"] for r in placed.join(F.broadcast(wanted), same).select("y", "prefix", "_at", "_code").collect()}
    return {(y, r): found[(y, *at[y, r])] for y, r in at}


def _with_cuts(df: DataFrame, label: str, cuts: Mapping[object, Sequence[str]]) -> DataFrame:
    """Add ``_cuts``, the hashes of the row's class: one row per class is joined."""
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(y, list(x)) for y, x in cuts.items()], f"_label {kind}, _cuts array<string>")
    return df.join(F.broadcast(table), c(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def stratified_split(
    df: DataFrame, label: str = "target", key: str = DEFAULT.key, fraction: float = HOLDOUT, seed: int = SEED
) -> DataFrame:
    """Add ``is_holdout``, true for the first ``ceil(fraction * class size)`` hashes of each class."""
    ranks = {y: [math.ceil(fraction * n)] for y, n in _class_sizes(df, label).items() if math.ceil(fraction * n)}
    codes = _codes_at(df, label, key, seed, ranks)
    flagged = _with_cuts(df, label, {y: [codes[y, r[0]]] for y, r in ranks.items()})
    held = F.coalesce(_code(key, seed) <= F.col("_cuts")[0], F.lit(False))
    return flagged.withColumn("is_holdout", held).drop("_cuts")


def stratified_folds(
    df: DataFrame, label: str = "target", key: str = DEFAULT.key, folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold``: each class, in the order of its hashes, in ``folds`` runs whose sizes differ by one at most."""
    ranks = {y: [f * n // folds for f in range(1, folds) if f * n // folds] for y, n in _class_sizes(df, label).items()}
    skipped = {y: folds - 1 - len(r) for y, r in ranks.items()}
    codes = _codes_at(df, label, key, seed, ranks)
    # A fold that gets no row of a small class has the empty hash as its end.
    placed = _with_cuts(df, label, {y: [""] * skipped[y] + [codes[y, r] for r in wanted] for y, wanted in ranks.items()})
    # The hash is worked out once a row: inside a lambda over the cuts it would be once for each of them.
    after = [F.coalesce((F.get("_cuts", F.lit(i)) < _code(key, seed)).cast("int"), F.lit(0)) for i in range(folds - 1)]
    fold = sum(after[1:], after[0]) if after else F.lit(0)
    return placed.withColumn("fold", fold).drop("_cuts")


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class). A null label is no class."""
    known = df.filter(c(label).isNotNull())
    counts = known.groupBy(c(label).alias(label)).agg(F.count(F.lit(1)).alias("class_rows"))
    # One row per class.
    everything = Window.partitionBy()
    rows, classes = F.sum("class_rows").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(label, "class_rows", (rows / (classes * F.col("class_rows"))).alias("class_weight"))


def with_class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Add ``class_weight``; rows without a label stay, with a null weight."""
    weights = class_weights(df, label).drop("class_rows")
    return df.join(F.broadcast(weights), label, "left")
