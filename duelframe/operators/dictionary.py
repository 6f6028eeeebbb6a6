"""One-hot encoding of text columns with any number of values: the vocabulary stays a table.

Values are sorted by range partitions and numbered there; a row finds the slots of its
values by joins, and a sparse vector is put together from the slots. Nothing that grows
with the vocabulary is collected.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from duelframe.layout import c
from duelframe.operators.clean import align_schema, check_width
from duelframe.operators.drift import category_counts
from duelframe.operators.logistic import DENSE_WIDTH
from duelframe.session import discard, materialised

#: A value that more than one row in this many has is looked up in a broadcast table; a column has fewer of them than that.
HOT_SHARE = 1_000

_ORDER = ("column_name", "value")


def slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, value, n, slot``: the values of all columns, numbered from 0 by column and value; a stored table."""
    counts = materialised(category_counts(df, columns))
    ranged = counts.repartitionByRange(*_ORDER).withColumn("_part", F.spark_partition_id())
    stored = materialised(ranged)
    # One row for each partition is put in order here.
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*_ORDER))
    numbered = stored.withColumn("_own", own).join(starts, "_part")
    out = materialised(numbered.select(*_ORDER, "n", (F.col("_start") + F.col("_own") - 1).cast("int").alias("slot")))
    discard(counts, stored)
    return out


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """Vector column from ascending indices and their values, without a Python worker."""
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    kind = StructType([StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), kind)["v"]


@dataclass(frozen=True)
class DictionaryPreprocessor:
    """Median and scale for numeric columns, most frequent and one-hot for text columns, without a bound on their values.

    ``numbers`` gives median, shift and scale by numeric column, ``modes`` and ``sizes`` the
    most frequent value and the number of values by text column; ``dictionary`` is the table of ``slots``.
    """

    numbers: Mapping[str, tuple[float, float, float]]
    modes: Mapping[str, str]
    sizes: Mapping[str, int]
    rows: int
    schema: StructType
    dropped: list[str]
    dictionary: DataFrame

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(self.sizes.values())

    @property
    def names(self) -> list[str]:
        """Names of all feature slots, collected: for vocabularies that fit the driver. ``feature_names`` is the table."""
        return [r["name"] for r in self.feature_names().orderBy("slot").collect()]

    def feature_names(self) -> DataFrame:
        """``slot, name`` of every feature."""
        spark, k = self.dictionary.sparkSession, len(self.numbers)
        listed = F.array(*[F.lit(n) for n in self.numbers]).cast("array<string>")
        first = spark.range(1).select(F.posexplode(listed).alias("slot", "name"))
        return first.unionByName(self.dictionary.select((F.col("slot") + k).alias("slot"), F.concat_ws("=", *_ORDER).alias("name")))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``. Missing training columns count as null; other columns pass through; unknown values have no slot."""
        extra = [n for n in df.columns if n not in self.schema.names]
        aligned = align_schema(df, StructType([*self.schema.fields, *[df.schema[n] for n in extra]]))
        numbers = [(F.coalesce(c(n).cast("double"), F.lit(m)) - F.lit(shift)) / F.lit(scale) for n, (m, shift, scale) in self.numbers.items()]
        texts = [F.coalesce(c(n), F.lit(mode)).alias(f"_t{i}") for i, (n, mode) in enumerate(self.modes.items())]
        box = F.struct(*[c(n) for n in aligned.columns]).alias("_row")
        out = aligned.select(box, F.array(*numbers).cast("array<double>").alias("_numbers"), *texts)
        for i, n in enumerate(self.modes):
            out = self._with_slot(out, n, F.col(f"_t{i}"), f"_s{i}")
        k = len(self.numbers)
        if self.width <= DENSE_WIDTH:
            vector = array_to_vector(F.array(*numbers, *self._indicators())).alias("features")
            return out.select(*[F.col("_row").getField(n).alias(n) for n in aligned.columns], vector)
        found = F.array_compact(F.array(*[F.col(f"_s{i}") + k for i in range(len(self.modes))]).cast("array<int>"))
        indices = F.concat(F.array(*[F.lit(i) for i in range(k)]).cast("array<int>"), found)
        values = F.concat(F.col("_numbers"), F.transform(found, lambda _: F.lit(1.0)))
        vector = sparse_vector(self.width, indices, values).alias("features")
        return out.select(*[F.col("_row").getField(n).alias(n) for n in aligned.columns], vector)

    def _indicators(self) -> list[Column]:
        """1 in the slot of each value a row has and 0 in all others, in the order of the slots."""
        place = {n: f"_s{i}" for i, n in enumerate(self.modes)}
        start, out = 0, []
        for n in sorted(self.modes):
            out += [F.coalesce(F.col(place[n]) == j, F.lit(False)).cast("double") for j in range(start, start + self.sizes[n])]
            start += self.sizes[n]
        return out

    def _with_slot(self, rows: DataFrame, name: str, value: Column, out: str) -> DataFrame:
        own = self.dictionary.where(F.col("column_name") == name)
        frequent = F.col("n") * HOT_SHARE > self.rows
        if self.sizes[name] <= HOT_SHARE:
            frequent = F.lit(True)
        hot = F.broadcast(own.where(frequent).select(F.col("value").alias("_v"), F.col("slot").alias(out)))
        rows = rows.join(hot, value == F.col("_v"), "left").drop("_v")
        if self.sizes[name] <= HOT_SHARE:
            return rows
        # Rows that have their slot are dealt out evenly; only the others are shuffled by value.
        rows = rows.withColumn("_deal", F.when(F.col(out).isNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
        rest = own.where(~frequent).select(F.col("value").alias("_v"), F.col("slot").alias("_slot"), F.lit(0).cast("long").alias("_none"))
        joined = rows.join(rest, (value == F.col("_v")) & (F.col("_deal") == F.col("_none")), "left")
        return joined.withColumn(out, F.coalesce(F.col(out), F.col("_slot"))).drop("_v", "_slot", "_none", "_deal")

    def check(self, num_features: int) -> None:
        check_width(self.width, num_features)

    def discard(self) -> None:
        """Delete the dictionary's table; the preprocessor is of no use afterwards."""
        discard(self.dictionary)

    def save(self, path: str, spark: SparkSession) -> None:
        fitted = json.dumps({"numbers": self.numbers, "modes": self.modes, "sizes": self.sizes, "rows": self.rows, "dropped": self.dropped})
        spark.createDataFrame([(self.schema.json(), fitted)], "schema string, fitted string").write.mode("overwrite").parquet(f"{path}/meta")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")

    @staticmethod
    def load(path: str, spark: SparkSession) -> DictionaryPreprocessor:
        row = spark.read.parquet(f"{path}/meta").first()
        fitted = json.loads(row["fitted"])
        numbers = {n: tuple(v) for n, v in fitted["numbers"].items()}
        schema = StructType.fromJson(json.loads(row["schema"]))
        table = spark.read.parquet(f"{path}/dictionary")
        return DictionaryPreprocessor(numbers, fitted["modes"], fitted["sizes"], fitted["rows"], schema, fitted["dropped"], table)


def fit_dictionary(df: DataFrame, text: list[str]) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """The table of ``slots``, and by text column that has a value its most frequent one (the smallest on a tie) and its number of values."""
    table = slots(df, text)
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))["value"]
    found = {r["column_name"]: r for r in table.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).collect()}
    kept = [n for n in text if n in found]
    return table, {n: found[n]["top"] for n in kept}, {n: found[n]["n"] for n in kept}
