"""Preprocessing fitted on training rows and applied anywhere.

Fitting needs exact medians, modes, moments and vocabularies; all of them come
from distributed aggregations. The fitted steps are built-in Spark ML stages, so
the result is an ordinary ``PipelineModel``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from duelframe.layout import c, numeric_columns, quoted, string_columns
from duelframe.operators.clean import align_schema, check_width
from duelframe.operators.dictionary import DictionaryPreprocessor, fit_dictionary
from duelframe.operators.drift import category_counts

# Fixed value: a text column with more distinct values than this is left out.
MAX_CATEGORIES = 20

# Rows of the bracket around a median that one task may sort, and the accuracy of the bracket.
_SORTED_ROWS = 100_000
_ACCURACY = 10_000


# --------------------------------------------------------------------------- medians


def _rank_values(df: DataFrame, picks: Mapping[str, tuple[float | None, float | None, int, int]]) -> dict:
    """Exact values at two ranks inside the open interval ``(lo, hi)`` of each column; small intervals only.

    Every column is sorted in a group of its own, so no task holds two of them.
    """
    cells = []
    for i, (name, (lo, hi, _, _)) in enumerate(picks.items()):
        x = c(name).cast("double")
        inside = x.isNotNull() if lo is None else (x > lo) & (x < hi)
        cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), x.alias("x"))))
    tall = df.select(F.explode(F.array_compact(F.array(*cells))).alias("v")).select("v.*")
    values = tall.groupBy("i").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    at = F.create_map(*[F.lit(v) for i, p in enumerate(picks.values()) for v in (i, F.array(F.lit(p[2] + 1), F.lit(p[3] + 1)))])
    rows = values.select("i", *[F.element_at("xs", at[F.col("i")][k]).alias(n) for k, n in enumerate("ab")]).collect()
    names = list(picks)
    return {names[r["i"]]: (r["a"], r["b"]) for r in rows}


def exact_medians(
    df: DataFrame, columns: Sequence[str], sorted_rows: int = _SORTED_ROWS, sizes: Mapping[str, int] | None = None
) -> dict[str, float | None]:
    """Median per column, the mean of the middle two for an even count; null for an all-null column.

    ``F.median`` keeps every distinct value of a column in one task. Here an
    approximate quantile sketch brackets the middle ranks, counts confirm the
    bracket, and it is narrowed until few enough rows are left to sort. Each
    round keeps under a thousandth of the rows, and repeated values at either end
    of a bracket are resolved by counting, so a few passes over the table suffice.
    ``sizes`` spares the pass that counts non-null values when they are known.
    """
    columns = list(columns)
    if not columns:
        return {}
    if sizes is None:
        counts = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(columns)]).first()
        sizes = {n: counts[f"n{i}"] for i, n in enumerate(columns)}
    medians: dict[str, float | None] = {n: None for n in columns if not sizes[n]}
    small, wide = {}, {}
    for n in columns:
        if size := sizes[n]:
            state = (None, None, (size - 1) // 2, size // 2)
            (small if size <= sorted_rows else wide)[n] = state
    # ``wide``: open interval (None = everything), ranks inside it, rows inside it.
    wide = {n: (*s, sizes[n]) for n, s in wide.items()}
    while wide:
        wide, found, narrow = _narrow(df, wide, sorted_rows)
        medians |= found
        small |= narrow
    if small:
        medians |= {n: (a + b) / 2 for n, (a, b) in _rank_values(df, small).items()}
    return {n: medians[n] for n in columns}


def _narrow(df: DataFrame, wide: Mapping[str, tuple], sorted_rows: int):
    """One round: sketch a closer bracket inside each open interval, count it, resolve its ends."""
    margin = 2.0 / _ACCURACY
    names = list(wide)
    sketches = []
    for i, n in enumerate(names):
        lo, hi, r1, r2, rows = wide[n]
        x = c(n).cast("double")
        inside = x if lo is None else F.when((x > lo) & (x < hi), x)
        at = [max(0.0, r1 / rows - margin), min(1.0, r2 / rows + margin)]
        sketches.append(F.percentile_approx(inside, at, _ACCURACY).alias(f"q{i}"))
        sketches.append(F.min(inside).alias(f"min{i}"))
        sketches.append(F.max(inside).alias(f"max{i}"))
    sketch = df.agg(*sketches).first()
    brackets, exprs = {}, []
    for i, n in enumerate(names):
        low, high = sketch[f"q{i}"]
        brackets[n] = (low, high)
        lo, hi = wide[n][:2]
        x = c(n).cast("double")
        base = F.lit(True) if lo is None else (x > lo) & (x < hi)
        exprs += [
            F.count_if(base & (x < low)).alias(f"below{i}"),
            F.count_if(x == low).alias(f"low{i}"),
            F.count_if(x == high).alias(f"high{i}"),
            F.count_if((x > low) & (x < high)).alias(f"mid{i}"),
        ]
    row = df.agg(*exprs).first()
    again, found, narrow = {}, {}, {}
    for i, n in enumerate(names):
        low, high = brackets[n]
        lo, hi, r1, r2, rows = wide[n]
        below, at_low, mid = row[f"below{i}"], row[f"low{i}"], row[f"mid{i}"]
        at_high = row[f"high{i}"] if high > low else 0
        end = below + at_low + mid + at_high
        if r1 < below or r2 >= end:
            # The sketch missed (its error is bounded, so this is a guard): keep the outer interval's end.
            low, high = (sketch[f"min{i}"] if r1 < below else low), (sketch[f"max{i}"] if r2 >= end else high)
            check = df.agg(
                F.count_if((c(n) < low)).alias("below"), F.count_if(c(n) == low).alias("low"),
                F.count_if(c(n) == high).alias("high"), F.count_if((c(n) > low) & (c(n) < high)).alias("mid"),
                F.count_if(c(n) <= lo).alias("outside") if lo is not None else F.lit(0).alias("outside"),
            ).first()
            below, at_low, mid = check["below"] - check["outside"], check["low"], check["mid"]
            at_high = check["high"] if high > low else 0
            end = below + at_low + mid + at_high
        values = [low if r < below + at_low else high if r >= below + at_low + mid else None for r in (r1, r2)]
        if None not in values:
            found[n] = sum(values) / 2
            continue
        if values[0] is not None or values[1] is not None:
            # One rank is an end of the bracket, the other the value next to it.
            x = c(n).cast("double")
            between = F.when((x > low) & (x < high), x)
            ends = df.agg(F.min(between).alias("first"), F.max(between).alias("last")).first()
            a = values[0] if values[0] is not None else ends["last"]
            b = values[1] if values[1] is not None else ends["first"]
            found[n] = (a + b) / 2
            continue
        r1, r2 = r1 - below - at_low, r2 - below - at_low
        if mid <= sorted_rows:
            narrow[n] = (low, high, r1, r2)
        else:
            again[n] = (low, high, r1, r2, mid)
    return again, found, narrow


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the column median; all-null columns are dropped."""
    medians = exact_medians(df, columns)
    dead = [n for n in columns if medians[n] is None]
    return df.withColumns(
        {n: F.coalesce(c(n).cast("double"), F.lit(m)) for n, m in medians.items() if m is not None}
    ).drop(*dead)


# --------------------------------------------------------------------------- modes, vocabularies, scales


def category_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, n_distinct, top`` of each text column that has a value; the smallest value wins a tie."""
    return category_counts(df, columns).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))["value"].alias("top"),
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per text column, the smallest on a tie."""
    if not columns:
        return {}
    found = {r["column_name"]: r["top"] for r in category_summary(df, columns).collect()}
    return {n: found.get(n) for n in columns}


def impute_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = most_frequent(df, columns)
    dead = [n for n in columns if modes[n] is None]
    return df.withColumns({n: F.coalesce(c(n), F.lit(m)) for n, m in modes.items() if m is not None}).drop(*dead)


def category_sizes(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> DataFrame:
    """``column_name, n_distinct, kept`` for the cardinality filter, of columns that have a value.

    Two 64-bit hashes stand for a value, so long texts of columns that do not pass are never shuffled.
    """
    cells = [F.struct(F.lit(n).alias("column_name"), c(n).isNotNull().alias("there"), F.xxhash64(c(n)).alias("a"), F.xxhash64(F.lit(1), c(n)).alias("b")) for n in columns]
    seen = df.select(F.inline(F.array(*cells))).filter("there").groupBy("column_name", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    sizes = seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return sizes.withColumn("kept", F.col("n_distinct") <= limit)


def vocabularies(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """Sorted distinct values per text column; refused above ``limit`` in total. ``dictionary.slots`` has no limit."""
    if not columns:
        return {}
    rows = category_counts(df, columns).select("column_name", "value").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; use dictionary.slots")
    out: dict[str, list[str]] = {n: [] for n in columns}
    for r in rows:
        out[r["column_name"]].append(r["value"])
    return {n: sorted(v) for n, v in out.items()}


@dataclass(frozen=True)
class Moments:
    """Rows, non-null values, their mean and population variance."""

    rows: int
    values: int
    mean: float | None
    variance: float | None

    def scaling(self, center: bool = True, fill: float | None = None) -> tuple[float, float]:
        """``(shift, scale)``, with the missing rows counted as ``fill``; a constant column keeps scale 1."""
        mean, variance = self.mean, self.variance
        if fill is not None and self.rows > self.values:
            # Pooling the values with a constant block of the missing rows.
            share = self.values / self.rows
            mean = share * self.mean + (1 - share) * fill
            variance = share * self.variance + share * (1 - share) * (self.mean - fill) ** 2
        return (mean if center else 0.0, math.sqrt(variance) or 1.0)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """All columns in one pass."""
    if not columns:
        return {}
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(columns):
        x = c(n).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(*exprs).first()
    return {n: Moments(row["rows"], row[f"n{i}"], row[f"m{i}"], row[f"v{i}"]) for i, n in enumerate(columns)}


def standardise(df: DataFrame, columns: Sequence[str], center: bool = True) -> DataFrame:
    scales = {n: m.scaling(center) for n, m in moments(df, columns).items() if m.values}
    return df.withColumns({n: (c(n) - F.lit(m)) / F.lit(s) for n, (m, s) in scales.items()})


# --------------------------------------------------------------------------- the fitted preprocessor


@dataclass(frozen=True)
class Preprocessor:
    """Fitted stages, the input schema they were fitted on, and the names of the feature slots."""

    model: PipelineModel
    schema: StructType
    names: list[str]
    dropped: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``. Missing training columns count as null; other columns pass through."""
        extra = [n for n in df.columns if n not in self.schema.names]
        aligned = align_schema(df, StructType([*self.schema.fields, *[df.schema[n] for n in extra]]))
        out = self.model.transform(aligned)
        return out.drop(*[n for n in out.columns if n.startswith("_f_")])

    def check(self, num_features: int) -> None:
        check_width(len(self.names), num_features)

    def discard(self) -> None:
        """Nothing is stored outside the driver."""

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/stages")
        meta = [(self.schema.json(), self.names, self.dropped)]
        spark.createDataFrame(meta, "schema string, names array<string>, dropped array<string>").write.mode(
            "overwrite"
        ).parquet(f"{path}/meta")

    @staticmethod
    def load(path: str, spark: SparkSession) -> Preprocessor | DictionaryPreprocessor:
        """What ``save`` of either preprocessor wrote."""
        row = spark.read.parquet(f"{path}/meta").first()
        if "fitted" in row:
            return DictionaryPreprocessor.load(path, spark)
        schema = StructType.fromJson(json.loads(row["schema"]))
        return Preprocessor(PipelineModel.load(f"{path}/stages"), schema, list(row["names"]), list(row["dropped"]))


def fit_preprocessor(
    df: DataFrame,
    label: str = "target",
    exclude: Sequence[str] = ("Winner",),
    max_categories: int | None = MAX_CATEGORIES,
    center: bool = True,
) -> Preprocessor | DictionaryPreprocessor:
    """Median and scale for numeric columns, most frequent and one-hot for text columns.

    Everything else (booleans, dates, ``exclude``) is left out of the features.
    Unknown categories encode as all zeros. ``max_categories=None`` keeps text columns
    of any number of values, whose vocabulary then stays a table; ``center=False`` only divides.
    """
    if label not in df.columns:
        raise KeyError(f"no label column {label!r}")
    skip = {label, *exclude}
    numeric = [n for n in numeric_columns(df) if n not in skip]
    text = sorted(n for n in string_columns(df) if n not in skip)
    spread = moments(df, numeric)
    medians = exact_medians(df, numeric, sizes={n: m.values for n, m in spread.items()})
    if text and max_categories is None:
        table, modes, sizes = fit_dictionary(df, text)
        kept = [n for n in numeric if medians[n] is not None]
        numbers = {n: (medians[n], *spread[n].scaling(center, fill=medians[n])) for n in kept}
        dropped = [n for n in [*numeric, *text] if n not in numbers and n not in modes]
        rows = spread[kept[0]].rows if kept else df.count()
        schema = StructType([df.schema[n] for n in [*numbers, *modes]])
        return DictionaryPreprocessor(numbers, modes, sizes, rows, schema, dropped, table)
    narrow = [r["column_name"] for r in category_sizes(df, text, max_categories).filter("kept").collect()] if text else []
    # One pass over the columns that stay gives their modes and vocabularies, of bounded size, which become part of the model.
    counted: dict[str, dict[str, int]] = {}
    for r in category_counts(df, narrow).collect() if narrow else []:
        counted.setdefault(r["column_name"], {})[r["value"]] = r["n"]
    dropped = [n for n in numeric if medians[n] is None] + [n for n in text if n not in counted]
    numeric = [n for n in numeric if n not in dropped]
    text = [n for n in text if n not in dropped]
    words = {n: sorted(counted[n]) for n in text}
    modes = {n: min(words[n], key=lambda v: (-counted[n][v], v)) for n in text}
    scales = {n: spread[n].scaling(center, fill=medians[n]) for n in numeric}

    def literal(value: float) -> str:
        return f"CAST('{value!r}' AS DOUBLE)"

    def text_literal(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    scaled = [f"_f_n{i}" for i in range(len(numeric))]
    filled = [f"_f_t{i}" for i in range(len(text))]
    exprs = [
        f"(coalesce(CAST({quoted(n)} AS DOUBLE), {literal(medians[n])}) - {literal(scales[n][0])})"
        f" / {literal(scales[n][1])} AS {out}"
        for n, out in zip(numeric, scaled)
    ] + [f"concat('=', coalesce({quoted(n)}, {text_literal(modes[n])})) AS {out}" for n, out in zip(text, filled)]
    stages = [SQLTransformer(statement=f"SELECT *{''.join(', ' + e for e in exprs)} FROM __THIS__")]
    if text:
        indexed = [f"_f_i{i}" for i in range(len(text))]
        encoded = [f"_f_o{i}" for i in range(len(text))]
        # One indexer per column: vocabularies differ in length. Labels begin with a sign, as the encoder refuses empty ones.
        indexers = PipelineModel(
            [
                StringIndexerModel.from_labels([f"={w}" for w in words[n]], inputCol=f, outputCol=i, handleInvalid="keep")
                for n, f, i in zip(text, filled, indexed)
            ]
        )
        # The unknown slot comes last and is the one dropped.
        encoder = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True)
        probe = indexers.transform(stages[0].transform(df.limit(0)))
        stages += [indexers, encoder.fit(probe)]
    else:
        encoded = []
    stages.append(VectorAssembler(inputCols=[*scaled, *encoded], outputCol="features"))
    names = [*numeric, *[f"{n}={v}" for n in text for v in words[n]]]
    schema = StructType([df.schema[n] for n in [*numeric, *text]])
    return Preprocessor(PipelineModel(stages), schema, names, dropped)
