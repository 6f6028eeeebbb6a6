"""Cleaning: dates, the binary target, sparse columns, defaults, schema alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, StructType, TimestampNTZType, TimestampType

from duelframe.layout import DEFAULT, Layout, c
from duelframe.session import materialised

# The default share of nulls at which a column is dropped, and the
# post-outcome columns a scored bout cannot have yet, with their stand-ins.
MISSING_THRESHOLD = 0.7
SCORE_TIME_DEFAULTS: dict[str, object] = {
    "TotalFightTimeSecs": 900,
    "Finish": "No",
    "FinishDetails": "",
    "FinishRound": 3,
    "FinishRoundTime": "5:00",
    "EmptyArena": False,
}
# Formats tried, in this order, for dates that are not ISO.
DATE_FORMATS = ("M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")
# Hashes of repeated bouts (40 bytes each) that may be sent to every task.
BROADCAST_ROWS = 1_000_000
IMPORTANT_COLUMNS = ("Finish", "FinishRound", "TotalFightTimeSecs", "EmptyArena")


def parse_date(value: Column, dtype: DataType, formats: Iterable[str] = ()) -> Column:
    """Timestamp of ``value``; whatever does not parse is null."""
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return value
    attempts = [F.try_to_timestamp(value)] + [F.try_to_timestamp(value, F.lit(f)) for f in formats]
    return F.coalesce(*attempts)


def coerce_dates(df: DataFrame, date: str = DEFAULT.date, formats: Iterable[str] = ()) -> DataFrame:
    if date not in df.columns:
        return df
    return df.withColumn(date, parse_date(c(date), df.schema[date].dataType, formats))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN poisons Spark averages, so it becomes null at every source."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    if not floats:
        return df
    return df.select(
        [F.when(~F.isnan(c(n)), c(n)).alias(n) if n in floats else c(n) for n in df.columns]
    )


def create_target(df: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Keep decided bouts; ``target`` is 1 where red won."""
    if layout.outcome not in df.columns:
        raise ValueError(f"no outcome column {layout.outcome!r}")
    outcome = c(layout.outcome)
    decided = df.filter(outcome.isin(layout.red_label, layout.blue_label))
    return decided.withColumn("target", (outcome == layout.red_label).cast("int"))


def missing_ratios(df: DataFrame) -> DataFrame:
    """One row per column, ``(column_name, missing_ratio)``, from a single pass over the table."""
    ratios = df.agg(*[F.avg(c(n).isNull().cast("double")).alias(n) for n in df.columns])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), c(n).alias("missing_ratio")) for n in df.columns])
    return ratios.select(F.inline(pairs))


def sparse_columns(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> list[str]:
    """Columns whose null share reaches ``threshold``; all of them when the table is empty."""
    row = df.agg(*[F.avg(c(n).isNull().cast("double")).alias(n) for n in df.columns]).first()
    return [n for n in df.columns if row[n] is None or row[n] >= threshold]


def drop_high_missing(
    df: DataFrame, threshold: float = MISSING_THRESHOLD, keep: Iterable[str] = ()
) -> DataFrame:
    """Drop sparse columns, except those named in ``keep``."""
    doomed = set(sparse_columns(df, threshold)) - set(keep)
    return df.select([c(n) for n in df.columns if n not in doomed])


def with_defaults(df: DataFrame, defaults: Mapping[str, object] = SCORE_TIME_DEFAULTS) -> DataFrame:
    """Add each default whose column is absent; nulls in present columns stay."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; absent ones are null."""
    present = set(df.columns)
    return df.select(
        [
            (c(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def check_width(found: int, expected: int) -> None:
    if found != expected:
        raise ValueError(f"model expects {expected} features, got {found}")


def clean(
    df: DataFrame,
    layout: Layout = DEFAULT,
    threshold: float = MISSING_THRESHOLD,
    keep: Iterable[str] = (),
    require_outcome: bool = True,
    formats: Iterable[str] = DATE_FORMATS,
) -> DataFrame:
    """Dates, target, sparse columns.

    Texts are read as ISO dates or by ``formats``; ``unparsed_dates`` counts those that fit none.
    ``require_outcome=False`` is for upcoming bouts: they keep all rows and get
    no target instead of passing under a made-up winner.
    """
    dated = nan_to_null(coerce_dates(df, layout.date, formats))
    if require_outcome:
        return drop_high_missing(create_target(dated, layout), threshold, keep)
    identity = [layout.key, layout.date, layout.outcome, layout.red_entity, layout.blue_entity]
    return drop_high_missing(dated, threshold, [*keep, *identity])


def unparsed_dates(df: DataFrame, date: str = DEFAULT.date, formats: Iterable[str] = DATE_FORMATS) -> DataFrame:
    """One row: ``n_dates`` given and ``n_unparsed`` of them that no format fits."""
    parsed = parse_date(c(date), df.schema[date].dataType, formats)
    return df.agg(F.count(c(date)).alias("n_dates"), F.count_if(c(date).isNotNull() & parsed.isNull()).alias("n_unparsed"))


def with_bout_key(
    df: DataFrame, layout: Layout = DEFAULT, columns: Iterable[str] | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add a text key: 128-bit hash of the columns that identify a bout.

    Where several rows share it, a hash of the whole row follows and the place among rows
    equal in every column, so a row has the same key however the table is partitioned.
    Nulls are marked and lengths written, so no two different bouts share a text before
    hashing. The hashes are shuffled, and rows whose hash repeats; the others stay where they
    are unless more than ``broadcast_rows`` hashes repeat. ``df`` is read three times.
    """
    names = list(columns or (layout.date, layout.red_entity, layout.blue_entity))
    kept = [n for n in df.columns if n != layout.key]
    marked = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c(n).cast("string") for n in names)]
    coded = df.select(F.md5(F.concat_ws(",", *marked)).alias("_code"), F.struct(*[c(n) for n in kept]).alias("_row"))
    shared = materialised(coded.groupBy("_code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_code"))
    few = shared.count() <= broadcast_rows
    listed = F.broadcast(shared) if few else shared
    single = coded.join(listed, "_code", "left_anti").select("_row", F.col("_code").alias("_key"))
    repeats = coded.join(listed, "_code", "left_semi")
    repeats = repeats.withColumn("_same", F.md5(F.to_json("_row", {"ignoreNullFields": "false"})))
    keyed = single.unionByName(_numbered(repeats.select("_row", F.concat_ws("-", "_code", "_same").alias("_key"))))
    return keyed.select(*[F.col("_row").getField(n).alias(n) for n in kept], F.col("_key").alias(layout.key))


def _numbered(rows: DataFrame) -> DataFrame:
    """``_key`` followed by the place among rows of that key, which are equal in every column.

    The rows are stored with the task that wrote them. Each task's rows of a key are numbered apart
    and start where those of earlier tasks end, so that no key is put in order by one task.
    """
    stored = materialised(rows.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    counts = stored.groupBy("_key", "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_place"))
    number = (F.col("_start") + F.col("_own") - 1).cast("string")
    placed = stored.withColumn("_own", own).join(starts, ["_key", "_task"])
    return placed.select("_row", F.concat_ws("-", "_key", F.lpad(number, 19, "0")).alias("_key"))
