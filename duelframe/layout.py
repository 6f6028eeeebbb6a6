"""Names of the columns that make a DataFrame a two-sided contest table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

NUMERIC_TYPES = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


@dataclass(frozen=True)
class Layout:
    """One row is a bout between a red and a blue competitor.

    ``key`` must identify a bout and be of a type that can be ordered: it breaks
    ties between bouts of one date, so every ordering in the library is total.
    """

    red: str = "Red"
    blue: str = "Blue"
    entity: str = "Fighter"
    date: str = "Date"
    outcome: str = "Winner"
    key: str = "bout_id"
    red_label: str = "Red"
    blue_label: str = "Blue"

    @property
    def red_entity(self) -> str:
        return self.red + self.entity

    @property
    def blue_entity(self) -> str:
        return self.blue + self.entity

    def sides(self) -> tuple[tuple[str, str], tuple[str, str]]:
        """(outcome label, column prefix) of either side."""
        return (self.red_label, self.red), (self.blue_label, self.blue)

    def derived(self, name: str) -> str:
        """Base name of a derived per-side column: ``Red`` + ``_win_streak``, ``red_`` + ``win_streak``."""
        return name if self.red.endswith("_") else "_" + name


DEFAULT = Layout()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col(quoted(name))


def numeric_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few constant rows without a Python worker."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
