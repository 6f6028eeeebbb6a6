"""CSV in and out, and the profile cache."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelframe.layout import c
from duelframe.operators.clean import nan_to_null
from duelframe.session import materialised

# Cell texts that mean "missing", and those that mean true or false.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")

#: Files that a filter may name.
LISTED_FILES = 1_000


def _missing_path(err: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (err.getCondition() or "")


#: What counts as a number: casts also accept letters after the digits, as in 5D or 1f.
_NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|infinity|Infinity)\s*$"


#: Cells without a point that a cast to long accepts look like this; a cast that fails costs an exception, cell by cell.
_DIGITS = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"


def infer_types(df: DataFrame) -> DataFrame:
    """Type all-text columns from one pass: long, double, boolean, else text.

    Missing-value texts become null first. A column without any value is double.
    """
    blanked = df.select([F.when(~c(n).isin(*MISSING_TEXTS), c(n)).alias(n) for n in df.columns])
    # Cells as rows: five counts in all, not five for each column, which make code too long to be compiled.
    x = F.col("_cell")
    cells = df.select(F.posexplode(F.array(*[c(n) for n in df.columns])).alias("_at", "_cell"))
    counts = cells.filter(x.isNotNull() & ~x.isin(*MISSING_TEXTS)).groupBy("_at").agg(
        F.count(x).alias("n"),
        F.count(F.when(x.rlike(_DIGITS), x.try_cast("long"))).alias("l"),
        F.count(F.when(x.rlike(_NUMBER), x.try_cast("double"))).alias("d"),
        F.count_if(x.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias("b"),
        F.count_if(x.contains(".")).alias("p"),
    )
    found = {r["_at"]: r for r in counts.collect()}  # a row for each column
    seen = {f"{k}{i}": found[i][k] if i in found else 0 for i in range(len(df.columns)) for k in "nldbp"}
    out = []
    for i, n in enumerate(df.columns):
        x, total = c(n), seen[f"n{i}"]
        if total and seen[f"l{i}"] == total and not seen[f"p{i}"]:
            x = x.try_cast("long")
        elif seen[f"d{i}"] == total:
            x = x.try_cast("double")
        elif seen[f"b{i}"] == total:
            x = x.isin(*TRUE_TEXTS)
        out.append(x.alias(n))
    return blanked.select(out)


def _scan(spark: SparkSession, path, schema: StructType | None, encoding: str, multi_line: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", encoding)
    )
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def _plain_path(spark: SparkSession, file: str) -> str:
    """A path as readers take it, of a file name that Spark gives as an URI."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).toString()


def read_plain_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    allow_empty: bool = True,
) -> DataFrame:
    """CSV with a header. A missing path raises FileNotFoundError, an unwanted empty table ValueError."""
    try:
        df = _scan(spark, path, schema, encoding, multi_line)
    except AnalysisException as err:
        if _missing_path(err):
            raise FileNotFoundError(str(path)) from err
        raise
    df = nan_to_null(df if schema is not None else infer_types(df))
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | None = None, multi_line: bool = False, listed: int = LISTED_FILES
) -> DataFrame:
    """CSV whose files are UTF-8 or, failing that, Latin-1; decided per file from its bytes.

    Executors find the files that are not UTF-8. Up to ``listed`` of them are named in a filter on the
    file, which prunes both scans; beyond that the scans are joined with their table, each reading all
    files. The other files are never listed. Files of one encoding share the header of one of them.
    """
    file = F.col("_metadata.file_path")
    try:
        raw = spark.read.text(path)
    except AnalysisException as err:
        if _missing_path(err):
            raise FileNotFoundError(str(path)) from err
        raise
    broken = raw.filter(~F.is_valid_utf8("value")).select(file.alias("_file")).distinct()
    names = [r["_file"] for r in broken.limit(listed + 1).collect()]
    if not names:
        if raw.isEmpty():
            raise ValueError(f"no rows in {path}")
        df = _scan(spark, path, schema, "UTF-8", multi_line)
        return nan_to_null(df if schema is not None else infer_types(df))
    warnings.warn(f"{len(names) if len(names) <= listed else f'more than {listed}'} file(s) are not UTF-8; reading them as Latin-1")
    few = len(names) <= listed
    if not few:
        broken = materialised(broken)
    own = raw.select("value", file.alias("_file"))
    sound = (own.filter(~F.col("_file").isin(names)) if few else own.join(broken, "_file", "left_anti")).select("_file").first()
    parts = []
    for sample, encoding, how in ((sound and sound["_file"], "UTF-8", "left_anti"), (names[0], "ISO-8859-1", "left_semi")):
        if sample is None:
            continue
        header = _scan(spark, _plain_path(spark, sample), None, encoding, multi_line).columns
        shape = schema or StructType([StructField(n, StringType()) for n in header])
        if few:
            inside = file.isin(names)
            parts.append(_scan(spark, path, shape, encoding, multi_line).filter(inside if how == "left_semi" else ~inside))
        else:
            # Every scan sees the other files' headers too, so they are not compared.
            every = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("encoding", encoding)
            scan = every.schema(shape).csv(path).select("*", file.alias("_file"))
            parts.append(scan.join(broken, "_file", how).drop("_file"))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return nan_to_null(df if schema is not None else infer_types(df))


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force_rebuild: bool = False
) -> DataFrame:
    """Parquet cache of a derived table: built when absent, forced or unreadable."""
    if not force_rebuild:
        try:
            return spark.read.parquet(path)
        except Exception as err:
            absent = isinstance(err, AnalysisException) and _missing_path(err)
            if not absent:
                warnings.warn(f"cache {path} is unreadable, rebuilding: {err}")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", key: str | None = None) -> None:
    """Predictions, most confident first, as CSV with a header or as Parquet."""
    order = [F.desc("confidence")] + ([c(key)] if key else [])
    writer = df.orderBy(*order).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', not {fmt!r}")
