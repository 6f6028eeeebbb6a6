"""The given tables shaped as two-sided contests (see FIXTURES.md).

The lines of an order are numbered under a total order and paired 1-2, 3-4, ...;
the competitors are the two suppliers. ``bout_id`` = order key * 1000 + line, so
an order holds fewer than 1000 lines and its window group is small by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duelframe.functions import r6
from duelframe.layout import Layout
from duelframe.operators.history import spread

LAYOUT = Layout(
    red="red_", blue="blue_", entity="id", date="bout_date", outcome="winner", key="bout_id"
)
STATS = ("disc", "qty", "tax")
UPCOMING_FROM = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bouts(spark: SparkSession, sf_dir: str, same: bool = False) -> DataFrame:
    """``same`` also keeps pairs of one supplier with itself."""
    lines = table(spark, sf_dir, "lineitem")
    lines = spread(lines, lines.count(), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    names = {"id": "l_suppkey", "price": "l_extendedprice", "qty": "l_quantity", "disc": "l_discount", "tax": "l_tax",
             "flag": "l_returnflag"}
    paired = lines.select(
        "l_orderkey",
        F.row_number().over(w).alias("rn"),
        *[F.col(source).alias(f"red_{n}") for n, source in names.items()],
        *[F.lead(source).over(w).alias(f"blue_{n}") for n, source in names.items()],
    ).filter((F.col("rn") % 2 == 1) & (F.col("blue_id").isNotNull() if same else F.col("red_id") != F.col("blue_id")))
    winner = (
        F.when(F.col("red_price") > F.col("blue_price"), "Red")
        .when(F.col("red_price") < F.col("blue_price"), "Blue")
        .otherwise("Draw")
    )
    return paired.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 1000 + F.col("rn")).alias("bout_id"),
        F.col("o_orderdate").alias("bout_date"),
        "red_id",
        "blue_id",
        winner.alias("winner"),
        *[f"{p}_{n}" for n in ("qty", "disc", "tax", "flag") for p in ("red", "blue")],
        F.col("o_orderpriority").alias("grp"),
    )


def drawn(df: DataFrame) -> DataFrame:
    """Equal quantities count as a draw."""
    return df.withColumn("winner", F.when(F.col("red_qty") == F.col("blue_qty"), "Draw").otherwise(F.col("winner")))


def decided(df: DataFrame) -> DataFrame:
    """An outcome that follows the differences of quantity and discount, with noise hashed from the key; near zero is a draw."""
    noise = F.conv(F.substring(F.md5(F.col("bout_id").cast("string")), 1, 7), 16, 10).cast("double") / 268435456.0 * 4 - 2
    z = (F.col("red_qty") - F.col("blue_qty")) / 15 + (F.col("red_disc") - F.col("blue_disc")) * 10 + noise
    return df.withColumn("winner", F.when(z > 0.2, "Red").when(z < -0.2, "Blue").otherwise("Draw"))


def gappy(df: DataFrame) -> DataFrame:
    """Zero discounts and taxes are missing, one flag is unknown, and ``red_rare`` is nearly always missing."""
    return df.withColumns(
        {
            **{f"{p}_{n}": F.nullif(F.col(f"{p}_{n}"), F.lit(0.0)) for p in ("red", "blue") for n in ("disc", "tax")},
            "red_flag": F.nullif(F.col("red_flag"), F.lit("R")),
            "red_rare": F.when(F.col("red_qty") > 45, F.col("red_qty")),
        }
    )


def past(df: DataFrame) -> DataFrame:
    return df.filter(F.col("bout_date") < F.lit(UPCOMING_FROM).cast("timestamp_ntz"))


def upcoming(df: DataFrame) -> DataFrame:
    """Bouts still to come: no outcome yet."""
    later = df.filter(F.col("bout_date") >= F.lit(UPCOMING_FROM).cast("timestamp_ntz"))
    return later.withColumn("winner", F.lit(None).cast("string"))


def scored(df: DataFrame) -> DataFrame:
    """Two fixed models, published with six decimals."""
    quantity = 1 / (1 + F.exp(-(F.col("red_qty") - F.col("blue_qty")) / 10))
    tax = 1 / (1 + F.exp(-(F.round(F.col("red_tax") * 100) - F.round(F.col("blue_tax") * 100)) / 5))
    return df.withColumns({"prob_a": r6(quantity), "prob_b": r6(tax)})


NAMED = Layout(red="red_", blue="blue_", entity="name", date="bout_date", outcome="winner", key="bout_id")


def named_bouts(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """Bouts with supplier names, and ``peak``, a stat many suppliers never have; ``every`` is a stored table of the bouts."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    out = bouts(spark, sf_dir) if every is None else every
    for p in ("red", "blue"):
        side = names.select(F.col("s_suppkey").alias(f"{p}_id"), F.col("s_name").alias(f"{p}_name"))
        peak = F.when((F.col(f"{p}_qty") == 50) & (F.col(f"{p}_disc") == 0), F.col(f"{p}_tax"))
        out = out.join(side, f"{p}_id").withColumn(f"{p}_peak", peak)
    return out.drop("red_id", "blue_id")


BOUTS_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem),
bouts AS (SELECT r.l_orderkey * 1000 + r.rn AS bout_id, o.o_orderdate AS bout_date,
  r.l_suppkey AS red_id, u.l_suppkey AS blue_id,
  CASE WHEN r.l_extendedprice > u.l_extendedprice THEN 'Red'
       WHEN r.l_extendedprice < u.l_extendedprice THEN 'Blue' ELSE 'Draw' END AS winner,
  r.l_quantity AS red_qty, u.l_quantity AS blue_qty, r.l_discount AS red_disc, u.l_discount AS blue_disc,
  r.l_tax AS red_tax, u.l_tax AS blue_tax, r.l_returnflag AS red_flag, u.l_returnflag AS blue_flag,
  o.o_orderpriority AS grp
 FROM n r JOIN n u ON r.l_orderkey = u.l_orderkey AND u.rn = r.rn + 1 AND r.rn % 2 = 1
 JOIN orders o ON o.o_orderkey = r.l_orderkey
 WHERE r.l_suppkey <> u.l_suppkey)"""

PAIRS_SQL = BOUTS_SQL.replace("bouts AS", "pairs AS").replace("\n WHERE r.l_suppkey <> u.l_suppkey", "")

DRAWN_SQL = """drawn AS (SELECT * REPLACE (CASE WHEN red_qty = blue_qty THEN 'Draw' ELSE winner END AS winner) FROM bouts)"""

DECIDED_SQL = """decided AS (SELECT * REPLACE (CASE WHEN z > 0.2e0 THEN 'Red' WHEN z < -0.2e0 THEN 'Blue' ELSE 'Draw' END AS winner) FROM (SELECT *,
  (red_qty - blue_qty) / 15e0 + (red_disc - blue_disc) * 10e0 + (('0x' || substr(md5(CAST(bout_id AS VARCHAR)), 1, 7))::BIGINT / 268435456e0 * 4 - 2) AS z FROM bouts))"""

GAPPY_SQL = """gappy AS (SELECT * REPLACE (nullif(red_disc, 0) AS red_disc, nullif(blue_disc, 0) AS blue_disc,
  nullif(red_tax, 0) AS red_tax, nullif(blue_tax, 0) AS blue_tax, nullif(red_flag, 'R') AS red_flag),
  CASE WHEN red_qty > 45 THEN red_qty END AS red_rare FROM bouts)"""

SCORED_SQL = """scored AS (SELECT *, floor(1 / (1 + exp(-(red_qty - blue_qty) / 10)) * 1e6 + 0.5001) / 1e6 AS prob_a,
  floor(1 / (1 + exp(-(round(red_tax * 100) - round(blue_tax * 100)) / 5)) * 1e6 + 0.5001) / 1e6 AS prob_b FROM bouts)"""

NAMED_SQL = """named AS (SELECT b.*, r.s_name AS red_name, u.s_name AS blue_name,
  CASE WHEN red_qty = 50 AND red_disc = 0 THEN red_tax END AS red_peak,
  CASE WHEN blue_qty = 50 AND blue_disc = 0 THEN blue_tax END AS blue_peak
 FROM bouts b JOIN supplier r ON r.s_suppkey = b.red_id JOIN supplier u ON u.s_suppkey = b.blue_id)"""
