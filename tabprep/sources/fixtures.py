"""The ``obs`` observation frame, a pure projection of the driver's ``orders``.

Gives an observation panel with planted gaps: entity ``location`` (25 values),
``obs_date``/``month``, numeric measures with missing months, text numbers with
missing tokens, a compass column, a yes/no column, a code column with a
sentinel and a date-as-text column with unparseable values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.rules import Layout

OBS_LAYOUT = Layout(entity="location", time="obs_date", month="month", row_id="row_id", label="status")

# Compass labels planted by (row_id * 7) % 19; 16 = token, 17 = unknown, 18 = NULL.
DIR_BY_RESIDUE = ("N", "NNE", " ne ", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW",
                   "WSW", "W", "WNW", "NW", "NNW", "NA", "Q")


def _case(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def obs_from_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    m = F.month("o_orderdate")
    price = F.col("o_totalprice")
    return orders.select(
        k.alias("row_id"),
        F.concat(F.lit("L"), (F.col("o_custkey") % 25).cast("string")).alias("location"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        m.cast("int").alias("month"),
        F.when((m == 12) & (k % 2 == 0), F.lit(None))
         .when(k % 7 == 0, F.lit(None)).otherwise(price).cast("double").alias("num_a"),
        F.when(m == 2, F.when(k % 3 == 0, F.lit(None)))
         .when(k % 11 == 0, F.lit(None)).otherwise(price / 10).cast("double").alias("num_b"),
        F.when(k % 13 == 0, F.lit("NA")).when(k % 17 == 0, F.lit(" "))
         .otherwise(price.cast("string")).alias("txt_num"),
        _case((k * 7) % 19, DIR_BY_RESIDUE).alias("dir"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.lit("NA"))
         .when(F.col("o_orderstatus") == "F", F.lit(" yes")).otherwise(F.lit("No")).alias("yn"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(k % 10).cast("bigint").alias("code"),
        F.when(k % 41 == 0, F.lit("2020-02-30x"))
         .otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")).alias("date_txt"),
        F.col("o_orderstatus").alias("status"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation frame over ``orders`` at ``sf_dir``."""
    return obs_from_orders(read_table(spark, sf_dir, "orders"))


def obs_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` plus an exact second copy of every row whose row_id % 100 == 0."""
    o = obs(spark, sf_dir)
    return o.unionByName(o.filter(F.col("row_id") % 100 == 0))
