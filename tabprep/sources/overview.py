"""Frame overview: schema, row count and first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_overview(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, Spark type, row and column counts.

    The row count is one distributed aggregate; the schema (driver metadata)
    is unfolded next to it with ``inline`` over a literal array, so no join.
    """
    fields = [
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"))
        for i, f in enumerate(df.schema.fields)
    ]
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.inline(F.array(*fields)), "n_rows",
                      F.lit(len(df.columns)).alias("n_columns")))


def first_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (by ``order_by`` when given, so the result is stable)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
