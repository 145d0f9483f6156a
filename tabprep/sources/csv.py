"""Delimited-text source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True,
             sep: str = ",", null_value: str | None = None, infer_schema: bool | None = None) -> DataFrame:
    """Read delimited text with a header.

    An explicit ``schema`` is preferred at scale (inference reads the data an
    extra time); without one the schema is inferred. Whitespace is kept as is,
    so ``" NA "`` stays distinguishable from ``"NA"``.
    """
    r = spark.read.option("header", header).option("sep", sep) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True if infer_schema is None else infer_schema)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Write with a header, keeping leading/trailing blanks in text values."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("dateFormat", "yyyy-MM-dd")
       .csv(path))
