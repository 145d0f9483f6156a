"""Row filters (all pushed into the scan's stage; none shuffles)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from tabprep.functions.missing import all_present
from tabprep.rules import DATE_FORMAT, PROFILE_TOKENS


def complete_rows(df: DataFrame, cols: Iterable[str] | None = None,
                  tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """Rows where none of the columns (default: all) is missing."""
    return df.filter(all_present(df.columns if cols is None else cols, tokens))


def filter_invalid_domain(df: DataFrame, col: str, domain: Iterable[str]) -> DataFrame:
    """Rows whose non-NULL value lies outside ``domain``."""
    c = F.col(col)
    return df.filter(c.isNotNull() & ~c.isin(*list(domain)))


def out_of_range(col: str, lo: float, hi: float):
    """Present as a number and outside [lo, hi]; text that is no number is not."""
    c = F.col(col).try_cast("double")
    return c.isNotNull() & ((c < F.lit(lo)) | (c > F.lit(hi)))


def filter_out_of_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Non-NULL values below ``lo`` or above ``hi``."""
    return df.filter(out_of_range(col, lo, hi))


def unparseable_date(df: DataFrame, col: str, fmt: str = DATE_FORMAT):
    """Text: present but not parseable with ``fmt``. Date/timestamp: NULL."""
    t = df.schema[col].dataType
    c = F.col(col)
    if isinstance(t, StringType):
        return c.isNotNull() & F.try_to_date(c, fmt).isNull()
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return c.isNull()
    return c.isNotNull() & c.try_cast("date").isNull()


def filter_unparseable_dates(df: DataFrame, col: str, fmt: str = DATE_FORMAT) -> DataFrame:
    return df.filter(unparseable_date(df, col, fmt))


def invalid_date_examples(df: DataFrame, col: str, show_cols: list[str], order_by: list[str],
                          n: int = 20, fmt: str = DATE_FORMAT) -> DataFrame:
    """The first ``n`` offending rows (a top-n report: each task keeps ``n``)."""
    return filter_unparseable_dates(df, col, fmt).select(*show_cols).orderBy(*order_by).limit(n)


def labelled(col: str, classes: Iterable[str] = ("yes", "no"), trim: bool = False):
    v = F.lower(F.trim(F.col(col)) if trim else F.col(col))
    return v.isin(*[c.lower() for c in classes])


def filter_labelled(df: DataFrame, col: str, classes: Iterable[str] = ("yes", "no"),
                    trim: bool = False) -> DataFrame:
    """Rows with a valid label, case-insensitive (no trim unless asked, D19)."""
    return df.filter(labelled(col, classes, trim))


def filter_class(df: DataFrame, col: str, cls: str, trim: bool = False) -> DataFrame:
    """Rows of one class of the label, case-insensitive."""
    v = F.lower(F.trim(F.col(col)) if trim else F.col(col))
    return df.filter(v == cls.lower())
