"""Normalisation of observation frames (projections only, no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from tabprep.functions.missing import nullify_tokens
from tabprep.rules import CLEAN_TOKENS, DATE_FORMAT, DIRECTION_COLUMNS, YES_NO_COLUMNS


_strict: ContextVar[bool] = ContextVar("strict", default=False)


@contextmanager
def strict_columns(on: bool = True) -> Iterator[None]:
    """Within this block operators raise KeyError for listed columns that a frame lacks, instead of leaving them out."""
    before = _strict.set(on)
    try:
        yield
    finally:
        _strict.reset(before)


def present(df: DataFrame, cols: Iterable[str], strict: bool | None = None) -> list[str]:
    """The listed columns that exist in ``df``. ``strict`` raises on absent ones; by default as ``strict_columns`` says."""
    cols = list(cols)
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing and (_strict.get() if strict is None else strict):
        raise KeyError(f"absent columns: {missing}")
    return [c for c in cols if c in have]


def normalize_case_trim(df: DataFrame, cols: Iterable[str] = DIRECTION_COLUMNS) -> DataFrame:
    """Upper-case and trim category columns."""
    return df.withColumns({c: F.upper(F.trim(F.col(c))) for c in present(df, cols)})


def nullify(df: DataFrame, cols: Iterable[str] = DIRECTION_COLUMNS,
            tokens: Iterable[str] = CLEAN_TOKENS) -> DataFrame:
    """Missing tokens (exact match) become NULL."""
    toks = list(tokens)
    return df.withColumns({c: nullify_tokens(c, toks) for c in present(df, cols)})


def standardize_yes_no(df: DataFrame, cols: Iterable[str] = YES_NO_COLUMNS) -> DataFrame:
    """trim+lower ``yes``/``no`` become ``Yes``/``No``; other values are kept."""
    def one(c):
        k = F.lower(F.trim(F.col(c)))
        return F.when(k == "yes", F.lit("Yes")).when(k == "no", F.lit("No")).otherwise(F.col(c))
    return df.withColumns({c: one(c) for c in present(df, cols)})


def nullify_yes_no_tokens(df: DataFrame, cols: Iterable[str] = YES_NO_COLUMNS,
                          tokens: Iterable[str] = CLEAN_TOKENS) -> DataFrame:
    """Blank or token values (compared upper+trim) become NULL (D1)."""
    toks = [t.upper() for t in tokens]

    def one(c):
        t = F.upper(F.trim(F.col(c)))
        return F.when((t == "") | t.isin(*toks), F.lit(None).cast("string")).otherwise(F.col(c))
    return df.withColumns({c: one(c) for c in present(df, cols)})


def to_date_column(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """Make ``col`` a date; unparseable text becomes NULL (never raises)."""
    t = df.schema[col].dataType
    if isinstance(t, DateType):
        return df
    c = F.col(col)
    if isinstance(t, StringType):
        parsed = F.try_to_date(c, fmt) if fmt else c.try_cast("date")
    else:
        parsed = c.try_cast("date")
    return df.withColumn(col, parsed)


def add_month(df: DataFrame, date_col: str = "Date", month_col: str = "Month", fmt: str | None = None) -> DataFrame:
    """Ensure ``date_col`` is a date and add ``month_col`` (1..12, int)."""
    return to_date_column(df, date_col, fmt).withColumn(month_col, F.month(F.col(date_col)))


def parse_numeric(df: DataFrame, cols: Iterable[str], tokens: Iterable[str] = CLEAN_TOKENS) -> DataFrame:
    """Text numbers -> double: tokens and blanks to NULL first, then ``try_cast``."""
    toks = [t.upper() for t in tokens]

    def one(c):
        s = F.trim(F.col(c).cast("string"))
        return F.when((s == "") | F.upper(s).isin(*toks), F.lit(None)).otherwise(s).try_cast("double")
    return df.withColumns({c: one(c) for c in present(df, cols)})


def normalize_observations(df: DataFrame, date_col: str = "Date", month_col: str = "Month",
                           direction_cols: Iterable[str] = DIRECTION_COLUMNS,
                           yes_no_cols: Iterable[str] = YES_NO_COLUMNS,
                           tokens: Iterable[str] = CLEAN_TOKENS, date_format: str | None = None,
                           numeric_text_cols: Iterable[str] = ()) -> DataFrame:
    """Date to date type, direction labels upper+trim then tokens to NULL,
    yes/no spelled ``Yes``/``No``, ``Month`` added, and (D1) text numbers parsed.

    All of it is one projection: Catalyst collapses the stacked ``withColumns``.
    """
    out = to_date_column(df, date_col, date_format)
    out = normalize_case_trim(out, direction_cols)
    out = nullify(out, direction_cols, tokens)
    out = standardize_yes_no(out, yes_no_cols)
    out = nullify_yes_no_tokens(out, yes_no_cols, tokens)
    out = parse_numeric(out, numeric_text_cols, tokens)
    return out.withColumn(month_col, F.month(F.col(date_col)))


def cast_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Cast the listed, present columns to double (unparseable -> NULL)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in present(df, cols)})


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*present(df, cols))


