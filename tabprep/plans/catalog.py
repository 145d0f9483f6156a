"""Registered queries: one per operator key, each with its DuckDB oracle SQL.

Every query reads the driver's parquet tables (the ``obs`` projection of
``orders``, FIXTURES.md) at ``sf_dir`` and runs over whole tables. Doubles are
rounded to 6 digits on both sides. Statistics are fitted on the hashed 80 %
training half (``train``) and applied to the whole frame. Medians use sketches of
10,000 values, which DuckDB's ``quantile_disc`` reproduces for groups of up to
that many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabprep.plans import sqlfrag as S
from tabprep.sources.fixtures import OBS_LAYOUT, obs
from tabprep.operators.normalize import normalize_observations
from tabprep.operators.split import in_train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ACC = 10_000  # percentile accuracy of the checked queries; exact while a group has at most this many rows
LAY = OBS_LAYOUT


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; wrap each call in a bigint cast."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        inner = _bigint_counts(sql[j + len(tok):k - 1])
        out.append(f"cast(count_if({inner}) as bigint)")
        i = k


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _bigint_counts(sql)
        return fn
    return deco


def quantize(c, scale: float = 1e6, offset: float = 0.3183):
    """floor(x * scale + offset) / scale: a 1e-6 grid whose cell edges sit at
    x = (k + 0.6817) * 1e-6, never on a short decimal, so an exact average that
    ends in ...5 (a rounding tie) lands mid-cell whatever the summation order.
    Same IEEE operations in DuckDB (sqlfrag.r6), so equal inputs give equal
    outputs; NaN passes through."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(x), x).otherwise(F.floor(x * F.lit(scale) + F.lit(offset)) / F.lit(scale))


def rounded(df: DataFrame) -> DataFrame:
    """Quantize every double column for comparison with the oracle."""
    return df.withColumns({f.name: quantize(f.name)
                           for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})


def norm_obs(spark: SparkSession, sf: str) -> DataFrame:
    """``obs`` normalised: compass upper+trim, tokens to NULL, yes/no spelled,
    text numbers parsed, month from the date."""
    return normalize_observations(obs(spark, sf), LAY.time, LAY.month, ["dir"], ["yn"],
                                  numeric_text_cols=["txt_num"])


def train_of(df: DataFrame) -> DataFrame:
    return df.filter(in_train("row_id"))


def sel(cols: list[str], rounding: dict | None = None) -> str:
    rounding = rounding or {}
    return ", ".join(S.r6(rounding[c]) + f" as {c}" if c in rounding else c for c in cols)

