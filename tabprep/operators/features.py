"""Feature preparation: pair averages, cyclic month, quantile bins, vectors,
scaling and label indexing (Spark ML stages, fitted on the training half)."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.feature import QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabprep.operators.normalize import present
from tabprep.rules import BIN_MAX_BUCKETS, BIN_MIN_BUCKETS, BIN_RELATIVE_ERROR, PAIR_AVERAGES, PAIR_AVERAGES_FLOOR


def pair_average(df: DataFrame, pairs=PAIR_AVERAGES) -> DataFrame:
    """``out = (a + b) / 2.0`` for each (out, a, b) whose inputs both exist."""
    have = set(df.columns)
    return df.withColumns({o: (F.col(a) + F.col(b)) / 2.0 for o, a, b in pairs if a in have and b in have})


def pair_average_floor(df: DataFrame, pairs=PAIR_AVERAGES_FLOOR) -> DataFrame:
    """``out = floor((a + b) / 2.0)`` (bigint) for discrete pairs."""
    have = set(df.columns)
    return df.withColumns({o: F.floor((F.col(a) + F.col(b)) / 2.0) for o, a, b in pairs if a in have and b in have})


def cyclic_month(df: DataFrame, month: str = "Month", prefix: str = "Month") -> DataFrame:
    """``<prefix>_sin``/``_cos`` of 2*pi*month/12."""
    if month not in df.columns:
        return df
    a = F.lit(2.0 * math.pi) * (F.col(month).cast("double") / F.lit(12.0))
    return df.withColumns({f"{prefix}_sin": F.sin(a), f"{prefix}_cos": F.cos(a)})


def _comparable(df: DataFrame, c: str):
    """The column with one zero."""
    return F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(c)


def saturating_distinct(df: DataFrame, cols: Iterable[str], limit: int) -> dict[str, int]:
    """Distinct values (NULL counts as one) of each column, exact below ``limit`` and ``limit`` from there on.

    One pass of HyperLogLog++ sketches tells the columns of many values: up to ``limit`` values fill at most as many
    of its registers, and its count of that few registers exceeds them by under one half, so an estimate
    above ``limit + 1`` proves that there are more. Only the others, which have few values, are counted exactly, as sets that
    combine map-side; no value of a continuous column crosses a shuffle."""
    cols = present(df, cols)
    if not cols:
        return {}
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if rough[f"d{i}"] <= limit + 1]
    exact = {}
    if few:
        one = df.agg(*[(F.size(F.collect_set(_comparable(df, c))) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(f"d{i}")
                       for i, c in enumerate(few)]).first()  # sets of some ``limit`` values
        exact = {c: min(limit, one[f"d{i}"]) for i, c in enumerate(few)}
    return {c: exact.get(c, limit) for c in cols}


def distinct_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(column_name, n_distinct): all distinct values (NULL counts as one) of each column, 0 in an empty frame. The values are
    grouped by Spark, so the number of them is not bounded."""
    cols = present(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    one = df.agg(*[(F.count_distinct(F.col(c)) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(f"d{i}")
                   for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").cast("long").alias("n_distinct"))
                                         for i, c in enumerate(cols)])))


def adaptive_bucket_count(df: DataFrame, cols: Iterable[str], lo: int = BIN_MIN_BUCKETS,
                          hi: int = BIN_MAX_BUCKETS, exact: bool = False) -> DataFrame:
    """Per column: distinct values d (NULL counts as one) and min(hi, max(lo, d - 1)). With ``exact`` d counts all values, else as far
    as hi + 2, which decide the buckets."""
    if exact:
        return distinct_counts(df, cols).withColumn(
            "n_buckets", F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("n_distinct") - 1)).cast("int"))
    rows = [(c, n, min(hi, max(lo, n - 1))) for c, n in saturating_distinct(df, cols, hi + 2).items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_distinct long, n_buckets int")


def bucket_counts(df: DataFrame, cols: Iterable[str], lo: int = BIN_MIN_BUCKETS, hi: int = BIN_MAX_BUCKETS) -> dict:
    """Bucket count per column as a dict, equal to ``adaptive_bucket_count``."""
    return {c: min(hi, max(lo, n - 1)) for c, n in saturating_distinct(df, cols, hi + 2).items()}


def quantile_discretizer(cols: list[str], buckets: dict, relative_error: float = BIN_RELATIVE_ERROR,
                         suffix: str = "_bin") -> QuantileDiscretizer:
    """One multi-column discretiser: all quantiles come from a single job."""
    return QuantileDiscretizer(inputCols=cols, outputCols=[c + suffix for c in cols],
                               numBucketsArray=[buckets[c] for c in cols],
                               relativeError=relative_error, handleInvalid="keep")


def quantile_bins(train: DataFrame, df: DataFrame, cols: Iterable[str], buckets: dict | None = None,
                  relative_error: float = BIN_RELATIVE_ERROR) -> DataFrame:
    """Bin ``df`` with quantile splits fitted on ``train`` (NaN kept in an extra bucket)."""
    cols = present(train, cols)
    buckets = buckets or bucket_counts(train, cols)
    return quantile_discretizer(cols, buckets, relative_error).fit(train).transform(df)


def assembler(cols: list[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def scaler(inp: str, out: str) -> StandardScaler:
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def label_indexer(label: str, out: str = "label") -> StringIndexer:
    """Most frequent class -> 0 (ties alphabetical); unseen / NULL rows skipped."""
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid="skip", stringOrderType="frequencyDesc")


def assemble_features(df: DataFrame, cols: Iterable[str], out: str = "features_cont_raw") -> DataFrame:
    return assembler(present(df, cols), out).transform(df)


def moments(train: DataFrame, cols: Iterable[str]) -> dict:
    """Mean and sample standard deviation of the present (not NULL, not NaN) values of each column."""
    cols = list(cols)
    if not cols:
        return {}
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    one = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(known)],
                    *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(known)]).first()
    return {c: (one[f"m{i}"], one[f"s{i}"]) for i, c in enumerate(cols)}


def scaled(col: str, mean: float | None, sd: float | None):
    """(x - mean) / sd; 0 for a constant column, NULL where x is."""
    x = F.col(col).cast("double")
    if mean is None:
        return F.lit(None).cast("double")
    return (x - F.lit(mean)) * F.lit(1.0 / sd) if sd else F.when(x.isNotNull(), F.lit(0.0))


def scale_vector(df: DataFrame, stats: dict, out: str) -> DataFrame:
    """The scaled columns of ``stats`` as one vector; a missing value is NaN in its own place only."""
    names = {c: f"__z{i}" for i, c in enumerate(stats)}
    wide = df.withColumns({names[c]: scaled(c, *ms) for c, ms in stats.items()})
    return assembler(list(names.values()), out).transform(wide).drop(*names.values())


def standardize_features(train: DataFrame, df: DataFrame, cols: Iterable[str],
                         out: str = "features_cont_scaled") -> DataFrame:
    """(x - mean) / sample stddev, both over the present values of ``train``."""
    return scale_vector(df, moments(train, present(train, cols)), out)


def index_label(train: DataFrame, df: DataFrame, label: str, out: str = "label") -> DataFrame:
    return label_indexer(label, out).fit(train).transform(df)


def vector_columns(df: DataFrame, vec: str, names: list[str], prefix: str | None = None) -> DataFrame:
    """Expand a vector into scalar double columns (for checking)."""
    a = vector_to_array(F.col(vec))
    p = prefix or vec
    return df.withColumns({f"{p}_{n}": a[i] for i, n in enumerate(names)})
