"""The feature plan: derived columns, then one Spark ML pipeline fitted on
the training half only (quantile bins, raw and standardised vectors, binned
vector, label index) and applied to both halves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators.features import (
    assembler, bucket_counts, cyclic_month, label_indexer, moments, pair_average, pair_average_floor,
    quantile_discretizer, scale_vector, scaler,
)
from tabprep.operators.normalize import cast_numeric, drop_columns, present
from tabprep.rules import (
    BIN_RELATIVE_ERROR, CONTINUOUS_COLUMNS, DIRECTION_COLUMNS, DROP_COLUMNS, PAIR_AVERAGES, PAIR_AVERAGES_FLOOR,
)
from tabprep.session import materialize, release


@dataclass
class FeatureSpec:
    label: str = "RainTomorrow"
    month: str = "Month"
    pairs: tuple = PAIR_AVERAGES
    pairs_floor: tuple = PAIR_AVERAGES_FLOOR
    drop: tuple = DROP_COLUMNS
    continuous: tuple = CONTINUOUS_COLUMNS
    vector_cols: tuple = tuple(f"{c}_{a}" for c in DIRECTION_COLUMNS for a in ("ux", "uy"))
    cyclic_prefix: str = "Month"
    cyclic: tuple = ("Month_sin", "Month_cos")
    relative_error: float = BIN_RELATIVE_ERROR
    bin_suffix: str = "_bin"
    buckets: dict = field(default_factory=dict)  # fixed bucket counts; empty = adaptive
    strict: bool = False  # raise when a scaled input holds NULL/NaN
    literal_scaling: bool = False  # Spark ML's scaler, whose mean is NaN if one value is missing


def derive(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Pair averages, cyclic month, drops, continuous columns as double."""
    out = pair_average(df, spec.pairs)
    out = pair_average_floor(out, spec.pairs_floor)
    out = cyclic_month(out, spec.month, spec.cyclic_prefix)
    out = drop_columns(out, spec.drop)
    return cast_numeric(out, spec.continuous)


@dataclass
class FeatureModel:
    spec: FeatureSpec
    model: PipelineModel
    buckets: dict
    moments: dict  # of the scaled columns; empty with literal scaling

    @classmethod
    def fit(cls, train: DataFrame, spec: FeatureSpec) -> "FeatureModel":
        """Fit every stage on ``train``. The derived training frame is read by
        several fitting jobs (bucket counts, quantiles, moments, label counts),
        so it is written to the shared folder for the duration of the fit."""
        written: list = []
        t = materialize(derive(train, spec), "features-train", written)
        try:
            return cls._fit(t, spec)
        finally:
            release(train.sparkSession, written)

    @classmethod
    def _fit(cls, t: DataFrame, spec: FeatureSpec) -> "FeatureModel":
        cont = present(t, spec.continuous)
        buckets = {c: spec.buckets[c] for c in cont} if spec.buckets else bucket_counts(t, cont)
        extra = present(t, list(spec.vector_cols) + list(spec.cyclic))
        if spec.strict:
            bad = t.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c))).alias(c) for c in cont + extra]).first()
            holes = {c: bad[c] for c in cont + extra if bad[c]}
            if holes:
                raise ValueError(f"scaled inputs hold NULL/NaN values: {holes}")
        bins = [c + spec.bin_suffix for c in cont]
        stages = []
        if cont:
            stages.append(quantile_discretizer(cont, buckets, spec.relative_error, spec.bin_suffix))
        stages += [assembler(cont + extra, "features_cont_raw"), assembler(bins + extra, "features_bin"),
                   label_indexer(spec.label, "label")]
        if spec.literal_scaling:
            stages.append(scaler("features_cont_raw", "features_cont_scaled"))
        return cls(spec, Pipeline(stages=stages).fit(t), buckets, {} if spec.literal_scaling else moments(t, cont + extra))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(derive(df, self.spec))
        return out if self.spec.literal_scaling else scale_vector(out, self.moments, "features_cont_scaled")

    def frames(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(label, features) for linear models and for binned models."""
        t = self.transform(df)
        return (t.select("label", t["features_cont_scaled"].alias("features")),
                t.select("label", t["features_bin"].alias("features")))
