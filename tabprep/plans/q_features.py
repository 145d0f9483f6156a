"""Registered queries: feature operators and the feature plan."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabprep.operators import features as FE
from tabprep.plans import sqlfrag as S
from tabprep.plans.catalog import norm_obs, query, rounded, train_of
from tabprep.plans.cleaning import TEST, TRAIN
from tabprep.plans.features import FeatureModel, FeatureSpec
from tabprep.plans.q_clean import CLEAN_CTES, cleaned_halves
from tabprep.sources.fixtures import obs

W = S.with_
R6 = S.r6
TWO_PI = repr(2.0 * math.pi)

OBS_FEATURES = FeatureSpec(
    label="status", month="month", pairs=(("ab_avg", "num_a", "num_b"),), pairs_floor=(("cm_avg", "code", "month"),),
    drop=("location", "obs_date", "date_txt", "yn", "dir", "month"),
    continuous=("num_a", "num_b", "txt_num", "ab_avg"), vector_cols=("dir_ux", "dir_uy"),
    cyclic_prefix="month", cyclic=("month_sin", "month_cos"))
VEC_COLS = ["num_a", "num_b", "txt_num", "code"]
SCALE_COLS = ["num_a", "num_b", "code"]


@query("pair_average", W(S.OBS, body=f"select row_id, {R6('(num_a + num_b) / 2.0')} as ab_avg from obs"))
def q_pair_average(spark, sf):
    d = FE.pair_average(obs(spark, sf), (("ab_avg", "num_a", "num_b"), ("zz_avg", "num_a", "absent")))
    return rounded(d.select("row_id", "ab_avg"))


@query("pair_average_floor", W(S.OBS, body="select row_id, cast(floor((code + month) / 2.0) as bigint) as cm_avg from obs"))
def q_pair_average_floor(spark, sf):
    return FE.pair_average_floor(obs(spark, sf), (("cm_avg", "code", "month"),)).select("row_id", "cm_avg")


@query("cyclic_month", W(S.OBS, body=(
    f"select row_id, {R6(f'sin({TWO_PI}::double * (cast(month as double) / 12.0))')} as month_sin, "
    f"{R6(f'cos({TWO_PI}::double * (cast(month as double) / 12.0))')} as month_cos from obs")))
def q_cyclic_month(spark, sf):
    return rounded(FE.cyclic_month(obs(spark, sf), "month", "month").select("row_id", "month_sin", "month_cos"))


_BC = ["num_a", "code", "month", "yn", "status"]


@query("adaptive_bucket_count", W(S.OBS, body=" union all ".join(
    f"select '{c}' as column_name, n as n_distinct, cast(least(10, greatest(3, n - 1)) as integer) as n_buckets from "
    f"(select cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) as n from obs)"
    for c in _BC)))
def q_adaptive_bucket_count(spark, sf):
    return FE.adaptive_bucket_count(obs(spark, sf), _BC, exact=True)


def bin_invariants(train, df, cols, suffix="_bin", buckets: int = 10, error: float = 0.02):
    """Per column, what bins of any valid fit satisfy on ``df``, and on ``train`` that they were fitted on: rows, NULLs, bins
    of present values, values in the order of their bins, and cuts whose rank is within ``error`` of its target."""
    def long(d):
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"),
                                  F.col(c + suffix).alias("bin")) for c in cols])
        return d.select(F.inline(rows))

    def per_bin(d):
        values = long(d).filter("v is not null").groupBy("column_name", "bin", "v").agg(F.count(F.lit(1)).alias("n"))
        return values.groupBy("column_name", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                                        F.min_by("n", "v").alias("ties"))
    w = Window.partitionBy("column_name").orderBy("bin")  # at most ``buckets`` rows for each column
    order = per_bin(df).withColumn("next", F.lead("lo").over(w)).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_bins"), F.bool_and(F.col("next").isNull() | (F.col("hi") < F.col("next"))).alias("order_kept"))
    total = F.sum("n").over(Window.partitionBy("column_name"))
    cut = per_bin(train).withColumn("below", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)) / total).withColumn(
        "upto", F.col("below") + F.col("ties") / total).withColumn("target", (F.row_number().over(w) - 1) / buckets)
    rank = cut.groupBy("column_name").agg(F.bool_and(F.col("below").isNull() | (
        (F.col("below") <= F.col("target") + error) & (F.col("upto") >= F.col("target") - error))).alias("rank_kept"))
    counts = long(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"))
    return counts.join(order, "column_name").join(rank, "column_name")


def _bins_sql(src: str, cols) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, count(*) as n_rows, count_if({c} is null) as n_null, cast(10 as bigint) as n_bins, "
        f"true as order_kept, true as rank_kept from {src}" for c in cols)


_QB = ["num_a", "num_b", "txt_num"]


@query("quantile_bins", W(S.OBS, S.NORM, body=_bins_sql("norm", _QB)))
def q_quantile_bins(spark, sf):
    n = norm_obs(spark, sf)
    b = FE.quantile_bins(train_of(n), n, _QB)
    return bin_invariants(train_of(b), b, _QB)


def _vec_sql_cols(cols, prefix):
    return ", ".join(f"{R6(f'coalesce(cast({c} as double), {chr(39)}NaN{chr(39)}::double)')} as {prefix}_{c}"
                     for c in cols)


@query("assemble_features", W(S.OBS, S.NORM, body=f"select row_id, {_vec_sql_cols(VEC_COLS, 'f')} from norm"))
def q_assemble_features(spark, sf):
    d = FE.assemble_features(norm_obs(spark, sf), VEC_COLS, "fv")
    return rounded(FE.vector_columns(d, "fv", VEC_COLS, "f").select("row_id", *[f"f_{c}" for c in VEC_COLS]))


def _z_sql(c: str) -> str:
    nan = "'NaN'::double"
    return R6(f"coalesce(case when s_{c} != 0 then ({c} - m_{c}) * (1.0 / s_{c}) when {c} is not null then 0.0 end, {nan})") + f" as z_{c}"


def _moments_sql(cols, src: str) -> str:
    return "st as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in cols) + f" from {src})"


@query("standardize_features", W(S.OBS, S.NORM, S.TRAIN, _moments_sql(SCALE_COLS, "train"), body=(
    f"select row_id, {', '.join(map(_z_sql, SCALE_COLS))} from norm, st")))
def q_standardize_features(spark, sf):
    n = norm_obs(spark, sf)
    d = FE.standardize_features(train_of(n), n, SCALE_COLS, "zv")
    return rounded(FE.vector_columns(d, "zv", SCALE_COLS, "z").select("row_id", *[f"z_{c}" for c in SCALE_COLS]))


@query("index_label", W(S.OBS, S.NORM, S.TRAIN, body=(
    "select n.row_id, n.status, cast(l.label as double) as label from norm n join "
    "(select status, row_number() over (order by count(*) desc, status) - 1 as label from train "
    "where status is not null group by status) l using (status)")))
def q_index_label(spark, sf):
    n = norm_obs(spark, sf)
    return FE.index_label(train_of(n), n, "status").select("row_id", "status", "label")


_CONT = ["num_a", "num_b", "txt_num", "ab_avg"]
_FEATURES = [*_CONT, "dir_ux", "dir_uy", "month_sin", "month_cos"]
_ANGLE = f"{TWO_PI}::double * (cast(month as double) / 12.0)"
_FEAT_CTES = [
    S.OBS, S.NORM, S.TRAIN, *CLEAN_CTES,
    f"feat as (select half, row_id, status, num_a, num_b, txt_num, (num_a + num_b) / 2.0 as ab_avg, dir_ux, dir_uy, "
    f"sin({_ANGLE}) as month_sin, cos({_ANGLE}) as month_cos from clean)",
    _moments_sql(_FEATURES, "feat where half = 'train'"),
    "lab as (select status, cast(row_number() over (order by count(*) desc, status) - 1 as double) as label from feat "
    "where half = 'train' group by status)"]


def _fitted(spark, sf):
    """(feature model of the cleaned training half, both cleaned halves)"""
    clean = cleaned_halves(spark, sf)
    return FeatureModel.fit(clean.filter(F.col("half") == TRAIN), OBS_FEATURES), clean


@query("assemble_binned", W(*_FEAT_CTES, body=_bins_sql("feat", _CONT)))
def q_assemble_binned(spark, sf):
    model, clean = _fitted(spark, sf)
    t = model.transform(clean)
    # the bins as the assembled vector holds them
    b = FE.vector_columns(t, "features_bin", _CONT, "v").withColumns({f"{c}_bin": F.col(f"v_{c}") for c in _CONT})
    return bin_invariants(b.filter(F.col("half") == TRAIN), b, _CONT)


@query("feature_pipeline", W(*_FEAT_CTES, body=(
    f"select half, row_id, label, {_vec_sql_cols(_FEATURES, 'r')}, {', '.join(map(_z_sql, _FEATURES))} "
    f"from feat join lab using (status), st")))
def q_feature_pipeline(spark, sf):
    model, clean = _fitted(spark, sf)
    t = FE.vector_columns(model.transform(clean), "features_cont_raw", _FEATURES, "r")
    t = FE.vector_columns(t, "features_cont_scaled", _FEATURES, "z")
    return rounded(t.select("half", "row_id", "label", *[f"{p}_{c}" for p in "rz" for c in _FEATURES]))


_EXTRAS = ["dir_ux", "dir_uy", "month_sin", "month_cos"]
_RAW_SQL = ", ".join(f"{R6(f'coalesce({c}, {chr(39)}NaN{chr(39)}::double)')} as z_{c}" for c in _EXTRAS)

_MISSING_SQL = "case when {c} is null then 'NaN'::double end as z_{c}"


@query("feature_frames", W(*_FEAT_CTES, body=(
    f"select half, 'linear' as kind, label, {', '.join(map(_z_sql, _FEATURES))}, cast(null as boolean) as bins_valid "
    f"from feat join lab using (status), st union all by name select half, 'binned' as kind, label, "
    f"{', '.join(_MISSING_SQL.format(c=c) for c in _CONT)}, {_RAW_SQL}, true as bins_valid "
    f"from feat join lab using (status)")))
def q_feature_frames(spark, sf):
    """All rows of the four frames (two for each half): label and features. The features of the linear frames are scaled
    values. Those of the binned ones are bins, checked to be whole numbers that the fit can give and NaN only for missing values
    (``assemble_binned`` checks their cuts), and the values that are not binned."""
    model, clean = _fitted(spark, sf)
    out = None
    for half in (TRAIN, TEST):
        linear, binned = model.frames(clean.filter(F.col("half") == half))
        linear = FE.vector_columns(linear, "features", _FEATURES, "z").withColumn("bins_valid", F.lit(None).cast("boolean"))
        array = vector_to_array("features")
        # a fit of b buckets gives bins 0 .. b - 1, and NaN to missing values
        valid = [F.isnan(array[i]) | ((array[i] == F.floor(array[i])) & array[i].between(0, model.buckets[c] - 1))
                 for i, c in enumerate(_CONT)]
        binned = binned.withColumns({f"z_{c}": array[len(_CONT) + i] for i, c in enumerate(_EXTRAS)} | {
            f"z_{c}": F.when(F.isnan(array[i]), array[i]) for i, c in enumerate(_CONT)} | {
            "bins_valid": reduce(and_, valid) & (F.size(array) == len(_FEATURES))})
        for kind, frame in (("linear", linear), ("binned", binned)):
            part = frame.select(F.lit(half).alias("half"), F.lit(kind).alias("kind"), "label", *[f"z_{c}" for c in _FEATURES], "bins_valid")
            out = part if out is None else out.unionByName(part)
    return rounded(out)
