from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabprep.operators import features as FE
from tabprep.plans.features import FeatureModel
from tabprep.plans.q_features import OBS_FEATURES
from tabprep.plans.catalog import norm_obs, train_of
from tabprep.plans.cleaning import CleaningModel
from tabprep.plans.q_clean import OBS_SPEC
from tests.conftest import SF001


def test_pair_average_and_floor(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, 4)], "a double, b double, c int, d int")
    out = FE.pair_average_floor(FE.pair_average(df, (("ab", "a", "b"), ("az", "a", "z"))), (("cd", "c", "d"),)).first()
    assert out.ab == 1.5 and out.cd == 3 and "az" not in out.asDict()


def test_cyclic_month(spark):
    df = spark.createDataFrame([(3,), (12,)], "Month int")
    r = FE.cyclic_month(df).collect()
    assert abs(r[0].Month_sin - 1.0) < 1e-12 and abs(r[1].Month_cos - 1.0) < 1e-12


def test_bucket_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")] + [(i, "c") for i in range(5, 40)],
                               "x int, y string")
    got = FE.bucket_counts(df, ["x", "y"])
    assert got == {"x": 10, "y": 3}  # y: a, b, c, NULL -> 4 distinct -> max(3, 3)


def test_adaptive_bucket_count_of_many_values(spark):
    """Columns of more values than decide the buckets are counted to the end."""
    df = spark.range(3000, numPartitions=3).select(
        F.when(F.col("id") > 0, F.col("id") / 2).alias("x"), (F.col("id") % 40).cast("string").alias("s"),
        F.when(F.col("id") % 2 == 0, 0.0).when(F.col("id") % 3 == 0, -0.0).otherwise(float("nan")).alias("z"), F.lit(None).cast("int").alias("n"))
    got = FE.adaptive_bucket_count(df, ["x", "s", "z", "n", "absent"], exact=True)
    assert got.schema.simpleString() == "struct<column_name:string,n_distinct:bigint,n_buckets:int>"
    assert sorted(map(tuple, got.collect())) == [("n", 1, 3), ("s", 40, 10), ("x", 3000, 10), ("z", 2, 3)]
    assert sorted(map(tuple, FE.adaptive_bucket_count(df.limit(0), ["x", "n"], exact=True).collect())) == [("n", 0, 3), ("x", 0, 3)]


def test_adaptive_bucket_count_query_counts_all_values(spark, tmp_path):
    import datetime as dt

    from __spark_entry__ import queries
    spark.createDataFrame([(i, i % 30, "PFO"[i % 3], 10.0 + i, dt.datetime(2020, 1 + i % 11, 1), "1") for i in range(1, 400)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.column_name: (r.n_distinct, r.n_buckets) for r in queries()["adaptive_bucket_count"](spark, str(tmp_path)).collect()}
    assert got == {"num_a": (399 - 57 + 1, 10), "code": (11, 10), "month": (11, 10), "yn": (4, 3), "status": (3, 3)}


def test_quantile_bins_invariants(spark):
    n = norm_obs(spark, SF001)
    b = FE.quantile_bins(train_of(n), n, ["num_a", "num_b"], {"num_a": 4, "num_b": 3})
    mx = b.agg(F.max("num_a_bin"), F.max("num_b_bin")).first()
    assert mx[0] <= 3 and mx[1] <= 2
    assert b.filter(F.col("num_a").isNull() != F.col("num_a_bin").isNull()).count() == 0
    # bins are monotone in the value
    bad = b.filter("num_a is not null").groupBy("num_a_bin").agg(F.min("num_a").alias("lo"), F.max("num_a").alias("hi"))
    r = sorted((x.num_a_bin, x.lo, x.hi) for x in bad.collect())
    assert all(r[i][2] <= r[i + 1][1] for i in range(len(r) - 1))


def test_feature_model_end_to_end(spark):
    n = norm_obs(spark, SF001)
    c = CleaningModel.fit(train_of(n), OBS_SPEC).transform(n)
    tr = train_of(c)
    fm = FeatureModel.fit(tr, OBS_FEATURES)
    out = fm.transform(c)
    assert out.count() == c.count()
    z = fm.transform(tr).select(vector_to_array("features_cont_scaled").alias("z"))
    k = len(z.first().z)
    means = z.select(*[F.avg(F.col("z")[i]) for i in range(k)]).first()
    # standardised on train; a feature with a NULL input has a NaN mean (kept, as Spark does)
    assert all(m != m or abs(m) < 1e-9 for m in means) and sum(m == m for m in means) >= 4
    import pytest
    from dataclasses import replace
    with pytest.raises(ValueError):
        FeatureModel.fit(tr, replace(OBS_FEATURES, strict=True))
    lin, nb = fm.frames(c)
    assert lin.columns == ["label", "features"] and nb.count() == c.count()
    labels = {r.status: r.label for r in out.select("status", "label").distinct().collect()}
    counts = {r.status: r["count"] for r in tr.groupBy("status").count().collect()}
    top = sorted(counts, key=lambda s: (-counts[s], s))[0]
    assert labels[top] == 0.0
