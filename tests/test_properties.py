"""Property tests (hypothesis): the skew-safe forms equal their literal forms."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabprep.operators.outliers import trim_extreme
from tabprep.operators.windows import neighbour_values
from tabprep.plans.catalog import norm_obs, train_of
from tabprep.plans.cleaning import CleaningModel
from tabprep.plans.q_clean import OBS_SPEC
from tests.conftest import SF001, rows

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

panel_rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 400),
                                st.one_of(st.none(), st.floats(-5, 5, allow_nan=False))), min_size=1, max_size=60)


@SETTINGS
@given(panel_rows)
def test_bucketed_neighbours_equal_plain(spark, data):
    base = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(i, e, base + dt.timedelta(days=d), x) for i, (e, d, x) in enumerate(data)],
                               "id long, e string, d date, x double")
    cols = ["id", "x_prev", "x_next"]
    plain = neighbour_values(df, "e", ["d", "id"], ["x"], bucket=None)
    for bucket in ("auto", "range"):
        assert rows(neighbour_values(df, "e", ["d", "id"], ["x"], bucket=bucket), *cols) == rows(plain, *cols)


def test_neighbours_with_ties_and_a_hot_entity_day(spark):
    """Nine tenths of the rows share an entity and a day, and the order has ties: links stay mutual, and with the id in the
    order they are those of the plain form."""
    base = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(i, "hot" if i % 10 else f"e{i % 3}", base + dt.timedelta(days=0 if i % 10 else i % 40), float(i))
                                for i in range(3000)], "id long, e string, d date, x double").repartition(7)
    cols = ["id", "x_prev", "x_next"]
    for bucket in ("auto", "range"):
        tied = neighbour_values(df, "e", ["d"], ["id"], bucket=bucket).select("id", "id_prev", "id_next").collect()
        after = {r.id: r.id_next for r in tied}
        assert all(r.id_prev is None or after[r.id_prev] == r.id for r in tied)
        assert sum(r.id_prev is None for r in tied) == sum(r.id_next is None for r in tied) == 4
        assert rows(neighbour_values(df, "e", ["d", "id"], ["x"], bucket=bucket), *cols) == \
            rows(neighbour_values(df, "e", ["d", "id"], ["x"], bucket=None), *cols)


def test_max_gap_days(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1), 1.0), (2, "a", dt.date(2020, 1, 2), 2.0),
                                (3, "a", dt.date(2020, 1, 9), 3.0)], "id int, e string, d date, x double")
    got = rows(neighbour_values(df, "e", ["d"], ["x"], max_gap_days=3), "id", "x_prev", "x_next")
    assert got == [(1, None, 2.0), (2, 1.0, None), (3, None, None)]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 15)), min_size=1, max_size=60))
def test_saturating_bucket_counts(spark, values):
    from tabprep.operators.features import adaptive_bucket_count, bucket_counts
    df = spark.createDataFrame([(v, None if v is None else float(v), str(v)) for v in values], "a long, b double, c string")
    d = len(set(values))
    want = {c: (min(d, 12), min(10, max(3, d - 1))) for c in "abc"}
    assert {r.column_name: (r.n_distinct, r.n_buckets) for r in adaptive_bucket_count(df, ["a", "b", "c"]).collect()} == want
    assert bucket_counts(df.repartition(3), ["a", "b", "c"]) == {c: n for c, (_, n) in want.items()}


def test_saturating_distinct_around_the_limit(spark):
    """For every number of values near the limit, and for many draws of them, the rough pass clears no column of few values."""
    from tabprep.operators.features import saturating_distinct
    for k in range(4):
        df = spark.range(500, numPartitions=2).select(*[F.xxhash64(F.lit(d * 100 + k), F.col("id") % d).alias(f"c{d}") for d in (1, 10, 11, 12, 13, 14, 40)])
        assert saturating_distinct(df, df.columns, 12) == {c: min(12, int(c[1:])) for c in df.columns}
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert saturating_distinct(zeros, ["x", "absent"], 12) == {"x": 3}


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 20)), min_size=1, max_size=400),
       st.sampled_from(["high", "low"]), st.sampled_from([0.01, 0.05, 0.2]))
def test_trim_equals_sort(spark, values, side, fraction):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, v double")
    n = len(values)
    k = int(n * fraction + 1e-9)
    if side == "high":
        keep = df.orderBy(F.col("v").asc_nulls_first(), "id").limit(n - k)
    else:
        keep = df.orderBy(F.col("v").desc_nulls_last(), F.col("id").desc()).limit(n - k)
    assert rows(trim_extreme(df, "v", ["id"], fraction, side)) == rows(keep)


def test_column_order_does_not_matter(spark):
    n = norm_obs(spark, SF001)
    m = CleaningModel.fit(train_of(n), OBS_SPEC)
    cols = ["row_id", "num_a", "num_b", "txt_num", "yn", "code", "dir_ux", "dir_uy"]
    a = m.impute(n).select(*cols)
    b = m.impute(n.select(*reversed(n.columns))).select(*cols)
    assert rows(a) == rows(b)
