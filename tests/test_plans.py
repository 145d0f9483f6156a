"""Plans, split, features and the DuckDB oracle over the driver tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tabprep.operators.split import stratified_split, stratified_split_hashed
from tabprep.plans.catalog import norm_obs, train_of
from tabprep.plans.cleaning import CleaningModel, with_half
from tabprep.plans.q_clean import OBS_SPEC
from tests.conftest import SF001, rows

TABLES = ["orders", "customer", "lineitem"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9)
    return v


def _cmp(spark_df, con, sql):
    a = sorted((tuple(_norm(x) for x in r) for r in spark_df.collect()), key=repr)
    res = con.sql(sql)
    order = [res.columns.index(c) for c in spark_df.columns]
    b = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    return a, b


ORACLE_KEYS = ["missing_profile", "domain_violations", "range_violations", "quality_summary", "numeric_summary",
               "median_by_entity_month", "mode_by_group", "neighbour_values", "fill_neighbours_then_entity_month",
               "fill_direction", "fill_token_mode_cascade", "fill_token_median_cascade", "clean_pipeline",
               "removal_report", "trim_highest", "trim_lowest", "split_report", "standardize_features",
               "index_label", "scan_csv", "frame_overview"]


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle(spark, duck, key):
    import __spark_entry__ as E
    a, b = _cmp(E.queries()[key](spark, SF001), duck, E.oracle_sql()[key])
    assert len(a) == len(b) and a == b


def test_every_key_has_callable_and_most_have_sql():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert not [k for k in set(q) - set(s) if not k.startswith("op") and k != "pipeline"]


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "dir_ux" in df.columns


def test_fit_uses_reference_only(spark):
    n = norm_obs(spark, SF001)
    tr = train_of(n)
    a = CleaningModel.fit(tr, OBS_SPEC).impute(n)
    # statistics come from the reference, so a frame changed outside it fills the same
    b = CleaningModel.fit(tr, OBS_SPEC).impute(n.unionByName(n.filter("row_id < 10").withColumn("row_id", F.col("row_id") + 10**9)))
    key = ["row_id", "num_a", "num_b", "txt_num", "code", "yn"]
    assert rows(a.filter("month = 5 and num_a is not null"), *key) == \
        rows(b.filter("month = 5 and row_id < 1000000000 and num_a is not null"), *key)


def test_fills_keep_present_values_and_rows(spark):
    n = norm_obs(spark, SF001)
    out = CleaningModel.fit(train_of(n), OBS_SPEC).impute(n)
    assert out.count() == n.count()
    j = n.alias("a").join(out.alias("b"), "row_id")
    for c in ["num_a", "num_b", "txt_num", "yn", "code"]:
        assert j.filter(F.col(f"a.{c}").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).count() == 0
    bad = out.filter(~((F.col("dir_ux") == 0) & (F.col("dir_uy") == 0)) &
                     (F.abs(F.col("dir_ux") ** 2 + F.col("dir_uy") ** 2 - 1) > 1e-9))
    assert bad.count() == 0


def test_partitioning_does_not_change_results(spark):
    n = norm_obs(spark, SF001)
    m = CleaningModel.fit(train_of(n), OBS_SPEC)
    a = m.impute(n).select("row_id", "num_a", "dir_ux")
    b = m.impute(n.repartition(7, "status")).select("row_id", "num_a", "dir_ux")
    assert rows(a) == rows(b)


def test_hashed_split_stable_and_disjoint(spark):
    n = norm_obs(spark, SF001)
    tr, te = stratified_split_hashed(n, "row_id")
    tr2, _ = stratified_split_hashed(n.repartition(5), "row_id")
    assert rows(tr.select("row_id")) == rows(tr2.select("row_id"))
    assert tr.join(te, "row_id").count() == 0 and tr.count() + te.count() == n.count()
    share = tr.count() / n.count()
    assert 0.7 < share < 0.9


def test_random_split_per_class(spark):
    n = norm_obs(spark, SF001)
    tr, te = stratified_split(n, "status", ["F", "O", "P"])
    assert tr.count() + te.count() == n.count()
    for cls in "FOP":
        total = n.filter(F.col("status") == cls).count()
        assert 0.65 < tr.filter(F.col("status") == cls).count() / total < 0.95


def test_test_rows_change_no_training_output(spark):
    n = with_half(norm_obs(spark, SF001), "row_id", "status")
    train, test = n.filter("half = 'train'"), n.filter("half = 'test'")
    model = CleaningModel.fit(train, OBS_SPEC)
    changed = train.unionByName(test.withColumn("num_a", F.lit(1.0)).filter("row_id % 2 = 0"))
    a, b = (model.transform_halves(d).filter("half = 'train'") for d in (n, changed))
    assert rows(a) == rows(b) and a.count() > 0
    alone = model.transform(train)
    assert rows(a) == rows(alone)


def test_hashed_split_fractions_and_null_ids(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 20 != 0, F.col("id")).alias("k"))
    tr, te = stratified_split_hashed(df, "k", 0.995)
    assert tr.count() + te.count() == 20000 and 40 < te.count() < 1300


def test_checkpoint_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from tabprep import session
    conf = SimpleNamespace(get=lambda k, d=None: d)
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))
    written = []
    session.materialize(spark.range(5), "t", written)
    path = written[0].removeprefix("file:")
    import os
    assert os.path.exists(path)
    session.release(spark, written)
    assert not os.path.exists(path) and written == []
