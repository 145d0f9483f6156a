"""Physical plans: pushdown, pruning, broadcast only where bounded, no global sort."""

import re

from tabprep.operators import impute as I
from tabprep.operators import predicates as P
from tabprep.operators import profile as PR
from tabprep.operators.outliers import trim_candidates, trim_extreme
from tabprep.operators.windows import neighbour_values
from tabprep.plans.catalog import norm_obs, train_of
from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_and_columns_pruned(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(P.filter_out_of_range(o, "o_totalprice", 0.0, 400000.0).select("o_orderkey", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_totalprice), Or(LessThan(o_totalprice,0.0)" in p
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", p)


def test_missing_profile_is_one_aggregate(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(PR.missing_profile(o))
    assert p.count("Exchange") == 1 and "SinglePartition" in p


def test_month_lookup_broadcast_entity_lookup_unhinted(spark):
    n = norm_obs(spark, SF01)
    m = I.fill_month(n, train_of(n), "month", means=["num_a"])
    assert "BroadcastHashJoin" in plan(m)
    e = I.fill_entity_month(n, train_of(n), "location", "month", means=["num_a"])
    logical = e._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in logical.lower()  # size left to AQE at run time


def test_trim_is_a_filter(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_totalprice")
    cand, k = trim_candidates(o, "o_totalprice", 0.001, "high")
    assert k == 15 and k <= cand.count() <= 6 * k and "GreaterThanOrEqual(o_totalprice" in plan(cand)
    p = plan(trim_extreme(o, "o_totalprice", ["o_orderkey"], 0.001, "high"))
    assert "Join" not in p and "Exchange" not in p


def test_neighbours_do_not_shuffle_by_entity_or_month(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the sort-merge plan of large data
    try:
        p = plan(neighbour_values(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"], bucket="range"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortAggregate" not in p
    assert "orders.parquet" not in p  # the source was read once, for the written table
    lines = p.splitlines()
    assert sum("SortMergeJoin" in ln for ln in lines) == 1
    # the frame and the small table of edges go by (range, entity); nothing else moves the frame
    moved = [ln for ln in lines if "Exchange hashpartitioning" in ln]
    assert len(moved) == 4 and sum("__range" in ln for ln in moved) == 3


def test_domain_violations_without_join(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(PR.domain_violations(o, {"o_orderstatus": ["F", "O"]}))
    assert "Join" not in p
    got = {r.column_name: (r.n_invalid_values, r.ok) for r in PR.domain_violations(o, {"o_orderstatus": ["F", "O"]}).collect()}
    assert got == {"o_orderstatus": (1, False)}


def test_neighbours_of_bounded_entities_shuffle_once(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(neighbour_values(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p
    assert "orders.parquet" not in p  # the source was read once, for the written table


def test_cascades_scan_the_reference_once(spark):
    n = norm_obs(spark, SF01)
    reference = train_of(n)
    seen = lambda d: plan(d).count("orders.parquet")
    for filled in (I.fill_token_mode_cascade(n, reference, "location", "month", ["code", "dir"]),
                   I.fill_token_median_cascade(n, reference, "location", "month", ["txt_num"])):
        # both lookups read the written statistics; the source is scanned for the filled frame alone
        assert seen(filled) == seen(n) and plan(filled).count("cascade-") == 2


def test_imputation_has_two_lookups_and_one_window(spark):
    from tabprep.plans.cleaning import CleaningModel
    from tabprep.plans.q_clean import OBS_SPEC
    n = norm_obs(spark, SF01)
    p = plan(CleaningModel.fit(train_of(n), OBS_SPEC).impute(n))
    # the month lookup runs before the frame is written for the window
    assert p.count("LeftOuter") == 1 and len(re.findall(r"\bWindow \[", p)) == 1


def test_split_report_aggregates_the_frame_once(spark):
    from tabprep.operators.split import split_report
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(split_report(o.filter("o_orderkey % 5 > 0"), o.filter("o_orderkey % 5 = 0"), "o_orderstatus"))
    assert p.count("Expand") == 1 and p.count("HashAggregate") == 2 and p.count("FileScan") == 2  # a scan for each half


def test_scope_deletes_what_operators_and_queries_write(spark):
    import os

    import __spark_entry__ as E
    from tabprep.session import checkpoint_dir, scope
    from tests.conftest import SF001
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    queries = E.queries()
    with scope(spark) as outer:
        for key in ("trim_highest", "trim_lowest", "removal_report", "neighbour_values", "fill_month", "fill_direction", "lookup_left_month",
                    "join_inner_month_mode", "fill_token_mode_cascade", "fill_token_median_cascade", "clean_pipeline", "feature_pipeline",
                    "feature_frames", "duplicate_groups", "quantile_bins"):
            with scope(spark) as own:
                queries[key](spark, SF001).collect()
                made = set(os.listdir(folder)) - before
                assert all(p.split("/")[-1] in made for p in own if os.path.exists(p.removeprefix("file:")))
            assert set(os.listdir(folder)) == before, key
        queries["trim_highest"](spark, SF001).collect()
        assert outer and set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
