import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabprep.operators import impute as I
from tabprep.operators import normalize as N
from tabprep.operators import predicates as P
from tabprep.operators import profile as PR
from tabprep.operators import stats as ST
from tabprep.operators.circular import fill_direction
from tabprep.operators.outliers import (drop_sentinel_codes, drop_zero_vectors, removal_report, trim_extreme)
from tabprep.operators.windows import neighbour_values
from tests.conftest import rows

D = dt.date


@pytest.fixture(scope="module")
def panel(spark):
    # two locations; A has a gap in the middle and missing ends, B a month with no value at all
    data = [
        (1, "A", D(2020, 1, 1), 1, None, "N"),
        (2, "A", D(2020, 1, 2), 1, 10.0, "S"),
        (3, "A", D(2020, 1, 3), 1, None, None),
        (4, "A", D(2020, 1, 31), 1, 20.0, "N"),
        (5, "A", D(2020, 2, 1), 2, None, None),
        (6, "A", D(2020, 2, 2), 2, 40.0, "E"),
        (7, "A", D(2020, 3, 5), 3, None, "Q"),
        (8, "B", D(2020, 1, 1), 1, 5.0, "W"),
        (9, "B", D(2020, 4, 1), 4, None, None),
        (10, "B", D(2020, 4, 1), 4, None, "E"),
        (11, None, D(2020, 1, 9), 1, 1.0, "N"),
        (12, None, D(2020, 2, 9), 2, None, "S"),
        (13, None, None, None, 3.0, "E"),
        (14, "B", None, None, 4.0, "N"),
    ]
    return spark.createDataFrame(data, "id long, loc string, d date, m int, x double, dir string")


def test_neighbours_by_range_equal_plain(panel):
    plain = neighbour_values(panel, "loc", ["d", "id"], ["x", "dir"], bucket=None)
    buck = neighbour_values(panel, "loc", ["d", "id"], ["x", "dir"], bucket="range")
    cols = ["id", "x_prev", "x_next", "dir_prev", "dir_next"]
    assert rows(plain, *cols) == rows(buck, *cols)
    for limit in (1, 5, 100):
        assert rows(neighbour_values(panel, "loc", ["d", "id"], ["x", "dir"], rows_per_range=limit), *cols) == rows(plain, *cols)
    got = {r.id: (r.x_prev, r.x_next) for r in buck.collect()}
    assert got[1] == (None, 10.0) and got[4] == (None, None) and got[5] == (20.0, 40.0) and got[8] == (4.0, None) and got[14] == (None, 5.0)


def test_neighbour_fill_only_isolated(panel):
    out = {r.id: r.x for r in I.fill_neighbour_mean(panel, "loc", ["d", "id"], ["x"]).collect()}
    assert out[3] == 15.0 and out[5] == 30.0  # 10/20 and 20/40 around the gaps (bucket edge crossed)
    assert out[1] is None and out[7] is None  # first / last row of an entity keep NULL
    assert out[2] == 10.0  # present values untouched


def test_month_fill_and_empty_month(panel):
    out = I.fill_month(panel, panel, "m", means=["x"])
    got = {r.id: r.x for r in out.collect()}
    assert got[1] == pytest.approx(9.0) and got[9] is None  # April has no value at all
    assert out.count() == panel.count()


def test_entity_month_median(panel):
    out = {r.id: r.x for r in I.fill_entity_month(panel, panel, "loc", "m", medians=["x"]).collect()}
    assert out[1] == 10.0 and out[5] == 40.0 and out[9] is None


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("g", None), ("h", "z")],
                               "k string, v string")
    assert rows(ST.mode_by_group(df, ["k"], "v")) == [("g", "a"), ("h", "z")]
    assert rows(ST.mode_by_group_ties(df, ["k"], "v"), "k", "v", "count") == [("g", "a", 2), ("g", "b", 2), ("h", "z", 1)]
    assert rows(ST.top1_per_group(df, ["k"], "v"), "k", "v", "count") == [("g", "a", 2), ("h", "z", 1)]
    assert rows(ST.top1_per_group(df, ["k"], "v", "window"), "k", "v", "count") == [("g", "a", 2), ("h", "z", 1)]
    assert rows(ST.mode_by_group_ties(df, ["k"], "v", "window"), "k", "v", "count") == \
        rows(ST.mode_by_group_ties(df, ["k"], "v"), "k", "v", "count")
    m = ST.modes_by_group(df.withColumn("n", F.length("v")), ["k"], ["v", "n"])
    assert rows(m) == [("g", "a", 1), ("h", "z", 1)]


def test_modes_numeric_order(spark):
    df = spark.createDataFrame([("g", 10.0), ("g", 9.0)], "k string, v double")
    assert rows(ST.modes_by_group(df, ["k"], ["v"])) == [("g", 9.0)]  # numeric, not text order


def test_circular_fill_opposites(spark):
    df = spark.createDataFrame([(1, "L", D(2020, 1, 1), 1, "N"), (2, "L", D(2020, 1, 2), 1, None),
                                (3, "L", D(2020, 1, 3), 1, "S"), (4, "L", D(2020, 1, 4), 1, None)],
                               "id long, loc string, d date, m int, dir string")
    out = {r.id: (r.dir_ux, r.dir_uy) for r in fill_direction(df, df, "loc", ["d", "id"], "m", ["dir"]).collect()}
    assert out[2] == (0.0, 0.0)  # N and S cancel: norm below eps
    assert out[4][0] == pytest.approx(-1.0)  # one neighbour (S) only
    for x, y in out.values():
        assert (x, y) == (0.0, 0.0) or math.isclose(x * x + y * y, 1.0)


def test_zero_vectors_and_sentinel(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 0.0, 9), (3, 0.0, 1.0, None), (4, 0.6, 0.8, 3)],
                               "id int, a_ux double, a_uy double, c int")
    assert [r.id for r in drop_zero_vectors(df, ["a"]).collect()] == [2, 3, 4]
    assert [r.id for r in drop_zero_vectors(df, ["absent"]).collect()] == [1, 2, 3, 4]
    assert [r.id for r in drop_sentinel_codes(df, ["c"]).collect()] == [1, 4]  # NULL test drops too
    assert [r.id for r in drop_sentinel_codes(df, ["c"], null_is_ok=True).collect()] == [1, 3, 4]


@pytest.mark.parametrize("side", ["high", "low"])
def test_trim_paths_agree_with_sort(spark, side):
    data = [(i, None if i % 7 == 0 else float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, v double")
    k = 3000 // 100
    fast = trim_extreme(df, "v", ["id"], 0.01, side)
    if side == "high":
        keep = df.orderBy(F.col("v").asc_nulls_first(), "id").limit(3000 - k)
    else:
        keep = df.orderBy(F.col("v").desc_nulls_last(), F.col("id").desc()).limit(3000 - k)
    assert rows(fast) == rows(keep)


def test_trim_low_removes_nulls_first(spark):
    df = spark.createDataFrame([(i, None if i < 5 else float(i)) for i in range(1000)], "id long, v double")
    out = trim_extreme(df, "v", ["id"], 0.003, "low")
    assert out.count() == 997 and out.filter("v is null").count() == 2


def test_removal_report_adds_up(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 50 == 0 else 1.0, 0.0, i % 10, float(i)) for i in range(2000)],
                               "id long, a_ux double, a_uy double, c long, v double")
    rep = {r.stage: r.n_rows for r in removal_report(df, ["a"], ["c"], 9, "v", ["id"], 0.001).collect()}
    assert rep["zero_vector"] == 40 and rep["sentinel"] == 200 and rep["extreme"] == (2000 - 40 - 200) // 1000
    assert rep["removed"] + rep["kept"] == 2000


def test_profile_reports(spark):
    df = spark.createDataFrame([(1, "Yes", 5.0, "NA"), (2, "no", None, "x"), (1, "Yes", 5.0, "NA"), (3, None, 7.0, "")],
                               "id int, yn string, v double, t string")
    mp = {r.column_name: r.n_missing for r in PR.missing_profile(df).collect()}
    assert mp == {"id": 0, "yn": 1, "v": 1, "t": 3}
    c = PR.completeness(df).first()
    assert (c.n_rows, c.n_complete) == (4, 0)
    d = PR.duplicate_count(df).first()
    assert (d.n_rows, d.n_unique, d.n_duplicates) == (4, 3, 1)
    dv = {r.column_name: (r.n_invalid_values, r.n_rows_affected, r.ok)
          for r in PR.domain_violations(df, {"yn": ["Yes", "No"], "id": ["1", "2", "3"]}).collect()}
    assert dv == {"yn": (1, 1, False), "id": (0, 0, True)}
    bs = PR.boolean_shares(df, ["yn"]).first()
    assert bs.n_non_null == 3 and bs.pct_true == pytest.approx(200 / 3)
    ns = {r.attribute: r for r in PR.numeric_summary(df.withColumn("z", F.lit(None).cast("double")), ["v", "z"]).collect()}
    assert ns["v"].minimum == 5.0 and math.isnan(ns["z"].mean) and math.isnan(ns["z"].stddev)
    qs = {r.issue: r.value for r in PR.quality_summary(df).collect()}
    assert qs["duplicate_rows"] == 1.0 and "invalid_dates" not in qs


def test_constant_column_stddev_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert PR.numeric_summary(df, ["v"]).first().stddev == 0.0


def test_trim_ties_at_cut(spark):
    # a third of the rows share the top value: the candidates are ~1000 rows, not ~2k
    data = [(i, 100.0 if i % 3 == 0 else float(i % 97)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, v double")
    got = trim_extreme(df, "v", ["id"], 0.01, "high")
    keep = df.orderBy(F.col("v").asc_nulls_first(), "id").limit(3000 - 30)
    assert rows(got) == rows(keep)


@pytest.mark.parametrize("side", ["high", "low"])
def test_trim_removes_the_exact_count_for_any_key(spark, side):
    """Repeated keys, NULL keys and values that are all equal."""
    for value in (lambda i: float(i), lambda i: 1.0, lambda i: None if i % 3 else 2.0):
        df = spark.createDataFrame([(None if i % 5 == 0 else i // 2, value(i)) for i in range(3000)], "k long, v double")
        assert trim_extreme(df, "v", ["k"], 0.001, side).count() == 2997


def test_removal_report_with_repeated_keys(spark):
    df = spark.createDataFrame([(i // 3, 1.0, 0.0, 1, float(i)) for i in range(1000)],
                               "id long, a_ux double, a_uy double, c long, v double")
    rep = {r.stage: r.n_rows for r in removal_report(df, ["a"], ["c"], 9, "v", ["id"], 0.003).collect()}
    assert rep["extreme"] == 3 and rep["removed"] + rep["kept"] == 1000


def test_modes_keep_large_integers(spark):
    big = 9007199254740993
    df = spark.createDataFrame([("a", 1, big, "x"), ("a", 1, big, "y"), ("a", 1, 5, "y")], "e string, m int, n long, s string")
    from tabprep.operators.stats import modes_by_group, modes_by_sets, modes_two_levels
    assert modes_by_group(df, ["e"], ["n", "s"]).first()[1:] == (big, "y")
    assert [r.first()["n_x"] for r in modes_by_sets(df, [["e", "m"], ["m"]], ["n"], ["_x", "_x"])] == [big, big]
    assert {r.n for r in modes_two_levels(df, "e", "m", ["n"]).collect()} == {big}


def _frames(spark):
    ddl = "id long, e string, d date, month int, t string, v double, yn string, b boolean, big long"
    row = (9007199254740993, "a", None, 1, "NA", None, None, None, 9007199254740993)
    return {"empty": spark.createDataFrame([], ddl), "all_null": spark.createDataFrame([tuple([None] * 9)] * 3, ddl),
            "text_na": spark.createDataFrame([row, row], ddl)}


OPERATORS = {
    "missing_profile": lambda d: PR.missing_profile(d), "top_missing": lambda d: PR.top_missing(d),
    "completeness": lambda d: PR.completeness(d), "distinct_values": lambda d: PR.distinct_values(d, ["t", "absent"]),
    "domain_violations": lambda d: PR.domain_violations(d, {"t": ["x"], "big": ["1"]}),
    "range_violations": lambda d: PR.range_violations(d, {"t": (0, 1), "big": (0, 1)}),
    "filter_out_of_range": lambda d: P.filter_out_of_range(d, "t", 0, 1),
    "boolean_shares": lambda d: PR.boolean_shares(d, ["yn", "big"]), "duplicate_count": lambda d: PR.duplicate_count(d),
    "numeric_summary": lambda d: PR.numeric_summary(d, ["v", "t", "big"]), "quality_score": lambda d: PR.quality_score(d),
    "quality_summary": lambda d: PR.quality_summary(d, {"v": (0, 1)}),
    "profile_report": lambda d: PR.profile_report(d, {"v": (0, 1)}, {"t": ["x"]}, ["yn"], None, ["v"]),
    "nullify": lambda d: N.nullify(d, ["t", "big", "v"]),
    "fill_month": lambda d: I.fill_month(d, d, "month", ["v"]),
    "fill_neighbour_mean": lambda d: I.fill_neighbour_mean(d, "e", ["d", "id"], ["v"]),
    "fill_mode": lambda d: I.fill_mode_entity_month(d, d, "e", "month", ["yn", "big"]),
    "trim": lambda d: trim_extreme(d, "v", ["id"], 0.5),
    "removal_report": lambda d: removal_report(d, [], ["big"], 9, "v", ["id"], 0.5),
    # no listed column is present
    "none_missing": lambda d: PR.residual_missing(d, ["absent"]), "none_domain": lambda d: PR.domain_violations(d, {"absent": ["x"]}),
    "none_range": lambda d: PR.range_violations(d, {"absent": (0, 1)}), "none_summary": lambda d: PR.numeric_summary(d, ["absent"]),
    "none_boolean": lambda d: PR.boolean_shares(d, ["absent"], include_boolean_types=False),
    "none_distinct": lambda d: PR.distinct_count_per_column(d, ["absent"]), "none_fill": lambda d: I.fill_month(d, d, "month", ["absent"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_frames(spark, name):
    """An empty frame, all-NULL columns, text with NA and large integers give a result, and absent columns an empty one."""
    for frame, d in _frames(spark).items():
        got = OPERATORS[name](d).collect()
        if name.startswith("none_") and name != "none_fill":
            assert got == [], frame
        if name in ("nullify", "fill_month", "fill_neighbour_mean", "fill_mode", "none_fill"):
            assert len(got) == d.count(), frame
        if name == "fill_mode" and frame == "text_na":
            assert got[0].big == 9007199254740993


def test_boolean_shares_of_numbers(spark):
    r = PR.boolean_shares(spark.createDataFrame([(1.0,), (0.0,), (1.0,), (2.0,)], "x double"), ["x"]).first()
    assert (r.pct_true, r.pct_false, r.pct_other) == (50.0, 25.0, 25.0)


def test_neighbours_beside_columns_with_helper_names(panel):
    clash = {c: F.lit("z") for c in ("__row", "__range", "__place", "__first", "__last", "__k0", "__k0_null", "__p0", "__n0", "__head0",
                                     "__tail0", "__before0", "__after0", "__lo")}
    plain = neighbour_values(panel, "loc", ["d", "id"], ["x"], bucket=None)
    for bucket in ("auto", "range", None):
        got = neighbour_values(panel.withColumns(clash), "loc", ["d", "id"], ["x"], bucket=bucket)
        assert got.columns == [*panel.columns, *clash, "x_prev", "x_next"]
        assert rows(got, "id", "x_prev", "x_next") == rows(plain, "id", "x_prev", "x_next")
        assert set(got.first()[c] for c in clash) == {"z"}


# ---------------------------------------------------------------- medians from mergeable sketches

def _values(spark, sizes, seed=3):
    import random
    rng = random.Random(seed)
    return [(e, m, rng.uniform(-5, 5)) for (e, m), n in sizes.items() for _ in range(n)]


def lower_median(xs):
    return sorted(xs)[(len(xs) - 1) // 2] if xs else None


def test_medians_are_exact_up_to_the_accuracy(spark):
    data = _values(spark, {("a", 1): 301, ("a", 2): 2, ("b", 1): 150, (None, 1): 9, ("b", None): 4})
    df = spark.createDataFrame([*data, ("c", 3, None), ("d", 4, float("nan"))], "e string, m int, v double").repartition(6)
    df = df.withColumn("k", (F.col("v") * 10).cast("int"))
    got = {(r.e, r.m): r.v_median for r in ST.median_by(df, ["e", "m"], ["v"], 1000).collect()}
    assert got == {**{g: lower_median([v for e, m, v in data if (e, m) == g]) for g in {x[:2] for x in data}},
                   ("c", 3): None, ("d", 4): None}
    assert ST.median_by(df, ["e"], ["k"], 1000).schema["k_median"].dataType.simpleString() == "int"
    both = ST.two_level_stats(df.select("e", "m", "v"), "e", "m", {"avg": F.col("v")}, {"mid": F.col("v")}, 1000).collect()
    fine = {(r.e, r.m): r.mid for r in both if r["__g"] == 0}
    assert fine == got
    month = {r.m: (r.mid, r.avg) for r in both if r["__g"] == 1}
    for m in (1, 2, None):
        xs = [v for _, mm, v in data if mm == m]
        assert month[m][0] == lower_median(xs) and month[m][1] == pytest.approx(sum(xs) / len(xs))
    assert month[3] == (None, None)


def test_medians_of_large_groups_keep_their_rank(spark):
    df = spark.range(0, 400_000, numPartitions=8).select((F.col("id") % 2).alias("e"), F.lit(1).alias("m"),
                                                         (F.hash("id") % 1000003).cast("double").alias("v"))
    accuracy = 500
    for r in ST.median_by(df, ["e"], ["v"], accuracy).collect():
        below = df.filter((F.col("e") == r.e) & (F.col("v") <= r.v_median)).count() / 200_000
        assert abs(below - 0.5) < 4 * 2.3 / accuracy ** 0.9
    month = [r for r in ST.two_level_stats(df, "e", "m", {}, {"mid": F.col("v")}, accuracy).collect() if r["__g"] == 1][0]
    assert abs(df.filter(F.col("v") <= month.mid).count() / 400_000 - 0.5) < 4 * 2.3 / accuracy ** 0.9


# ---------------------------------------------------------------- hash-first duplicates

def test_duplicate_groups_with_colliding_hashes(spark, monkeypatch):
    data = [(i % 17, "x" * (i % 5)) for i in range(300)] + [(100 + i, "alone") for i in range(80)] + [(None, None)] * 4
    df = spark.createDataFrame(data, "a int, b string").repartition(5).withColumn("__h", F.lit(1))
    literal = PR.row_groups(df).filter("n_copies > 1").orderBy(F.desc("n_copies"), "a", "b").limit(7).collect()
    hashes = {"own": PR._row_hash, "few": lambda cols: F.pmod(F.hash(*cols), F.lit(11)).cast("long"),
              "one": lambda cols: F.lit(5).cast("long"), "uneven": lambda cols: F.when(F.col("a") < 3, F.lit(0)).otherwise(F.hash(*cols)).cast("long")}
    for name, fn in hashes.items():
        monkeypatch.setattr(PR, "_row_hash", fn)
        assert PR.duplicate_groups(df, 7, order_cols=["a", "b"]).collect() == literal, name
        assert PR.duplicate_count(df).first()[:2] == (384, df.distinct().count()), name
    monkeypatch.setattr(PR, "BROADCAST_HASHES", 2)
    assert PR.duplicate_groups(df, 7, order_cols=["a", "b"]).collect() == literal
    assert PR.duplicate_groups(df.limit(0), 7).collect() == []
    assert PR.duplicate_groups(df.filter("a >= 100"), 7).collect() == []
