import math

import pytest
from pyspark.sql import functions as F

from tabprep.functions.compass import compass_degrees, direction_to_radians, normalize_xy
from tabprep.functions.missing import is_missing, nullify_tokens
from tabprep.operators import normalize as N
from tabprep.operators.normalize import strict_columns
from tabprep.operators.stats import grouped_stats


def test_is_missing_literal_rule(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "NA"), (5, " NA "), (6, "nan"),
                                (7, "None"), (8, "x"), (9, "n/a"), (10, "MISSING")], "id int, v string")
    got = {r.id: r.m for r in df.select("id", is_missing("v").alias("m")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True, 10: True}
    got = {r.id: r.m for r in df.select("id", is_missing("v", trim_tokens=True).alias("m")).collect()}
    assert got[5] is True


def test_is_missing_numeric_column(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, float("nan"))], "id int, v double")
    got = {r.id: r.m for r in df.select("id", is_missing("v").alias("m")).collect()}
    assert got == {1: True, 2: False, 3: True}  # NaN prints as "NaN" -> token "nan"


def test_nullify_tokens_exact(spark):
    df = spark.createDataFrame([("NA",), ("na",), ("-",), ("?",), ("N",)], "v string")
    assert [r.v for r in df.select(nullify_tokens("v").alias("v")).collect()] == [None, "na", None, None, "N"]


def test_compass_table():
    d = compass_degrees()
    assert len(d) == 16 and d["N"] == 0.0 and d["E"] == 90.0 and d["S"] == 180.0 and d["NNW"] == 337.5


def test_direction_radians_unknown_null(spark):
    df = spark.createDataFrame([("E",), ("Q",), (None,), ("ne",)], "d string")
    got = [r.r for r in df.select(direction_to_radians("d").alias("r")).collect()]
    assert math.isclose(got[0], math.pi / 2) and got[1:] == [None, None, None]


def test_normalize_xy_eps(spark):
    df = spark.createDataFrame([(3.0, 4.0), (6.1e-17, 0.0), (None, 1.0)], "x double, y double")
    x, y = normalize_xy(F.col("x"), F.col("y"), 1e-9)
    got = [(r.a, r.b) for r in df.select(x.alias("a"), y.alias("b")).collect()]
    assert got[0] == (0.6, 0.8) and got[1] == (0.0, 0.0) and got[2] == (0.0, 0.0)
    x0, _ = normalize_xy(F.col("x"), F.col("y"), 0.0)
    assert df.select(x0.alias("a")).collect()[1].a == 1.0  # literal rule: tiny norm still normalised


def test_normalize_observations(spark):
    df = spark.createDataFrame(
        [("2020-01-05", " ne ", " yes", "NA"), ("bad", "NA", "NO", " 1.5 "), (None, "?", "NA", "")],
        "Date string, WindGustDir string, RainToday string, Rainfall string")
    out = N.normalize_observations(df, numeric_text_cols=["Rainfall"]).collect()
    assert out[0].WindGustDir == "NE" and out[0].RainToday == "Yes" and out[0].Rainfall is None
    assert out[0].Month == 1 and out[1].Date is None and out[1].Month is None
    assert out[1].WindGustDir is None and out[1].RainToday == "No" and out[1].Rainfall == 1.5
    assert out[2].WindGustDir is None and out[2].RainToday is None and out[2].Rainfall is None


def test_absent_columns_skipped_or_strict(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert N.drop_columns(df, ["zz"]).columns == ["a"]
    assert N.present(df, ["a", "zz"]) == ["a"]
    import pytest
    with pytest.raises(KeyError):
        N.present(df, ["zz"], strict=True)


def test_strict_columns_hold_for_operators(spark):
    df = spark.createDataFrame([("x", 1.0)], "a string, b double")
    calls = [lambda: N.normalize_case_trim(df, ["a", "zz"]), lambda: N.drop_columns(df, ["zz"]), lambda: N.cast_numeric(df, ["a", "zz"]),
             lambda: grouped_stats(df, ["a"], ["b", "zz"]), lambda: grouped_stats(df, ["a"], ["b"], ["zz"])]
    for call in calls:
        call()
        with strict_columns():
            with pytest.raises(KeyError, match="zz"):
                call()
            with strict_columns(False):
                call()
        call()
