"""The weather presets end to end on a literal weather-shaped frame (23 columns)."""

import datetime as dt

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabprep.operators import profile as PR
from tabprep.operators.split import stratified_split
from tabprep.plans.cleaning import CleaningModel, normalize_for
from tabprep.plans.features import FeatureModel, FeatureSpec
from tabprep.rules import (COMPASS_POINTS, DIRECTION_COLUMNS, NUMERIC_COLUMNS, RANGES, WEATHER, YES_NO_COLUMNS,
                           YES_NO_DOMAIN)

COLS = ["Date", "Location", "MinTemp", "MaxTemp", "Rainfall", "Evaporation", "Sunshine", "WindGustDir",
        "WindGustSpeed", "WindDir9am", "WindDir3pm", "WindSpeed9am", "WindSpeed3pm", "Humidity9am", "Humidity3pm",
        "Pressure9am", "Pressure3pm", "Cloud9am", "Cloud3pm", "Temp9am", "Temp3pm", "RainToday", "RainTomorrow"]


def _row(i, loc):
    d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
    na = (lambda v, k: "NA" if (i + k) % 11 == 0 else str(v))
    dirs = COMPASS_POINTS
    return (d.isoformat() if i != 17 else "2020-02-30x", loc,
            na(10 + i % 7, 1), na(20 + i % 9, 2), na(i % 5 * 0.4, 3), na(i % 13 + 0.5, 4), na(i % 10, 5),
            dirs[i % 16] if i % 9 else ("NA" if i % 2 else " ne "), na(30 + i % 20, 6),
            dirs[(i * 3) % 16] if i % 7 else None, dirs[(i * 5) % 16] if i % 8 else "?", na(5 + i % 10, 7),
            na(8 + i % 12, 8), na(50 + i % 40, 9), na(30 + i % 50, 10), na(1010 + i % 9, 2), na(1008 + i % 8, 3),
            na(i % 10, 4) if i % 23 else "9", na((i * 7) % 9, 5), na(15 + i % 6, 6), na(22 + i % 5, 7),
            ["Yes", "No", " no", "NA"][i % 4], ["No", "Yes", "No", "No", "yes"][i % 5])


@pytest.fixture(scope="module")
def weather(spark):
    data = [_row(i, loc) for loc in ("Loc1", "Loc2") for i in range(70)]
    data.append(data[5])  # an exact duplicate
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in COLS))


def test_profile_presets(weather):
    rep = PR.profile_report(weather, RANGES, {**{c: YES_NO_DOMAIN for c in YES_NO_COLUMNS},
                                              **{c: COMPASS_POINTS for c in DIRECTION_COLUMNS}},
                            YES_NO_COLUMNS, "Date", NUMERIC_COLUMNS)
    got = {(r.section, r.column_name, r.metric): r.value for r in rep.collect()}
    assert got[("rows", None, "n_rows")] == 141 and got[("duplicates", None, "n_duplicates")] == 1
    assert got[("dates", "Date", "bad_dates")] == 2
    assert got[("domain", "WindGustDir", "n_invalid_values")] == 2  # "NA" and " ne "
    assert got[("range", "Cloud9am", "n_out_of_range")] == 0


def test_clean_and_features_presets(spark, weather):
    n = normalize_for(weather, WEATHER, numeric_text_cols=NUMERIC_COLUMNS, date_format="yyyy-MM-dd")
    n = n.filter(F.col("Date").isNotNull()).dropDuplicates()
    assert n.filter(F.col("RainToday").isin("NA", " no")).count() == 0
    train, test = stratified_split(n, "RainTomorrow", ["yes", "no"])
    model = CleaningModel.fit(train, WEATHER)
    imp = model.impute(test)
    assert imp.count() == test.count()
    # only columns whose month has no training value at all may stay NULL
    assert imp.filter(F.col("MinTemp").isNull()).count() == 0
    clean_train, clean_test = model.transform(train), model.transform(test)
    k = clean_train.count()
    assert k <= train.count()
    for c in DIRECTION_COLUMNS:
        assert clean_train.filter((F.col(f"{c}_ux") == 0) & (F.col(f"{c}_uy") == 0)).count() == 0
    assert clean_train.filter((F.col("Cloud9am").cast("int") == 9) | (F.col("Cloud3pm").cast("int") == 9)).count() == 0
    rep = {r.stage: r.n_rows for r in model.report(imp).collect()}
    assert rep["removed"] + rep["kept"] == test.count() and rep["kept"] == clean_test.count()
    fm = FeatureModel.fit(clean_train, FeatureSpec())
    ft = fm.transform(clean_test)
    assert {"features_cont_raw", "features_cont_scaled", "features_bin", "label"} <= set(ft.columns)
    first = ft.select(vector_to_array("features_bin").alias("b")).first().b
    assert len(first) == 9 + 6 + 2  # bins + direction vectors + cyclic month (D10)
    lin, nb = fm.frames(clean_test)
    assert lin.count() == nb.count() == clean_test.count()
