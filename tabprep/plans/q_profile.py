"""Registered queries: sources, predicates, profile, sets, scalar keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprep.functions.compass import direction_to_radians, normalize_xy
from tabprep.functions.missing import is_missing
from tabprep.operators import normalize as N
from tabprep.operators import predicates as P
from tabprep.operators import profile as PR
from tabprep.operators.circular import direction_to_vector, normalize_vectors
from tabprep.operators.outliers import drop_sentinel_codes, drop_zero_vectors
from tabprep.plans import sqlfrag as S
from tabprep.plans.catalog import norm_obs, query, rounded
from tabprep.rules import COMPASS_POINTS, YES_NO_DOMAIN
from tabprep.session import scratch_path
from tabprep.sources.csv import scan_csv, write_csv
from tabprep.sources.fixtures import obs, obs_with_duplicates
from tabprep.sources.overview import first_rows, frame_overview

OBS_SCHEMA = ", ".join(f"{c} {t}" for c, t in zip(S.OBS_COLUMNS, S.OBS_TYPES))
ALL = ", ".join(S.OBS_COLUMNS)
RANGES = {"num_a": (0.0, 400000.0), "num_b": (0.0, 40000.0), "txt_num": (1000.0, 450000.0), "code": (0.0, 8.0)}
DOMAINS = {"dir": list(COMPASS_POINTS), "yn": list(YES_NO_DOMAIN)}
W = S.with_


def _sql_obs(body: str, *more: str) -> str:
    return W(S.OBS, *more, body=body)


# ---------------------------------------------------------------- sources

@query("scan_csv", _sql_obs(f"select {ALL} from obs"))
def q_scan_csv(spark, sf):
    path = scratch_path(spark, "obs-csv")
    write_csv(obs(spark, sf), path)
    return scan_csv(spark, path, schema=OBS_SCHEMA)


@query("scan_csv_inferred", _sql_obs(f"select {ALL} from obs"))
def q_scan_csv_inferred(spark, sf):
    """Types come from the data; the columns are then put into the schema's order and widths."""
    path = scratch_path(spark, "obs-csv")
    write_csv(obs(spark, sf), path)
    found = scan_csv(spark, path)
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in zip(S.OBS_COLUMNS, S.OBS_TYPES)])


@query("first_rows", _sql_obs(f"select {ALL} from obs order by row_id limit 5"))
def q_first_rows(spark, sf):
    return first_rows(obs(spark, sf), 5, ["row_id"])


_OVERVIEW_VALUES = ", ".join(f"({i + 1}, '{c}', '{t}')" for i, (c, t) in enumerate(zip(S.OBS_COLUMNS, S.OBS_TYPES)))


@query("frame_overview", _sql_obs(
    f"select v.ordinal, v.column_name, v.data_type, n.n_rows, {len(S.OBS_COLUMNS)} as n_columns "
    f"from (values {_OVERVIEW_VALUES}) v(ordinal, column_name, data_type), "
    f"(select count(*) as n_rows from obs) n"))
def q_frame_overview(spark, sf):
    return frame_overview(obs(spark, sf))


# ---------------------------------------------------------------- predicates

_MISS_COLS = ["num_a", "txt_num", "dir", "yn", "code"]


@query("is_missing", _sql_obs("select row_id, " + ", ".join(f"{S.missing(c)} as missing_{c}" for c in _MISS_COLS)
                              + " from obs"))
def q_is_missing(spark, sf):
    return obs(spark, sf).select("row_id", *[is_missing(c).alias(f"missing_{c}") for c in _MISS_COLS])


@query("complete_rows", _sql_obs(f"select {ALL} from obs where " +
                                 " and ".join(f"not {S.missing(c)}" for c in S.OBS_COLUMNS)))
def q_complete_rows(spark, sf):
    return P.complete_rows(obs(spark, sf))


@query("filter_invalid_domain", _sql_obs(f"select {ALL} from obs where dir is not null and dir not in ({S.COMPASS_IN})"))
def q_filter_invalid_domain(spark, sf):
    return P.filter_invalid_domain(obs(spark, sf), "dir", COMPASS_POINTS)


@query("filter_out_of_range", _sql_obs(f"select {ALL} from obs where num_a is not null and (num_a < 0 or num_a > 400000)"))
def q_filter_out_of_range(spark, sf):
    return P.filter_out_of_range(obs(spark, sf), "num_a", 0.0, 400000.0)


_BAD_DATE = "(date_txt is not null and try_strptime(date_txt, '%Y-%m-%d') is null)"


@query("filter_unparseable_dates", _sql_obs(f"select {ALL} from obs where {_BAD_DATE}"))
def q_filter_unparseable_dates(spark, sf):
    return P.filter_unparseable_dates(obs(spark, sf), "date_txt")


@query("invalid_date_examples", _sql_obs(f"select row_id, date_txt, location from obs where {_BAD_DATE} "
                                         f"order by row_id limit 20"))
def q_invalid_date_examples(spark, sf):
    return P.invalid_date_examples(obs(spark, sf), "date_txt", ["row_id", "date_txt", "location"], ["row_id"])


@query("filter_labelled", _sql_obs(f"select {ALL} from obs where lower(yn) in ('yes', 'no')"))
def q_filter_labelled(spark, sf):
    return P.filter_labelled(obs(spark, sf), "yn")


@query("filter_class", _sql_obs(f"select {ALL} from obs where lower(status) = 'f'"))
def q_filter_class(spark, sf):
    return P.filter_class(obs(spark, sf), "status", "F")


def _vec_sql(src: str = "norm") -> str:
    """dir_ux / dir_uy: cos/sin of the label's angle, re-normalised with eps."""
    x, y = f"cos({S.radians('dir')})", f"sin({S.radians('dir')})"
    n = f"sqrt({x}*{x} + {y}*{y})"
    return (f"vec as (select *, case when {n} > {S.EPS} then {x}/{n} else 0.0 end as dir_ux, "
            f"case when {n} > {S.EPS} then {y}/{n} else 0.0 end as dir_uy from {src})")


@query("drop_zero_vectors", W(S.OBS, S.NORM, _vec_sql(), body=(
    f"select row_id, {S.r6('dir_ux')} as dir_ux, {S.r6('dir_uy')} as dir_uy from vec "
    f"where not (dir_ux = 0.0 and dir_uy = 0.0)")))
def q_drop_zero_vectors(spark, sf):
    v = normalize_vectors(direction_to_vector(norm_obs(spark, sf), ["dir"]), ["dir"])
    return rounded(drop_zero_vectors(v, ["dir"]).select("row_id", "dir_ux", "dir_uy"))


@query("drop_sentinel_codes", _sql_obs(f"select {ALL} from obs where not (cast(code as integer) = 9)"))
def q_drop_sentinel_codes(spark, sf):
    return drop_sentinel_codes(obs(spark, sf), ["code"], 9)


@query("cast_numeric", _sql_obs("select row_id, try_cast(txt_num as double) as txt_num, num_a from obs"))
def q_cast_numeric(spark, sf):
    return N.cast_numeric(obs(spark, sf), ["txt_num", "num_a", "absent"]).select("row_id", "txt_num", "num_a")


_DROP = ["date_txt", "yn", "dir", "absent"]


@query("drop_columns", _sql_obs("select " + ", ".join(c for c in S.OBS_COLUMNS if c not in _DROP) + " from obs"))
def q_drop_columns(spark, sf):
    return N.drop_columns(obs(spark, sf), _DROP)


# ---------------------------------------------------------------- profile

def _profile_rows_sql(src: str, cols: list[str]) -> str:
    parts = [f"select '{c}' as column_name, count_if({S.missing(c)}) as n_missing, count(*) as n_rows from {src}"
             for c in cols]
    return " union all ".join(parts)


@query("missing_profile", _sql_obs(
    "select column_name, n_missing, " + S.r6("n_missing * 100.0 / n_rows") + " as pct_missing from ("
    + _profile_rows_sql("obs", S.OBS_COLUMNS) + ")"))
def q_missing_profile(spark, sf):
    return rounded(PR.missing_profile(obs(spark, sf)))


@query("top_missing", _sql_obs(
    "select column_name, n_missing, " + S.r6("n_missing * 100.0 / n_rows") + " as pct_missing from ("
    + _profile_rows_sql("obs", S.OBS_COLUMNS) + ") order by n_missing desc, column_name limit 5"))
def q_top_missing(spark, sf):
    return rounded(PR.top_missing(obs(spark, sf), 5))


_ALL_PRESENT = " and ".join(f"not {S.missing(c)}" for c in S.OBS_COLUMNS)


@query("completeness", _sql_obs(
    f"select n_rows, n_complete, n_rows - n_complete as n_incomplete, "
    f"{S.r6('n_complete * 100.0 / n_rows')} as pct_complete, "
    f"{S.r6('(n_rows - n_complete) * 100.0 / n_rows')} as pct_incomplete "
    f"from (select count(*) as n_rows, count_if({_ALL_PRESENT}) as n_complete from obs)"))
def q_completeness(spark, sf):
    return rounded(PR.completeness(obs(spark, sf)))


@query("distinct_values", _sql_obs(
    "select distinct 'dir' as column_name, dir as value from obs where dir is not null union all "
    "select distinct 'yn' as column_name, yn as value from obs where yn is not null"))
def q_distinct_values(spark, sf):
    return PR.distinct_values(obs(spark, sf), ["dir", "yn"])


def _domain_sql() -> str:
    parts = []
    for c, dom in DOMAINS.items():
        parts.append(
            f"select '{c}' as column_name, count(distinct {c}) filter (where {c} not in ({S.q(dom)})) as n_invalid_values, "
            f"count_if({c} is not null and {c} not in ({S.q(dom)})) as n_rows_affected from obs")
    return ("select column_name, n_invalid_values, n_rows_affected, n_invalid_values = 0 as ok from ("
            + " union all ".join(parts) + ")")


@query("domain_violations", _sql_obs(_domain_sql()))
def q_domain_violations(spark, sf):
    return PR.domain_violations(obs(spark, sf), DOMAINS)


def _range_sql() -> str:
    parts, cnt = [], []
    for c, (lo, hi) in RANGES.items():
        x = f"try_cast({c} as double)"
        e = f"count_if({x} is not null and ({x} < {lo} or {x} > {hi}))"
        parts.append(f"select '{c}' as column_name, {lo}::double as min_value, {hi}::double as max_value, "
                     f"{e} as n_out_of_range from obs")
        cnt.append(e)
    return ("select r.*, t.total_out_of_range from (" + " union all ".join(parts) + ") r, "
            "(select cast(" + " + ".join(cnt) + " as bigint) as total_out_of_range from obs) t")


@query("range_violations", _sql_obs(_range_sql()))
def q_range_violations(spark, sf):
    return PR.range_violations(obs(spark, sf), RANGES)


@query("invalid_date_count", _sql_obs(f"select count_if({_BAD_DATE}) as n_invalid_dates from obs"))
def q_invalid_date_count(spark, sf):
    return PR.invalid_date_count(obs(spark, sf), "date_txt")


@query("date_span", _sql_obs("select min(try_strptime(date_txt, '%Y-%m-%d'))::date as first_date, "
                             "max(try_strptime(date_txt, '%Y-%m-%d'))::date as last_date from obs"))
def q_date_span(spark, sf):
    return PR.date_span(obs(spark, sf), "date_txt", "yyyy-MM-dd")


@query("value_frequency", _sql_obs("select yn as value, count(*) as frequency from obs group by yn"))
def q_value_frequency(spark, sf):
    return PR.value_frequency(obs(spark, sf), "yn")


@query("boolean_shares", _sql_obs(
    "select 'yn' as column_name, n as n_non_null, " + S.r6("t * 100.0 / n") + " as pct_true, "
    + S.r6("f * 100.0 / n") + " as pct_false, " + S.r6("(n - t - f) * 100.0 / n") + " as pct_other from ("
    "select count(yn) as n, count_if(lower(yn) in ('true', 'yes', '1')) as t, "
    "count_if(lower(yn) in ('false', 'no', '0')) as f from obs)"))
def q_boolean_shares(spark, sf):
    return rounded(PR.boolean_shares(obs(spark, sf), ["yn"]))


@query("duplicate_count", W(S.OBS, S.DUP, body=(
    "select n_rows, n_unique, n_rows - n_unique as n_duplicates, "
    + S.r6("(n_rows - n_unique) * 100.0 / n_rows") + " as pct_duplicates from ("
    f"select (select count(*) from dup) as n_rows, (select count(*) from (select distinct * from dup)) as n_unique)")))
def q_duplicate_count(spark, sf):
    return rounded(PR.duplicate_count(obs_with_duplicates(spark, sf)))


@query("duplicate_groups", W(S.OBS, S.DUP, body=(
    f"select {ALL}, count(*) as n_copies from dup group by all having count(*) > 1 "
    f"order by n_copies desc, row_id limit 5")))
def q_duplicate_groups(spark, sf):
    return PR.duplicate_groups(obs_with_duplicates(spark, sf), 5)


@query("drop_exact_duplicates", W(S.OBS, S.DUP, body=f"select distinct {ALL} from dup"))
def q_drop_exact_duplicates(spark, sf):
    return PR.drop_exact_duplicates(obs_with_duplicates(spark, sf))


_NUM = ["num_a", "num_b", "txt_num", "code"]


def _wide_sql() -> str:
    parts = []
    for c in _NUM:
        x = f"try_cast({c} as double)"
        parts += [f"min({x}) as {c}_min", f"max({x}) as {c}_max", f"{S.r6(f'avg({x})')} as {c}_mean",
                  f"{S.r6(f'stddev_samp({x})')} as {c}_stddev"]
    return "select " + ", ".join(parts) + " from obs"


@query("numeric_summary_wide", _sql_obs(_wide_sql()))
def q_numeric_summary_wide(spark, sf):
    return rounded(PR.numeric_summary_wide(obs(spark, sf), _NUM))


def _long_sql() -> str:
    parts = []
    for c in _NUM:
        x = f"try_cast({c} as double)"
        parts.append(f"select '{c}' as attribute, coalesce(min({x}), 'NaN'::double) as minimum, "
                     f"coalesce(max({x}), 'NaN'::double) as maximum, "
                     f"{S.r6(f'coalesce(avg({x}), {chr(39)}NaN{chr(39)}::double)')} as mean, "
                     f"{S.r6(f'coalesce(stddev_samp({x}), {chr(39)}NaN{chr(39)}::double)')} as stddev from obs")
    return " union all ".join(parts)


@query("numeric_summary", _sql_obs(_long_sql()))
def q_numeric_summary(spark, sf):
    return rounded(PR.numeric_summary(obs(spark, sf), _NUM))


@query("distinct_count_per_column", _sql_obs(" union all ".join(
    f"select '{c}' as column_name, count(distinct {c}) as n_distinct from obs"
    for c in ["location", "dir", "yn", "code", "status", "month"])))
def q_distinct_count_per_column(spark, sf):
    return PR.distinct_count_per_column(obs(spark, sf), ["location", "dir", "yn", "code", "status", "month"])


def _row_issue_sql(src: str) -> str:
    rng = " + ".join(
        f"(case when try_cast({c} as double) is not null and (try_cast({c} as double) < {lo} "
        f"or try_cast({c} as double) > {hi}) then 1 else 0 end)" for c, (lo, hi) in RANGES.items())
    return (f"select count(*) as n_rows, (select count(*) from (select distinct * from {src})) as n_unique, "
            f"count_if({_ALL_PRESENT}) as n_complete, count_if({_BAD_DATE}) as n_bad_dates, "
            f"sum({rng}) as n_out_of_range from {src}")


_SCORE = "(n_complete * 100.0 / n_rows) * (1.0 - (n_rows - n_unique) / n_rows)"


@query("quality_score", W(S.OBS, S.DUP, body=f"select {S.r6(_SCORE)} as quality_score from ({_row_issue_sql('dup')})"))
def q_quality_score(spark, sf):
    return rounded(PR.quality_score(obs_with_duplicates(spark, sf)))


@query("quality_summary", W(S.OBS, S.DUP, f"c as ({_row_issue_sql('dup')})", body=(
    f"select 'quality_score' as issue, {S.r6(_SCORE)} as value from c union all "
    f"select 'incomplete_rows', cast(n_rows - n_complete as double) from c union all "
    f"select 'duplicate_rows', cast(n_rows - n_unique as double) from c union all "
    f"select 'invalid_dates', cast(n_bad_dates as double) from c where n_bad_dates > 0 union all "
    f"select 'out_of_range_values', cast(n_out_of_range as double) from c where n_out_of_range > 0")))
def q_quality_summary(spark, sf):
    return rounded(PR.quality_summary(obs_with_duplicates(spark, sf), RANGES, "date_txt"))


@query("class_distribution", _sql_obs(
    "select status, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct "
    "from obs group by status"))
def q_class_distribution(spark, sf):
    return PR.class_distribution(obs(spark, sf), "status")


@query("residual_missing", W(S.OBS, S.NORM, S.TRAIN, body=(
    "select 'num_a' as column_name, count_if(coalesce(n.num_a, m.a) is null) as n_missing "
    "from norm n left join (select month, avg(num_a) as a from train group by month) m using (month) union all "
    "select 'num_b', count_if(coalesce(n.num_b, m.b) is null) "
    "from norm n left join (select month, quantile_disc(num_b, 0.5) as b from train group by month) m using (month)")))
def q_residual_missing(spark, sf):
    from tabprep.operators.impute import fill_month
    from tabprep.plans.catalog import ACC, train_of
    n = norm_obs(spark, sf)
    filled = fill_month(n, train_of(n), "month", means=["num_a"], medians=["num_b"], accuracy=ACC)
    return PR.residual_missing(filled, ["num_a", "num_b"])


# ---------------------------------------------------------------- sets

@query("union_by_name", _sql_obs(f"select {ALL} from obs"))
def q_union_by_name(spark, sf):
    o = obs(spark, sf)
    a = o.filter(F.col("status") == "F")
    b = o.filter(F.col("status") != "F").select(*reversed(o.columns))
    return a.unionByName(b)


# ---------------------------------------------------------------- scalar keys

@query("normalize_case_trim", _sql_obs("select row_id, upper(trim(dir)) as dir from obs"))
def q_normalize_case_trim(spark, sf):
    return N.normalize_case_trim(obs(spark, sf), ["dir", "absent"]).select("row_id", "dir")


@query("nullify_tokens", _sql_obs(f"select row_id, case when dir in ({S.CLEAN_IN}) then null else dir end as dir from obs"))
def q_nullify_tokens(spark, sf):
    return N.nullify(obs(spark, sf), ["dir"]).select("row_id", "dir")


@query("standardize_yes_no", _sql_obs(
    "select row_id, case when lower(trim(yn)) = 'yes' then 'Yes' when lower(trim(yn)) = 'no' then 'No' "
    "else yn end as yn from obs"))
def q_standardize_yes_no(spark, sf):
    return N.standardize_yes_no(obs(spark, sf), ["yn"]).select("row_id", "yn")


@query("add_month", _sql_obs("select row_id, try_cast(date_txt as date) as date_txt, "
                             "cast(month(try_cast(date_txt as date)) as integer) as month_txt from obs"))
def q_add_month(spark, sf):
    return N.add_month(obs(spark, sf), "date_txt", "month_txt").select("row_id", "date_txt", "month_txt")


@query("normalize_observations", W(S.OBS, S.NORM, body=f"select {ALL} from norm"))
def q_normalize_observations(spark, sf):
    return norm_obs(spark, sf)


@query("direction_to_radians", _sql_obs(f"select row_id, dir, {S.r6(S.radians('dir'))} as dir_rad from obs"))
def q_direction_to_radians(spark, sf):
    return rounded(obs(spark, sf).select("row_id", "dir", direction_to_radians("dir").alias("dir_rad")))


@query("direction_to_vector", _sql_obs(
    f"select row_id, {S.r6('cos(' + S.radians('dir') + ')')} as dir_ux, "
    f"{S.r6('sin(' + S.radians('dir') + ')')} as dir_uy from obs"))
def q_direction_to_vector(spark, sf):
    return rounded(direction_to_vector(obs(spark, sf), ["dir"]).select("row_id", "dir_ux", "dir_uy"))


def _sum_vec_sql() -> str:
    r1, r2 = S.radians("upper(trim(dir))"), "radians(code * 180.0)"
    x, y = f"(cos({r1}) + cos({r2}))", f"(sin({r1}) + sin({r2}))"
    n = f"sqrt({x}*{x} + {y}*{y})"
    return (f"select row_id, {S.r6(f'case when {n} > {S.EPS} then {x}/{n} else 0.0 end')} as v_ux, "
            f"{S.r6(f'case when {n} > {S.EPS} then {y}/{n} else 0.0 end')} as v_uy from obs")


@query("normalize_vector", _sql_obs(_sum_vec_sql()))
def q_normalize_vector(spark, sf):
    o = obs(spark, sf)
    r1 = direction_to_radians(F.upper(F.trim(F.col("dir"))))
    r2 = F.radians(F.col("code") * 180.0)
    x, y = normalize_xy(F.cos(r1) + F.cos(r2), F.sin(r1) + F.sin(r2), 1e-9)
    return rounded(o.select("row_id", x.alias("v_ux"), y.alias("v_uy")))



# ---------------------------------------------------------------- the full profile

_REPORT_NUM = ["num_a", "num_b", "txt_num", "code"]


def _report_sql() -> str:
    cols = S.OBS_COLUMNS
    aggs = ["count(*) as n_rows", f"count_if({_ALL_PRESENT}) as n_complete"]
    aggs += [f"count_if({S.missing(c)}) as miss_{c}" for c in cols]
    for c, (lo, hi) in RANGES.items():
        x = f"try_cast({c} as double)"
        aggs.append(f"count_if({x} is not null and ({x} < {lo} or {x} > {hi})) as rng_{c}")
    d = "try_strptime(date_txt, '%Y-%m-%d')::date"
    aggs += [f"count_if({_BAD_DATE}) as bad_dates", f"min({d}) - date '1970-01-01' as first_date",
             f"max({d}) - date '1970-01-01' as last_date"]
    for c in _REPORT_NUM:
        x = f"try_cast({c} as double)"
        aggs += [f"min({x}) as min_{c}", f"max({x}) as max_{c}", f"avg({x}) as mean_{c}", f"stddev_samp({x}) as sd_{c}"]
    aggs += ["count(yn) as yn_n", "count_if(lower(yn) in ('true', 'yes', '1')) as yn_t",
             "count_if(lower(yn) in ('false', 'no', '0')) as yn_f"]
    rows = [("rows", None, "n_rows", "n_rows"), ("completeness", None, "n_complete", "n_complete"),
            ("completeness", None, "pct_complete", "n_complete * 100.0 / n_rows")]
    rows += [("missing", c, "n_missing", f"miss_{c}") for c in cols]
    rows += [("missing", c, "pct_missing", f"miss_{c} * 100.0 / n_rows") for c in cols]
    rows += [("range", c, "n_out_of_range", f"rng_{c}") for c in RANGES]
    rows += [("dates", "date_txt", m, m) for m in ("bad_dates", "first_date", "last_date")]
    for c in _REPORT_NUM:
        rows += [("statistics", c, m, f"coalesce({k}_{c}, 'NaN'::double)")
                 for m, k in (("minimum", "min"), ("maximum", "max"), ("mean", "mean"), ("stddev", "sd"))]
    rows += [("booleans", "yn", "n_non_null", "yn_n"), ("booleans", "yn", "pct_true", "yn_t * 100.0 / yn_n"),
             ("booleans", "yn", "pct_false", "yn_f * 100.0 / yn_n"),
             ("booleans", "yn", "pct_other", "(yn_n - yn_t - yn_f) * 100.0 / yn_n")]

    def sel(sec, col, met, expr, src):
        c = "null::varchar" if col is None else f"'{col}'"
        return f"select '{sec}' as section, {c} as column_name, '{met}' as metric, {S.r6(f'cast({expr} as double)')} as value from {src}"
    parts = [sel(*r, "one") for r in rows]
    parts += [sel("duplicates", None, "n_unique", "u", "dd"), sel("duplicates", None, "n_duplicates", "n - u", "dd")]
    dom = _domain_sql()
    parts += [sel("domain", None, m, m, "dv").replace("null::varchar as column_name", "column_name")
              for m in ("n_invalid_values", "n_rows_affected")]
    return W(S.OBS, f"one as (select {', '.join(aggs)} from obs)",
             "dd as (select (select count(*) from obs) as n, (select count(*) from (select distinct * from obs)) as u)",
             f"dv as ({dom})", body=" union all ".join(parts))


@query("quality_report", _report_sql())
def q_quality_report(spark, sf):
    return rounded(PR.profile_report(obs(spark, sf), RANGES, DOMAINS, ["yn"], "date_txt", _REPORT_NUM))
