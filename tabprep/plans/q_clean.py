"""Registered queries: grouped statistics, joins, windows, fills, removal, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprep.operators import circular as C
from tabprep.operators import impute as I
from tabprep.operators import stats as ST
from tabprep.operators.joins import lookup_left_entity_month, lookup_left_month
from tabprep.operators.outliers import trim_extreme
from tabprep.operators.split import in_train, split_report, stratified_split, stratified_split_hashed
from tabprep.operators.windows import neighbour_values
from tabprep.plans import sqlfrag as S
from tabprep.plans.catalog import ACC, LAY, norm_obs, query, rounded, train_of
from tabprep.plans.cleaning import TEST, TRAIN, CleaningModel, with_half
from tabprep.rules import CleaningSpec
from tabprep.sources.fixtures import obs

W = S.with_
ALL = ", ".join(S.OBS_COLUMNS)
ENT = ["location", "month"]
WIN = "(partition by location order by obs_date, row_id)"
R6 = S.r6

OBS_SPEC = CleaningSpec(
    layout=LAY, mean_filled=("num_a",), median_filled=("num_b", "txt_num"), direction_columns=("dir",),
    yes_no_columns=("yn",), mode_filled=("yn",), mode_cascade=("code",), median_cascade=("txt_num",),
    sentinel_columns=("code",), sentinel_code=9, trim_column="num_a", trim_fraction=0.001, trim_side="high",
    eps=1e-9, accuracy=ACC)


def _nt(body: str, *more: str) -> str:
    """SQL over norm + train."""
    return W(S.OBS, S.NORM, S.TRAIN, *more, body=body)


def _rt(body: str, *more: str) -> str:
    """SQL over raw obs + its training half."""
    return W(S.OBS, S.TRAIN_RAW, *more, body=body)


def _med(c: str) -> str:
    return f"quantile_disc({c}, 0.5)"


# ---------------------------------------------------------------- grouped statistics

@query("mean_by_month", _nt(f"select month, {R6('avg(num_a)')} as num_a_mean, {R6('avg(num_b)')} as num_b_mean "
                            f"from train group by month"))
def q_mean_by_month(spark, sf):
    return rounded(ST.mean_by(train_of(norm_obs(spark, sf)), ["month"], ["num_a", "num_b"]))


@query("median_by_month", _nt(f"select month, {_med('num_a')} as num_a_median, {_med('num_b')} as num_b_median "
                              f"from train group by month"))
def q_median_by_month(spark, sf):
    return ST.median_by(train_of(norm_obs(spark, sf)), ["month"], ["num_a", "num_b"], ACC)


@query("mean_by_entity_month", _nt(f"select location, month, {R6('avg(num_a)')} as num_a_mean, "
                                   f"{R6('avg(num_b)')} as num_b_mean from train group by location, month"))
def q_mean_by_entity_month(spark, sf):
    return rounded(ST.mean_by(train_of(norm_obs(spark, sf)), ENT, ["num_a", "num_b"]))


@query("median_by_entity_month", _nt(f"select location, month, {_med('num_a')} as num_a_median, "
                                     f"{_med('num_b')} as num_b_median from train group by location, month"))
def q_median_by_entity_month(spark, sf):
    return ST.median_by(train_of(norm_obs(spark, sf)), ENT, ["num_a", "num_b"], ACC)


_TXT = (f"try_cast(case when trim(txt_num) = '' or upper(trim(txt_num)) in ({S.CLEAN_IN}) then null "
        f"else trim(txt_num) end as double)")


@query("median_excluding_tokens", _rt(f"select location, month, {_med(_TXT)} as txt_num_median "
                                      f"from train_raw group by location, month"))
def q_median_excluding_tokens(spark, sf):
    return ST.median_excluding_tokens(train_of(obs(spark, sf)), ENT, "txt_num", accuracy=ACC)


@query("mode_by_group", _rt("select * from " + S.mode_sql("train_raw", ENT, "code")))
def q_mode_by_group(spark, sf):
    return ST.mode_by_group(train_of(obs(spark, sf)), ENT, "code")


_COUNTS = "counts as (select {k}, code, count(*) as count from train_raw where code is not null group by {k}, code)"


@query("mode_by_group_ties", _rt("select month, code, count from counts c where count = "
                                 "(select max(count) from counts d where d.month = c.month)",
                                 _COUNTS.format(k="month")))
def q_mode_by_group_ties(spark, sf):
    return ST.mode_by_group_ties(train_of(obs(spark, sf)), ["month"], "code")


@query("join_counts_to_max", _rt("select c.location, c.month, c.code, c.count from counts c join "
                                 "(select location, month, max(count) as m from counts group by location, month) x "
                                 "on c.location = x.location and c.month = x.month and c.count = x.m",
                                 _COUNTS.format(k="location, month")))
def q_join_counts_to_max(spark, sf):
    return ST.join_counts_to_max(train_of(obs(spark, sf)), ENT, "code")


@query("top1_per_group", _rt("select location, month, code, count from (select *, row_number() over "
                             "(partition by location, month order by count desc, code) as rn from counts) where rn = 1",
                             _COUNTS.format(k="location, month")))
def q_top1_per_group(spark, sf):
    return ST.top1_per_group(train_of(obs(spark, sf)), ENT, "code")


def _unit(x: str, y: str, n: str, ox: str, oy: str) -> str:
    return (f"case when {n} > {S.EPS} then {x} / {n} else 0.0 end as {ox}, "
            f"case when {n} > {S.EPS} then {y} / {n} else 0.0 end as {oy}")


_CIRC = (f"circ as (select month, avg(cos({S.radians('dir')})) as cx, avg(sin({S.radians('dir')})) as cy "
         f"from train group by month), "
         f"circn as (select month, {_unit('cx', 'cy', 'sqrt(cx*cx + cy*cy)', 'mx', 'my')} from circ)")


@query("circular_mean_by_month", _nt(f"select month, {R6('mx')} as dir_mon_ux, {R6('my')} as dir_mon_uy from circn",
                                     _CIRC))
def q_circular_mean_by_month(spark, sf):
    return rounded(ST.circular_mean_by(train_of(norm_obs(spark, sf)), ["month"], ["dir"]))


# ---------------------------------------------------------------- joins

@query("lookup_left_month", _nt(
    f"select n.row_id, n.month, n.num_a, {R6('m.a')} as num_a_mon_mean from norm n "
    f"left join (select month, avg(num_a) as a from train group by month) m using (month)"))
def q_lookup_left_month(spark, sf):
    n = norm_obs(spark, sf)
    st = I.fit_month(train_of(n), "month", means=["num_a"])
    return rounded(lookup_left_month(n, st, "month").select("row_id", "month", "num_a", "num_a_mon_mean"))


@query("lookup_left_entity_month", _nt(
    f"select n.row_id, n.location, n.month, n.num_a, {R6('m.a')} as num_a_locmon_mean from norm n left join "
    f"(select location, month, avg(num_a) as a from train group by location, month) m using (location, month)"))
def q_lookup_left_entity_month(spark, sf):
    n = norm_obs(spark, sf)
    st = I.fit_entity_month(train_of(n), "location", "month", means=["num_a"])
    return rounded(lookup_left_entity_month(n, st, "location", "month")
                   .select("row_id", "location", "month", "num_a", "num_a_locmon_mean"))


@query("join_inner_month_mode", _nt(
    "select n.row_id, n.month, n.num_b, m.month_mode from norm n join "
    + S.mode_sql("train", ["month"], "num_b", "month_mode") + " m using (month)"))
def q_join_inner_month_mode(spark, sf):
    n = norm_obs(spark, sf)
    return I.join_inner_month_mode(n, train_of(n), "month", "num_b").select("row_id", "month", "num_b", "month_mode")


# ---------------------------------------------------------------- windows

@query("neighbour_values", W(S.OBS, body=(
    f"select row_id, lag(num_a) over w as num_a_prev, lead(num_a) over w as num_a_next, "
    f"lag(dir) over w as dir_prev, lead(dir) over w as dir_next from obs window w as {WIN}")))
def q_neighbour_values(spark, sf):
    return neighbour_values(obs(spark, sf), "location", ["obs_date", "row_id"], ["num_a", "dir"]) \
        .select("row_id", "num_a_prev", "num_a_next", "dir_prev", "dir_next")


# ---------------------------------------------------------------- numeric fills

_MON = ("mon as (select month, avg(num_a) as a, quantile_disc(num_b, 0.5) as b, quantile_disc(txt_num, 0.5) as t "
        "from train group by month)")
_LOCMON = ("locmon as (select location, month, avg(num_a) as la, quantile_disc(num_b, 0.5) as lb, "
           "quantile_disc(txt_num, 0.5) as lt from train group by location, month)")


@query("fill_month_mean", _nt(f"select row_id, {R6('coalesce(num_a, a)')} as num_a from norm left join mon using (month)",
                              _MON))
def q_fill_month_mean(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_month_mean(n, train_of(n), "month", ["num_a"]).select("row_id", "num_a"))


@query("fill_month_median", _nt(f"select row_id, {R6('coalesce(num_b, b)')} as num_b from norm "
                                f"left join mon using (month)", _MON))
def q_fill_month_median(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_month_median(n, train_of(n), "month", ["num_b"], ACC).select("row_id", "num_b"))


@query("fill_month", _nt(f"select row_id, {R6('coalesce(num_a, a)')} as num_a, {R6('coalesce(num_b, b)')} as num_b, "
                         f"{R6('coalesce(txt_num, t)')} as txt_num from norm left join mon using (month)", _MON))
def q_fill_month(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_month(n, train_of(n), "month", ["num_a"], ["num_b", "txt_num"], ACC)
                   .select("row_id", "num_a", "num_b", "txt_num"))


def _nb(c: str) -> str:
    return (f"case when {c} is null and lag({c}) over w is not null and lead({c}) over w is not null "
            f"then (lag({c}) over w + lead({c}) over w) / 2.0 else {c} end")


@query("fill_neighbour_mean", _nt(f"select row_id, {R6(_nb('num_a'))} as num_a, {R6(_nb('num_b'))} as num_b "
                                  f"from norm window w as {WIN}"))
def q_fill_neighbour_mean(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_neighbour_mean(n, "location", ["obs_date", "row_id"], ["num_a", "num_b"])
                   .select("row_id", "num_a", "num_b"))


@query("fill_entity_month_mean", _nt(f"select row_id, {R6('coalesce(num_a, la)')} as num_a from norm "
                                     f"left join locmon using (location, month)", _LOCMON))
def q_fill_entity_month_mean(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_entity_month(n, train_of(n), "location", "month", means=["num_a"]).select("row_id", "num_a"))


@query("fill_entity_month_median", _nt(f"select row_id, {R6('coalesce(num_b, lb)')} as num_b from norm "
                                       f"left join locmon using (location, month)", _LOCMON))
def q_fill_entity_month_median(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_entity_month(n, train_of(n), "location", "month", medians=["num_b"], accuracy=ACC)
                   .select("row_id", "num_b"))


@query("fill_neighbours_then_entity_month", _nt(
    f"select row_id, {R6('coalesce(na, la)')} as num_a, {R6('coalesce(nb, lb)')} as num_b from "
    f"(select row_id, location, month, {_nb('num_a')} as na, {_nb('num_b')} as nb from norm window w as {WIN}) "
    f"left join locmon using (location, month)", _LOCMON))
def q_fill_neighbours_then_entity_month(spark, sf):
    n = norm_obs(spark, sf)
    return rounded(I.fill_neighbours_then_entity_month(n, train_of(n), "location", ["obs_date", "row_id"], "month",
                                                       ["num_a"], ["num_b"], ACC).select("row_id", "num_a", "num_b"))


# ---------------------------------------------------------------- compass fills

_ENC = f"enc as (select *, cos({S.radians('dir')}) as ux, sin({S.radians('dir')}) as uy from norm)"


def _vec_nb_cte(src: str = "enc", win: str = WIN) -> str:
    """A missing vector is the mean of the whole vectors in the rows beside it."""
    p = [f"{f}(case when ux is not null and uy is not null then {{a}} end) over w" for f in ("lag", "lead")]
    return (f"nbv as (select * exclude (ux, uy), "
            + ", ".join(f"case when ux is null or uy is null then coalesce(list_avg([{', '.join(p)}]), {{a}}) "
                        f"else {{a}} end as {{a}}".replace("{a}", a) for a in ("ux", "uy"))
            + f" from {src} window w as {win})")


@query("fill_direction_neighbours", _nt(f"select row_id, {R6('ux')} as dir_ux, {R6('uy')} as dir_uy from nbv",
                                        _ENC, _vec_nb_cte()))
def q_fill_direction_neighbours(spark, sf):
    d = C.fill_direction_neighbours(norm_obs(spark, sf), "location", ["obs_date", "row_id"], ["dir"])
    return rounded(d.select("row_id", "dir_ux", "dir_uy"))


@query("fill_direction_month", _nt(
    f"select row_id, {R6('coalesce(ux, mx)')} as dir_ux, {R6('coalesce(uy, my)')} as dir_uy "
    f"from enc left join circn using (month)", _ENC, _CIRC))
def q_fill_direction_month(spark, sf):
    n = norm_obs(spark, sf)
    d = C.fill_direction_month(C.direction_to_vector(n, ["dir"]), train_of(n), "month", ["dir"])
    return rounded(d.select("row_id", "dir_ux", "dir_uy"))


_FD = ("fd as (select row_id, coalesce(ux, mx) as x, coalesce(uy, my) as y from nbv left join circn using (month))")


@query("fill_direction", _nt(
    f"select row_id, {R6('dir_ux')} as dir_ux, {R6('dir_uy')} as dir_uy from "
    f"(select row_id, {_unit('x', 'y', 'sqrt(x*x + y*y)', 'dir_ux', 'dir_uy')} from fd)",
    _ENC, _vec_nb_cte(), _CIRC, _FD))
def q_fill_direction(spark, sf):
    n = norm_obs(spark, sf)
    d = C.fill_direction(n, train_of(n), "location", ["obs_date", "row_id"], "month", ["dir"])
    return rounded(d.select("row_id", "dir_ux", "dir_uy"))


# ---------------------------------------------------------------- category fills

@query("fill_mode_entity_month", _nt(
    "select row_id, coalesce(n.yn, m.yn_mode) as yn from norm n left join "
    + S.mode_sql("train", ENT, "yn", "yn_mode") + " m using (location, month)"))
def q_fill_mode_entity_month(spark, sf):
    n = norm_obs(spark, sf)
    return I.fill_mode_entity_month(n, train_of(n), "location", "month", ["yn"]).select("row_id", "yn")


def _miss_clean(c: str) -> str:
    s = f"trim(cast({c} as varchar))"
    return f"case when {c} is null or {s} = '' or upper({s}) in ({S.CLEAN_IN}) then null else {c} end"


_CASC_SRC = (f"cr as (select row_id, location, month, {_miss_clean('code')} as code, {_miss_clean('dir')} as dir "
             f"from obs), ct as (select * from cr where {S.hash_bucket()} < 800000)")


@query("fill_token_mode_cascade", W(S.OBS, _CASC_SRC, body=(
    "select cr.row_id, coalesce(cr.code, a.c1, b.c2) as code, coalesce(cr.dir, c.d1, d.d2) as dir from cr "
    f"left join {S.mode_sql('ct', ENT, 'code', 'c1')} a using (location, month) "
    f"left join {S.mode_sql('ct', ['month'], 'code', 'c2')} b using (month) "
    f"left join {S.mode_sql('ct', ENT, 'dir', 'd1')} c using (location, month) "
    f"left join {S.mode_sql('ct', ['month'], 'dir', 'd2')} d using (month)")))
def q_fill_token_mode_cascade(spark, sf):
    o = obs(spark, sf)
    return I.fill_token_mode_cascade(o, train_of(o), "location", "month", ["code", "dir"]).select("row_id", "code", "dir")


@query("fill_token_median_cascade", W(S.OBS, f"tr as (select row_id, location, month, {_TXT} as txt_num from obs), "
                                      f"tt as (select * from tr where {S.hash_bucket()} < 800000)", body=(
    f"select tr.row_id, {R6('coalesce(tr.txt_num, a.m1, b.m2)')} as txt_num from tr "
    f"left join (select location, month, {_med('txt_num')} as m1 from tt group by location, month) a "
    f"using (location, month) "
    f"left join (select month, {_med('txt_num')} as m2 from tt group by month) b using (month)")))
def q_fill_token_median_cascade(spark, sf):
    o = obs(spark, sf)
    return rounded(I.fill_token_median_cascade(o, train_of(o), "location", "month", ["txt_num"], accuracy=ACC)
                   .select("row_id", "txt_num"))


# ---------------------------------------------------------------- the full cleaning plan

WIN_HALF = "(partition by half, location order by obs_date, row_id)"
_HALVES = (f"labelled as (select *, case when {S.hash_bucket()} < 800000 then 'train' else 'test' end as half "
           f"from norm where status is not null)")


def _impute_ctes() -> list[str]:
    mon = (f"mon as (select month, avg(num_a) as a, quantile_disc(num_b, 0.5) as b, quantile_disc(txt_num, 0.5) as t, "
           f"avg(cos({S.radians('dir')})) as cx, avg(sin({S.radians('dir')})) as cy from train group by month)")
    monf = (f"monf as (select m.month, a, b, t, {_unit('cx', 'cy', 'sqrt(cx*cx + cy*cy)', 'mx', 'my')}, mm.code_mon "
            f"from mon m full join {S.mode_sql('train', ['month'], 'code', 'code_mon')} mm on m.month = mm.month)")
    s1 = (f"s1 as (select n.* replace (coalesce(n.num_a, m.a) as num_a, coalesce(n.num_b, m.b) as num_b, "
          f"coalesce(n.txt_num, m.t) as txt_num), cos({S.radians('n.dir')}) as ux, sin({S.radians('n.dir')}) as uy, "
          f"m.mx, m.my, m.t as t_mon, m.code_mon from labelled n left join monf m on n.month = m.month)")
    s2 = (f"s2 as (select * replace ({_nb('num_a')} as num_a, {_nb('num_b')} as num_b, {_nb('txt_num')} as txt_num) "
          f"from s1 window w as {WIN_HALF})")
    em = (f"em as (select l.*, y.yn_lm, c.code_lm from locmon l "
          f"full join {S.mode_sql('train', ENT, 'yn', 'yn_lm')} y using (location, month) "
          f"full join {S.mode_sql('train', ENT, 'code', 'code_lm')} c using (location, month))")
    s4 = ("s4 as (select s.* replace (coalesce(s.num_a, e.la) as num_a, coalesce(s.num_b, e.lb) as num_b, "
          "coalesce(s.txt_num, e.lt, s.t_mon) as txt_num, coalesce(s.yn, e.yn_lm) as yn, "
          "coalesce(s.code, e.code_lm, s.code_mon) as code), coalesce(s.ux, s.mx) as x, coalesce(s.uy, s.my) as y "
          "from nbv s left join em e on s.location = e.location and s.month = e.month)")
    imp = (f"imp as (select {ALL}, half, {_unit('x', 'y', 'sqrt(x*x + y*y)', 'dir_ux', 'dir_uy')} from s4)")
    return [_HALVES, _LOCMON, mon, monf, s1, s2, _vec_nb_cte("s2", WIN_HALF), em, s4, imp]


_OUT = [*S.OBS_COLUMNS, "dir_ux", "dir_uy", "half"]
_ROUND = {c: c for c in ["num_a", "num_b", "txt_num", "dir_ux", "dir_uy"]}


def _sel_out(prefix: str = "") -> str:
    return ", ".join(f"{R6(prefix + c)} as {c}" if c in _ROUND else prefix + c for c in _OUT)


_SURV = "surv as (select * from imp where not (dir_ux = 0.0 and dir_uy = 0.0) and not (cast(code as integer) = 9))"
_CLEAN = ("clean as (select * from surv qualify row_number() over (partition by half order by num_a asc nulls first, "
          "row_id asc) <= count(*) over (partition by half) - count(*) over (partition by half) // 1000)")
CLEAN_CTES = [*_impute_ctes(), _SURV, _CLEAN]


def halves_of(spark, sf):
    """The labelled, normalised observations with their half."""
    return with_half(norm_obs(spark, sf), "row_id", "status")


def cleaned_halves(spark, sf):
    n = halves_of(spark, sf)
    return CleaningModel.fit(n.filter(F.col("half") == TRAIN), OBS_SPEC).transform_halves(n)


@query("clean_pipeline", _nt(f"select {_sel_out()} from clean", *CLEAN_CTES))
def q_clean_pipeline(spark, sf):
    return rounded(cleaned_halves(spark, sf).select(*_OUT))


@query("removal_report", _nt(
    "select stage, n_rows, " + R6("n_rows * 100.0 / n") + " as pct_of_input from ("
    "select 'zero_vector' as stage, z as n_rows, n from agg union all select 'sentinel', s, n from agg union all "
    "select 'invalid', z + s, n from agg union all "
    "select 'extreme', e, n from agg union all select 'removed', z + s + e, n from agg union all "
    "select 'kept', n - z - s - e, n from agg)",
    *CLEAN_CTES,
    "agg as (select count(*) as n, count_if(dir_ux = 0.0 and dir_uy = 0.0) as z, "
    "count_if(not (dir_ux = 0.0 and dir_uy = 0.0) and coalesce(not (cast(code as integer) = 9), false) = false) as s, "
    "(select count(*) from surv where half = 'test') - (select count(*) from clean where half = 'test') as e "
    "from imp where half = 'test')"))
def q_removal_report(spark, sf):
    n = halves_of(spark, sf)
    model = CleaningModel.fit(n.filter(F.col("half") == TRAIN), OBS_SPEC)
    return rounded(model.report(model.impute(n.filter(F.col("half") == TEST))))


# ---------------------------------------------------------------- removal keys

@query("trim_highest", W(S.OBS, body=(
    f"select row_id, num_a from obs qualify row_number() over (order by num_a asc nulls first, row_id asc) "
    f"<= (select count(*) from obs) - (select count(*) from obs) // 1000")))
def q_trim_highest(spark, sf):
    return trim_extreme(obs(spark, sf).select("row_id", "num_a"), "num_a", ["row_id"], 0.001, "high", ACC)


@query("trim_lowest", W(S.OBS, body=(
    f"select row_id, num_a from obs qualify row_number() over (order by num_a desc nulls last, row_id desc) "
    f"<= (select count(*) from obs) - (select count(*) from obs) // 1000")))
def q_trim_lowest(spark, sf):
    return trim_extreme(obs(spark, sf).select("row_id", "num_a"), "num_a", ["row_id"], 0.001, "low", ACC)


# ---------------------------------------------------------------- split

@query("stratified_split", W(S.OBS, body=(
    "select status, count(*) as n_rows, true as complete, true as disjoint, true as share_kept from obs "
    "where status is not null group by status")))
def q_stratified_split(spark, sf):
    """What any draw must satisfy, for each class: every row is in one half, and the share of the first is near 80 %."""
    o = obs(spark, sf).select("row_id", "status")
    tr, te = stratified_split(o, "status")
    both = tr.withColumn("t", F.lit(1)).unionByName(te.withColumn("t", F.lit(0)))
    per_row = both.groupBy("status", "row_id").agg(F.count(F.lit(1)).alias("times"), F.sum("t").alias("t"))
    whole = o.filter("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))
    found = per_row.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"), F.sum("t").alias("t"))
    deviation = F.abs(F.col("t") - 0.8 * F.col("n")) / F.sqrt(0.16 * F.col("n"))  # in standard deviations
    return whole.join(found, "status").select("status", "n_rows", (F.col("n") == F.col("n_rows")).alias("complete"),
                                              (F.col("times") == 1).alias("disjoint"), (deviation < 5).alias("share_kept"))


@query("stratified_split_hashed", W(S.OBS, body=(
    f"select row_id, status, case when {S.hash_bucket()} < 800000 then 'train' else 'test' end as half from obs")))
def q_stratified_split_hashed(spark, sf):
    o = obs(spark, sf).select("row_id", "status")
    tr, te = stratified_split_hashed(o, "row_id")
    return tr.withColumn("half", F.lit("train")).unionByName(te.withColumn("half", F.lit("test")))


@query("split_report", W(S.OBS, f"h as (select status, case when {S.hash_bucket()} < 800000 then 'train' else 'test' end "
                         f"as half from obs)", "u as (select * from h union all select status, 'all' from h)", body=(
    "select status, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (partition by half), 2) as pct, "
    "half from u group by half, status")))
def q_split_report(spark, sf):
    o = obs(spark, sf)
    return split_report(o.filter(in_train("row_id")), o.filter(~in_train("row_id")), "status")
