"""Quality profile: every report is one distributed pass (plus a shuffle only
where grouping is the point, e.g. duplicates), never one job per column.

Wide one-row aggregates are unfolded into rows with ``inline`` over a literal
array, so the reshaping costs nothing and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tabprep.functions.missing import all_present, is_missing
from tabprep.functions.names import unused
from tabprep.operators.normalize import present
from tabprep.operators.predicates import out_of_range, unparseable_date
from tabprep.rules import DATE_FORMAT, FALSE_SPELLINGS, PROFILE_TOKENS, TRUE_SPELLINGS
from tabprep.session import materialize, release

NAN = float("nan")
#: Row hashes (8 bytes each) that are broadcast after a count.
BROADCAST_HASHES = 1_000_000


def _rows(pairs: list[tuple[str, Column]], name: str = "column_name", value: str = "value") -> Column:
    """Literal array of (name, value) structs, for ``inline`` after a 1-row agg."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias(name), v.alias(value)) for n, v in pairs]))


def _share(part, whole) -> Column:
    """Percent, NULL of nothing."""
    return F.try_divide(part * F.lit(100.0), whole)


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    """The result for no columns."""
    return df.sparkSession.createDataFrame([], ddl)


def _unpivot_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value) rows of the listed columns, values as text."""
    return df.select(_rows([(c, F.col(c).cast("string")) for c in cols]))


# --- missing values -------------------------------------------------------

def missing_profile(df: DataFrame, cols: Iterable[str] | None = None,
                    tokens: Iterable[str] = PROFILE_TOKENS, trim_tokens: bool = False) -> DataFrame:
    """Per column: missing count and % of all rows, most first, in one aggregate."""
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return _empty(df, "column_name string, n_missing long, pct_missing double")
    aggs = [F.sum(is_missing(c, tokens, trim_tokens).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    return (one.select(_rows([(c, F.col(f"m{i}")) for i, c in enumerate(cols)], value="n_missing"), "n_rows")
               .select("column_name", F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
                       _share(F.coalesce("n_missing", F.lit(0)), F.col("n_rows")).alias("pct_missing"))
               .orderBy(F.desc("n_missing"), "column_name"))


def top_missing(df: DataFrame, n: int = 5, cols: Iterable[str] | None = None,
                tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """The ``n`` columns with most missing values (ties by name)."""
    return missing_profile(df, cols, tokens).orderBy(F.desc("n_missing"), "column_name").limit(n)


def residual_missing(df: DataFrame, cols: Iterable[str], tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """Values still missing (NULL, blank or token) per column after a fill."""
    return missing_profile(df, present(df, cols), tokens).select("column_name", "n_missing")


def completeness(df: DataFrame, cols: Iterable[str] | None = None,
                 tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """Complete rows, incomplete rows and their percentages (one row)."""
    ok = all_present(df.columns if cols is None else cols, tokens)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_complete"))
    return one.select(
        "n_rows", "n_complete", (F.col("n_rows") - F.col("n_complete")).alias("n_incomplete"),
        _share(F.col("n_complete"), F.col("n_rows")).alias("pct_complete"),
        _share(F.col("n_rows") - F.col("n_complete"), F.col("n_rows")).alias("pct_incomplete"))


# --- domains --------------------------------------------------------------

def distinct_values(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Distinct non-NULL values of each column, as (column_name, value)."""
    cols = present(df, cols)
    if not cols:
        return _empty(df, "column_name string, value string")
    return _unpivot_strings(df, cols).filter(F.col("value").isNotNull()).distinct()


def _in_domain(domains: Mapping[str, Iterable[str]]) -> Column:
    """(column_name, value) lies in its column's domain: a literal predicate
    (the domain's size is the rule set's, not the data's), no join needed."""
    expr = None
    for c, vs in domains.items():
        t = F.col("column_name") == F.lit(c)
        e = F.col("value").isin(*list(vs))
        expr = F.when(t, e) if expr is None else expr.when(t, e)
    return F.coalesce(expr, F.lit(False)) if expr is not None else F.lit(False)


def domain_violation_values(df: DataFrame, domains: Mapping[str, Iterable[str]]) -> DataFrame:
    """(column_name, value, n_rows) for every non-NULL value outside its domain.

    The domain test runs before the shuffle, so only offending values are
    counted (partial aggregation first)."""
    cols = present(df, domains)
    dom = {c: domains[c] for c in cols}
    if not cols:
        return _empty(df, "column_name string, value string, n_rows long")
    return (_unpivot_strings(df, cols).filter(F.col("value").isNotNull() & ~_in_domain(dom))
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows")))


def _zero_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("string").alias("value"),
                 F.lit(0).cast("long").alias("n_rows")) for c in cols])))


def domain_violations(df: DataFrame, domains: Mapping[str, Iterable[str]]) -> DataFrame:
    """Per column: number of offending distinct values, rows affected, OK flag.

    Columns without violations come from a literal zero row per column that
    joins the second grouping (a union, not a join)."""
    cols = present(df, domains)
    if not cols:
        return _empty(df, "column_name string, n_invalid_values long, n_rows_affected long, ok boolean")
    return (domain_violation_values(df, domains).unionByName(_zero_rows(df, cols)).groupBy("column_name")
            .agg(F.count("value").alias("n_invalid_values"), F.sum("n_rows").cast("long").alias("n_rows_affected"))
            .withColumn("ok", F.col("n_invalid_values") == 0))


# --- ranges and dates -----------------------------------------------------

def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per rule: rows outside [lo, hi] (values cast with ``try_cast``), plus the total."""
    cols = present(df, ranges)
    if not cols:
        return _empty(df, "column_name string, min_value double, max_value double, n_out_of_range long, "
                          "total_out_of_range long")
    one = df.agg(*[F.count_if(out_of_range(c, *ranges[c])).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(float(ranges[c][0])).alias("min_value"),
                              F.lit(float(ranges[c][1])).alias("max_value"), F.col(f"r{i}").alias("n_out_of_range"))
                     for i, c in enumerate(cols)])
    total = sum((F.col(f"r{i}") for i in range(len(cols))), F.lit(0))
    return one.select(F.inline(rows), total.cast("long").alias("total_out_of_range"))


def invalid_date_count(df: DataFrame, col: str, fmt: str = DATE_FORMAT) -> DataFrame:
    return df.agg(F.count_if(unparseable_date(df, col, fmt)).alias("n_invalid_dates"))


def date_span(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """First and last date (text is parsed first; unparseable text ignored)."""
    c = F.col(col)
    d = F.try_to_date(c, fmt) if fmt else c.try_cast("date")
    return df.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"))


# --- frequencies, booleans ------------------------------------------------

def value_frequency(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, NULL included, most frequent first."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))
              .orderBy(F.desc("frequency"), "value"))


def boolean_shares(df: DataFrame, cols: Iterable[str] = (), include_boolean_types: bool = True) -> DataFrame:
    """Per column: non-NULL count and % true / false / other over non-NULL values.

    Text is compared with the true/false spellings lower-case, numbers with 1 and 0.
    """
    cols = present(df, cols)
    if include_boolean_types:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType) and f.name not in cols] + cols
    if not cols:
        return _empty(df, "column_name string, n_non_null long, pct_true double, pct_false double, pct_other double")
    types = {f.name: f.dataType for f in df.schema.fields}
    low = F.lower(F.col("value"))
    agg = (df.select(_rows([(c, _spelling(c, types[c])) for c in cols])).groupBy("column_name")
           .agg(F.count("value").alias("n_non_null"),
                F.count_if(low.isin(*TRUE_SPELLINGS)).alias("n_true"),
                F.count_if(low.isin(*FALSE_SPELLINGS)).alias("n_false")))
    n = F.col("n_non_null")
    return agg.select("column_name", "n_non_null", _share(F.col("n_true"), n).alias("pct_true"),
                      _share(F.col("n_false"), n).alias("pct_false"),
                      _share(n - F.col("n_true") - F.col("n_false"), n).alias("pct_other"))


def _spelling(c: str, kind) -> Column:
    """The value as text; a number equal to 1 or 0 is spelled so whatever its type."""
    x = F.col(c)
    if isinstance(kind, NumericType):
        return F.when(x == 1, "1").when(x == 0, "0").otherwise(x.cast("string"))
    return x.cast("string")


# --- duplicates -------------------------------------------------------------

def row_groups(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Identical rows grouped (NULLs equal), with their multiplicity ``n_copies``.

    A partial aggregate runs before the shuffle, so a value combination that
    holds a large share of the rows is collapsed map-side.
    """
    cols = list(df.columns if cols is None else cols)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies"))


def _row_hash(cols: Iterable[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def _unique_parts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(n_rows, n_unique) rows that add up to the rows and the unique rows of ``df``. For wide rows: a 64-bit row
    hash is grouped first (8 bytes per row cross the shuffle); a row whose hash no other row shares
    is unique for sure, and only rows with a shared hash are grouped on all
    columns to confirm (the semi join side is sized by AQE at run time)."""
    h = unused(df.columns, "__h")
    per = df.select(_row_hash(cols).alias(h)).groupBy(h).agg(F.count(F.lit(1)).alias("n_rows"))
    shared = per.filter("n_rows > 1").select(h)
    cand = df.withColumn(h, _row_hash(cols)).join(shared, h, "left_semi").drop(h)
    hashes = per.select("n_rows", (F.col("n_rows") == 1).cast("long").alias("n_unique"))
    confirmed = row_groups(cand, cols).select(F.lit(0).cast("long").alias("n_rows"), F.lit(1).cast("long").alias("n_unique"))
    return hashes.unionByName(confirmed)


def _unique_by_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    """(n_rows, n_unique) as one row."""
    zero = F.lit(0).cast("long")
    return _unique_parts(df, cols).agg(F.coalesce(F.sum("n_rows"), zero).alias("n_rows"),
                                       F.coalesce(F.sum("n_unique"), zero).alias("n_unique"))


def duplicate_count(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Total rows, unique rows, extra copies and their %. Only row hashes are
    shuffled, and whole rows only where a hash is shared."""
    cols = list(df.columns if cols is None else cols)
    extra = F.col("n_rows") - F.col("n_unique")
    return _unique_by_hash(df, cols).select("n_rows", "n_unique", extra.alias("n_duplicates"),
                                            _share(extra, F.col("n_rows")).alias("pct_duplicates"))


def duplicate_groups(df: DataFrame, n: int = 5, cols: Iterable[str] | None = None,
                     order_cols: Iterable[str] | None = None) -> DataFrame:
    """Top ``n`` groups of identical rows with more than one copy.

    Hashes of rows are counted first (8 bytes per row cross the shuffle). A group has at most as many copies as its hash, so
    only hashes that reach the count of the ``n``-th largest can hold the result; their rows alone are
    grouped on all columns. If rows of one hash turn out to differ, so that a group confirmed last
    has fewer copies than a hash left out, the hashes down to that count are confirmed as well.
    """
    cols = list(df.columns if cols is None else cols)
    order = list(order_cols or cols)
    h, count = unused(df.columns, "__h"), unused([*df.columns, *cols], "__c")
    written: list = []
    hashes = materialize(df.select(_row_hash(cols).alias(h)).groupBy(h).agg(F.count(F.lit(1)).alias(count)).filter(
        F.col(count) > 1), "duplicate-hashes", written)
    try:
        least = min((r[count] for r in hashes.orderBy(F.desc(count)).limit(n).collect()), default=2)  # n rows
        while True:
            chosen = hashes.filter(F.col(count) >= least).select(h)
            few = chosen.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
            rows = df.withColumn(h, _row_hash(cols)).join(F.broadcast(chosen) if few else chosen, h, "left_semi")
            found = (row_groups(rows, cols).filter(F.col("n_copies") > 1).orderBy(F.desc("n_copies"), *order).limit(n)).collect()
            left = hashes.filter(F.col(count) < least).agg(F.max(count).alias("most")).first().most
            if left is None or (len(found) == n and found[-1]["n_copies"] > left):
                break
            least = min(left, max(found[-1]["n_copies"], 2)) if len(found) == n else left
    finally:
        release(df.sparkSession, written)
    schema = df.select(*cols).withColumn("n_copies", F.lit(0).cast("long")).schema
    return df.sparkSession.createDataFrame([tuple(r) for r in found], schema).orderBy(F.desc("n_copies"), *order)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# --- statistics ---------------------------------------------------------------

def _stat_aggs(cols: list[str]) -> list[Column]:
    out = []
    for c in cols:
        x = F.col(c).try_cast("double")
        out += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
                F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_stddev")]
    return out


def numeric_summary_wide(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """min, max, mean, sample stddev of every numeric column, in one row."""
    aggs = _stat_aggs(present(df, cols))
    return df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("__n")).select()


def numeric_summary(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Same, one row per attribute by name (missing statistic -> NaN)."""
    cols = present(df, cols)
    if not cols:
        return _empty(df, "attribute string, minimum double, maximum double, mean double, stddev double")
    nan = F.lit(NAN)
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"),
                              *[F.coalesce(F.col(f"{c}_{s}"), nan).alias(s) for s in ("min", "max", "mean", "stddev")])
                     for c in cols])
    return (numeric_summary_wide(df, cols).select(F.inline(rows))
            .withColumnsRenamed({"min": "minimum", "max": "maximum"}).orderBy("attribute"))


def distinct_count_per_column(df: DataFrame, cols: Iterable[str], approx: bool = False,
                              rsd: float = 0.05) -> DataFrame:
    """Distinct non-NULL values per column (exact, or HyperLogLog++ with ``approx``)."""
    cols = present(df, cols)
    if not cols:
        return _empty(df, "column_name string, n_distinct long")
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    one = df.agg(*[f(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return one.select(_rows([(c, F.col(f"d{i}")) for i, c in enumerate(cols)], value="n_distinct"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and round(%, 2) per class, most frequent first.

    The total is a scalar subquery over the aggregated classes (one value),
    so there is neither an unpartitioned window nor a join.
    """
    counts = df.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return (counts.withColumn("pct", F.round(F.col("count") * 100.0 / total, 2))
                  .orderBy(F.desc("count"), label))


# --- score and summary --------------------------------------------------------

def _issue_counts(df: DataFrame, tokens, ranges, date_col, date_fmt) -> DataFrame:
    """Row count, unique rows and the counts of row-level issues, as one row: a plain
    aggregate for the issues and the hash-first plan of ``duplicate_count``."""
    zero = F.lit(0).cast("long")
    breaks = [out_of_range(c, *ranges[c]).cast("long") for c in present(df, ranges or {})]
    issues = df.agg(
        F.count_if(all_present(df.columns, tokens)).alias("n_complete"),
        (F.count_if(unparseable_date(df, date_col, date_fmt)) if date_col else F.max(zero)).alias("n_bad_dates"),
        F.coalesce(F.sum(sum(breaks[1:], breaks[0])) if breaks else F.max(zero), zero).alias("n_out_of_range"))
    names = ("n_rows", "n_unique", "n_complete", "n_bad_dates", "n_out_of_range")
    uniq = _unique_by_hash(df, df.columns)
    return issues.unionByName(uniq, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), zero).alias(c) for c in names])


def quality_score(df: DataFrame, tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """pct_complete * (1 - duplicates / total); NULL for an empty frame."""
    c = _issue_counts(df, tokens, None, None, None)
    return c.select(_score(c).alias("quality_score"))


def _score(c) -> Column:
    n = F.col("n_rows")
    return _share(F.col("n_complete"), n) * (F.lit(1.0) - F.try_divide(n - F.col("n_unique"), n))


def quality_summary(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None,
                    date_col: str | None = None, date_fmt: str = DATE_FORMAT,
                    tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """(issue, value) rows: score, incomplete rows, duplicates, and bad dates /
    out-of-range values when non-zero."""
    c = _issue_counts(df, tokens, ranges, date_col, date_fmt)
    n = F.col("n_rows")
    rows = F.array(
        F.struct(F.lit("quality_score").alias("issue"), _score(c).alias("value")),
        F.struct(F.lit("incomplete_rows").alias("issue"), (n - F.col("n_complete")).cast("double").alias("value")),
        F.struct(F.lit("duplicate_rows").alias("issue"), (n - F.col("n_unique")).cast("double").alias("value")),
        F.struct(F.lit("invalid_dates").alias("issue"), F.col("n_bad_dates").cast("double").alias("value")),
        F.struct(F.lit("out_of_range_values").alias("issue"), F.col("n_out_of_range").cast("double").alias("value")),
    )
    out = c.select(F.inline(rows))
    return out.filter(~F.col("issue").isin("invalid_dates", "out_of_range_values") | (F.col("value") > 0))


# --- the whole report -----------------------------------------------------------

def profile_report(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None,
                   domains: Mapping[str, Iterable[str]] | None = None, yes_no: Iterable[str] = (),
                   date_col: str | None = None, numeric: Iterable[str] = (), date_fmt: str = DATE_FORMAT,
                   tokens: Iterable[str] = PROFILE_TOKENS) -> DataFrame:
    """The full quality profile as (section, column_name, metric, value) rows.

    Three branches, whatever the number of columns: one wide aggregate (row
    count, missing values, completeness, ranges, dates, statistics, boolean
    shares), one grouping of row hashes with its confirmation (duplicates) and
    one grouping over the unpivoted domain columns (violations); the last two
    end in the same aggregate.
    """
    ranges, domains = dict(ranges or {}), dict(domains or {})
    cols = df.columns
    num = present(df, numeric)
    yn = present(df, yes_no)
    rc = present(df, ranges)
    aggs = {"n_rows": F.count(F.lit(1)), "n_complete": F.count_if(all_present(cols, tokens))}
    for i, c in enumerate(cols):
        aggs[f"miss{i}"] = F.count_if(is_missing(c, tokens))
    for i, c in enumerate(rc):
        aggs[f"rng{i}"] = F.count_if(out_of_range(c, *ranges[c]))
    if date_col:
        aggs["bad_dates"] = F.count_if(unparseable_date(df, date_col, date_fmt))
        d = F.try_to_date(F.col(date_col), date_fmt) if isinstance(df.schema[date_col].dataType, StringType) \
            else F.col(date_col).cast("date")
        aggs["first_date"] = F.unix_date(F.min(d))
        aggs["last_date"] = F.unix_date(F.max(d))
    for i, c in enumerate(num):
        x = F.col(c).try_cast("double")
        aggs.update({f"min{i}": F.min(x), f"max{i}": F.max(x), f"mean{i}": F.avg(x), f"sd{i}": F.stddev_samp(x)})
    for i, c in enumerate(yn):
        low = F.lower(_spelling(c, df.schema[c].dataType))
        aggs.update({f"yn{i}": F.count(c), f"yt{i}": F.count_if(low.isin(*TRUE_SPELLINGS)),
                     f"yf{i}": F.count_if(low.isin(*FALSE_SPELLINGS))})
    one = df.agg(*[v.alias(k) for k, v in aggs.items()])

    def row(section, column, metric, value):
        return F.struct(F.lit(section).alias("section"), F.lit(column).cast("string").alias("column_name"),
                        F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    n = F.col("n_rows")
    out = [row("rows", None, "n_rows", n), row("completeness", None, "n_complete", F.col("n_complete")),
           row("completeness", None, "pct_complete", _share(F.col("n_complete"), n))]
    out += [row("missing", c, "n_missing", F.col(f"miss{i}")) for i, c in enumerate(cols)]
    out += [row("missing", c, "pct_missing", _share(F.col(f"miss{i}"), n)) for i, c in enumerate(cols)]
    out += [row("range", c, "n_out_of_range", F.col(f"rng{i}")) for i, c in enumerate(rc)]
    if date_col:
        out += [row("dates", date_col, m, F.col(m)) for m in ("bad_dates", "first_date", "last_date")]
    for i, c in enumerate(num):
        out += [row("statistics", c, m, F.coalesce(F.col(f"{k}{i}"), F.lit(NAN)))
                for m, k in (("minimum", "min"), ("maximum", "max"), ("mean", "mean"), ("stddev", "sd"))]
    for i, c in enumerate(yn):
        t, f_, nn = F.col(f"yt{i}"), F.col(f"yf{i}"), F.col(f"yn{i}")
        out += [row("booleans", c, "n_non_null", nn), row("booleans", c, "pct_true", _share(t, nn)),
                row("booleans", c, "pct_false", _share(f_, nn)),
                row("booleans", c, "pct_other", _share(nn - t - f_, nn))]
    wide = one.select(F.inline(F.array(*out)))

    # Duplicates and domains end in one aggregate: a group for the rows (NULL) and one for each domain column.
    zero = F.lit(0).cast("long")
    own = present(df, domains)
    parts = _unique_parts(df, cols).select(F.lit(None).cast("string").alias("column_name"), "n_rows", F.col("n_unique").alias("n_values"))
    none = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("column_name"), zero.alias("n_rows"), zero.alias("n_values"))
    parts = parts.unionByName(none)
    if own:
        found = domain_violation_values(df, domains).unionByName(_zero_rows(df, own))
        parts = parts.unionByName(found.select("column_name", "n_rows", F.col("value").isNotNull().cast("long").alias("n_values")))
    sums = parts.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))
    entry = lambda section, column, metric, value: F.struct(
        F.lit(section).alias("section"), column.alias("column_name"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    c, total, values = F.col("column_name"), F.col("n_rows"), F.col("n_values")
    rest = sums.select(F.inline(F.when(c.isNull(), F.array(
        entry("duplicates", c, "n_unique", values), entry("duplicates", c, "n_duplicates", total - values))).otherwise(F.array(
            entry("domain", c, "n_invalid_values", values), entry("domain", c, "n_rows_affected", total)))))
    return wide.unionByName(rest)
