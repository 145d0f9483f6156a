"""Row removal: zero vectors, sentinel codes, the extreme fraction, and the
account of every row removed."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.missing import any_true
from tabprep.functions.names import unused
from tabprep.operators.normalize import present
from tabprep.session import materialize, release

# Rows of one range partition when candidates are ranked: sets the parallelism, nothing else.
ROWS_PER_RANGE = 1_000_000
ROW_NUMBER = "__row_number"


def zero_vector(cols: Iterable[str]) -> Column:
    """Some direction vector is exactly (0, 0); an empty list is false."""
    return any_true([(F.col(f"{c}_ux") == 0.0) & (F.col(f"{c}_uy") == 0.0) for c in cols])


def drop_zero_vectors(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows where some ``<c>_ux``/``<c>_uy`` pair is exactly (0, 0)."""
    return df.filter(~zero_vector([c for c in cols if f"{c}_ux" in df.columns]))


def sentinel(cols: Iterable[str], code: int = 9) -> Column:
    """Some code column, cast to int (truncating), equals the sentinel.

    Three-valued: NULL when a code is NULL and no other is the sentinel.
    """
    return any_true([F.col(c).try_cast("int") == F.lit(code) for c in cols])


def drop_sentinel_codes(df: DataFrame, cols: Iterable[str], code: int = 9, null_is_ok: bool = False) -> DataFrame:
    """Drop rows with a sentinel code. By default a NULL test result drops the
    row too (as ``filter(!(a == 9 || b == 9))`` does); ``null_is_ok`` keeps it."""
    p = sentinel(present(df, cols), code)
    return df.filter(~F.coalesce(p, F.lit(False)) if null_is_ok else ~p)


def _floor_fraction(n: int, fraction: float) -> int:
    return int((Fraction(n) * Fraction(fraction).limit_denominator(10**9)) // 1)


def _order(cols: list[str], side: str) -> list[Column]:
    """Order whose first k rows are the removed ones."""
    return [F.col(c).desc_nulls_last() if side == "high" else F.col(c).asc_nulls_first() for c in cols]


def _row_at(cand: DataFrame, cols: list[str], side: str, k: int):
    """The ``k``-th row (from 1) of ``cand`` in the order, without a single-task sort.

    Range-partition by the order, sort inside partitions and write the order
    columns with their partition and place; the rows of earlier partitions
    tell which partition holds it. The written table is deleted again.
    """
    order, written = _order(cols, side), []
    parts = max(1, -(-cand.count() // ROWS_PER_RANGE))
    part, place = unused(cols, "__pid"), unused(cols, "__pos")
    ranged = cand.select(*cols).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)})
    local, before = materialize(ranged, "trim-order", written), 0
    try:
        for r in local.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect():  # a row a partition
            if before + r["n"] >= k:
                return local.filter((F.col(part) == r[part]) & (F.col(place) == k - before - 1)).first()
            before += r["n"]
    finally:
        release(cand.sparkSession, written)
    raise ValueError(f"fewer than {k} rows")


def _not_after(row, cols: list[str], side: str) -> Column:
    """True for rows that do not come after ``row`` in the order."""
    out = F.lit(True)
    for c in reversed(cols):
        v = row[c]
        x = F.col(c)
        if side == "high":  # NULL comes last
            ahead = x.isNotNull() if v is None else F.coalesce(x > F.lit(v), F.lit(False))
        else:  # NULL comes first
            ahead = F.lit(False) if v is None else F.coalesce(x < F.lit(v), F.lit(True))
        same = x.isNull() if v is None else x.eqNullSafe(F.lit(v))
        out = ahead | (same & out)
    return out


def _plan_cut(df: DataFrame, col: str, fraction: float, side: str, accuracy: int):
    """ONE pass: row count, non-NULL count and approximate quantiles on a grid.

    ``percentile_approx`` guarantees a rank error of at most nn / accuracy, so
    the cut at grid position g keeps at least g*fraction*nn - nn/accuracy
    values beyond it; the smallest g with twice the needed margin is taken,
    which proves the candidate set holds the whole removed set (no count job).
    """
    c = F.col(col)
    grid = [1.5 * 2 ** i for i in range(24)]
    qs = [min(1.0, g * fraction) for g in grid]
    qs = [1.0 - q for q in qs] if side == "high" else qs
    st = df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("nn"),
                F.percentile_approx(c, qs, accuracy).alias("q")).first()
    return int(st["n"]), int(st["nn"]), grid, st["q"]


def trim_candidates(df: DataFrame, col: str, fraction: float = 0.001, side: str = "high",
                    accuracy: int = 10000) -> tuple[DataFrame, int]:
    """A subset of ``df`` proven to hold every removed row, and k.

    One aggregate plans the cut (see ``_plan_cut``); the candidates are the
    rows beyond it (plus NULLs when they sort into the removed end).
    """
    if side not in ("high", "low"):
        raise ValueError("side must be 'high' or 'low'")
    c = F.col(col)
    n, nn, grid, cuts = _plan_cut(df, col, fraction, side, accuracy)
    k = _floor_fraction(n, fraction)
    if k == 0:
        return df.limit(0), 0
    need = k if side == "high" else k - (n - nn)  # NULLs sort last descending: removed first
    if side == "low" and need <= 0:
        return df.filter(c.isNull()), k
    if need >= nn or cuts is None:
        return df, k
    for g, v in zip(grid, cuts):
        if g * fraction >= 1.0:
            break
        if g * fraction * nn - nn / accuracy >= 2 * need:
            beyond = (c >= F.lit(v)) if side == "high" else (c <= F.lit(v))
            return (df.filter(beyond | c.isNull()) if side == "low" else df.filter(beyond)), k
    return df, k


def numbered(df: DataFrame, name: str = "numbered", written: list | None = None) -> DataFrame:
    """``df`` written once with a row number, which makes any order total."""
    return materialize(df.withColumn(ROW_NUMBER, F.monotonically_increasing_id()), name, written)


def extreme_predicate(df: DataFrame, col: str, key: list[str], fraction: float = 0.001, side: str = "high",
                      accuracy: int = 10000) -> Column:
    """True for the floor(N * fraction) rows of a ``numbered`` frame that a keep-the-rest sort would cut.

    ``side="high"``: ascending sort with NULLs first, so the highest values go
    (ties: larger key first). ``side="low"``: descending sort with NULLs last,
    so NULLs go first, then the lowest values (ties: smaller key first). The
    row number ends every tie, so ``key`` need not identify rows. Only the
    candidates beyond the planned cut are ordered, by the columns of the order
    alone, and the rows are told by comparison with the last one removed.
    """
    cand, k = trim_candidates(df, col, fraction, side, accuracy)
    if k == 0:
        return F.lit(False)
    cols = list(dict.fromkeys([col, *key, ROW_NUMBER]))
    return _not_after(_row_at(cand.select(*cols), cols, side, k), cols, side)


def trim_extreme(df: DataFrame, col: str, key: list[str], fraction: float = 0.001, side: str = "high",
                 accuracy: int = 10000) -> DataFrame:
    """Keep N - floor(N * fraction) rows, cutting the extreme ``side`` of ``col``; ``key`` orders rows of one value."""
    rows = numbered(df, "trim-input")
    return rows.filter(~extreme_predicate(rows, col, key, fraction, side, accuracy)).select(*df.columns)


def removal_report(df: DataFrame, dir_cols: Iterable[str], sentinel_cols: Iterable[str], code: int,
                   trim_col: str | None, key: list[str], fraction: float = 0.001, side: str = "high",
                   null_is_ok: bool = False, accuracy: int = 10000) -> DataFrame:
    """Rows removed by each stage (zero vectors, sentinel codes, extreme
    values), the invalid ones (the first two), the total removed and the rows
    kept, each with its share of the input rows. Every row is tagged with the
    first stage that removes it."""
    dcols = [c for c in dir_cols if f"{c}_ux" in df.columns]
    z = zero_vector(dcols)
    s = sentinel(present(df, sentinel_cols), code)
    keep_s = ~F.coalesce(s, F.lit(False)) if null_is_ok else F.coalesce(~s, F.lit(False))
    rows = numbered(df, "report-input")
    tagged = rows.withColumn("__stage", F.when(~F.coalesce(~z, F.lit(False)), F.lit("zero_vector"))
                                         .when(~keep_s, F.lit("sentinel")))
    if trim_col:
        beyond = extreme_predicate(tagged.filter(F.col("__stage").isNull()), trim_col, key, fraction, side, accuracy)
        tagged = tagged.withColumn("__stage", F.coalesce("__stage", F.when(beyond, F.lit("extreme"))))
    st = F.col("__stage")
    one = tagged.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(st == "zero_vector").alias("zero_vector"),
                     F.count_if(st == "sentinel").alias("sentinel"),
                     F.count_if(st == "extreme").alias("extreme"))
    stages = [("zero_vector", F.col("zero_vector")), ("sentinel", F.col("sentinel")),
            ("invalid", F.col("zero_vector") + F.col("sentinel")), ("extreme", F.col("extreme")),
            ("removed", F.col("zero_vector") + F.col("sentinel") + F.col("extreme")),
            ("kept", F.col("n") - F.col("zero_vector") - F.col("sentinel") - F.col("extreme"))]
    arr = F.array(*[F.struct(F.lit(a).alias("stage"), v.cast("long").alias("n_rows")) for a, v in stages])
    return one.select(F.inline(arr), "n").select(
        "stage", "n_rows", F.try_divide(F.col("n_rows") * 100.0, F.col("n")).alias("pct_of_input"))
