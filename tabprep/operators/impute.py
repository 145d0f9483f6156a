"""Numeric and categorical fills learned on a reference frame.

Every fill is "fit on ``reference``, apply to ``df``": statistics never come
from the frame being filled unless it is passed as its own reference. All
columns of a stage share ONE grouped aggregate and ONE lookup join (the
reference's column-by-column folds are equivalent because each step reads and
writes only its own column and lookup keys are unique).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators.joins import lookup_left_entity_month, lookup_left_month, month_table
from tabprep.operators.normalize import present
from tabprep.operators.stats import grouped_stats, mode_by_group, modes_by_group, modes_two_levels, two_level_stats
from tabprep.operators.windows import NEXT, PREV, neighbour_values
from tabprep.rules import CLEAN_TOKENS
from tabprep.session import materialize


def _coalesce_from(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``c = coalesce(c, stat)`` for each (c -> stat column), then drop the stats."""
    return df.withColumns({c: F.coalesce(F.col(c), F.col(s)) for c, s in pairs.items()}).drop(*pairs.values())


# --- month --------------------------------------------------------------------

def fit_month(reference: DataFrame, month: str, means: Iterable[str] = (), medians: Iterable[str] = (),
              accuracy: int = 10000) -> DataFrame:
    """Month means / approximate medians of the reference (<= 13 rows)."""
    return month_table(grouped_stats(reference, [month], means, medians, accuracy, "_mon_mean", "_mon_median"))


def apply_month(df: DataFrame, stats: DataFrame, month: str, means: Iterable[str] = (),
                medians: Iterable[str] = ()) -> DataFrame:
    pairs = {c: f"{c}_mon_mean" for c in present(df, means)}
    pairs.update({c: f"{c}_mon_median" for c in present(df, medians)})
    return _coalesce_from(lookup_left_month(df, stats, month), pairs)


def fill_month(df: DataFrame, reference: DataFrame, month: str, means: Iterable[str] = (),
               medians: Iterable[str] = (), accuracy: int = 10000) -> DataFrame:
    """NULL -> the reference's month mean (``means``) or median (``medians``)."""
    means, medians = present(df, means), present(df, medians)
    if not means and not medians:
        return df
    return apply_month(df, fit_month(reference, month, means, medians, accuracy), month, means, medians)


def fill_month_mean(df, reference, month, cols):
    return fill_month(df, reference, month, means=cols)


def fill_month_median(df, reference, month, cols, accuracy: int = 10000):
    return fill_month(df, reference, month, medians=cols, accuracy=accuracy)


# --- neighbours ------------------------------------------------------------------

def neighbour_mean_fill(c: str):
    """NULL -> the average (= the median) of the two row neighbours, NULL if one of them is."""
    return F.coalesce(F.col(c), (F.col(c + PREV) + F.col(c + NEXT)) / 2)


def fill_neighbour_mean(df: DataFrame, entity: str, order: list[str], cols: Iterable[str],
                        bucket="auto") -> DataFrame:
    cols = present(df, cols)
    nb = neighbour_values(df, entity, order, cols, bucket)
    return nb.withColumns({c: neighbour_mean_fill(c) for c in cols}) \
             .drop(*[c + s for c in cols for s in (PREV, NEXT)])


# --- entity and month ---------------------------------------------------------------

def fit_entity_month(reference: DataFrame, entity: str, month: str, means: Iterable[str] = (),
                     medians: Iterable[str] = (), accuracy: int = 10000) -> DataFrame:
    return grouped_stats(reference, [entity, month], means, medians, accuracy, "_locmon_mean", "_locmon_median")


def apply_entity_month(df: DataFrame, stats: DataFrame, entity: str, month: str, means: Iterable[str] = (),
                       medians: Iterable[str] = ()) -> DataFrame:
    pairs = {c: f"{c}_locmon_mean" for c in present(df, means)}
    pairs.update({c: f"{c}_locmon_median" for c in present(df, medians)})
    return _coalesce_from(lookup_left_entity_month(df, stats, entity, month), pairs)


def fill_entity_month(df: DataFrame, reference: DataFrame, entity: str, month: str,
                      means: Iterable[str] = (), medians: Iterable[str] = (), accuracy: int = 10000) -> DataFrame:
    """Remaining NULL -> (entity, month) mean / median of the reference."""
    means, medians = present(df, means), present(df, medians)
    if not means and not medians:
        return df
    st = fit_entity_month(reference, entity, month, means, medians, accuracy)
    return apply_entity_month(df, st, entity, month, means, medians)


def fill_neighbours_then_entity_month(df: DataFrame, reference: DataFrame, entity: str, order: list[str],
                                      month: str, means: Iterable[str] = (), medians: Iterable[str] = (),
                                      accuracy: int = 10000, bucket="auto") -> DataFrame:
    """Neighbour average, then (entity, month) mean / median: one window, one join."""
    means, medians = present(df, means), present(df, medians)
    out = fill_neighbour_mean(df, entity, order, means + medians, bucket)
    return fill_entity_month(out, reference, entity, month, means, medians, accuracy)


# --- categories ------------------------------------------------------------------------

def fill_mode_entity_month(df: DataFrame, reference: DataFrame, entity: str, month: str,
                           cols: Iterable[str]) -> DataFrame:
    """NULL category -> the reference's (entity, month) mode (ties: smallest)."""
    cols = present(df, cols)
    if not cols:
        return df
    st = modes_by_group(reference, [entity, month], cols, "_locmon_mode")
    return _coalesce_from(lookup_left_entity_month(df, st, entity, month), {c: f"{c}_locmon_mode" for c in cols})


def _levels(both: DataFrame, entity: str, month: str, fine: dict, coarse: dict, flag: str = "__g") -> tuple[DataFrame, DataFrame]:
    """(entity, month) rows and month rows of a written two-level table, with the columns renamed."""
    return (both.filter(F.col(flag) == 0).select(entity, month, *[F.col(c).alias(a) for c, a in fine.items()]),
            both.filter(F.col(flag) == 1).select(month, *[F.col(c).alias(a) for c, a in coarse.items()]))


def _missing_to_null(c: str, tokens) -> F.Column:
    s = F.col(c)
    t = F.trim(s.cast("string"))
    return F.when(s.isNull() | (t == "") | F.upper(t).isin(*[x.upper() for x in tokens]), F.lit(None)).otherwise(s)


def fill_token_mode_cascade(df: DataFrame, reference: DataFrame, entity: str, month: str,
                            cols: Iterable[str], tokens: Iterable[str] = CLEAN_TOKENS) -> DataFrame:
    """Missing (NULL, blank or token) -> (entity, month) mode, else month mode.

    Modes are taken over the reference's non-missing values; ties go to the
    smallest value; one value per group, so the frame's rows never multiply.
    """
    cols, toks = present(df, cols), list(tokens)
    if not cols:
        return df
    clean = lambda d: d.withColumns({c: _missing_to_null(c, toks) for c in cols})
    # both levels of modes from one pass of value counts, written once: each lookup reads its rows of the written table
    both = materialize(modes_two_levels(clean(reference), entity, month, cols, "__g"), "cascade-modes")
    lm, mm = _levels(both, entity, month, {c: f"{c}_locmon_mode" for c in cols}, {c: f"{c}_mon_mode" for c in cols})
    out = lookup_left_month(lookup_left_entity_month(clean(df), lm, entity, month), month_table(mm, is_written=True), month)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_locmon_mode"), F.col(f"{c}_mon_mode"))
                            for c in cols}) \
              .drop(*[f"{c}_{s}" for c in cols for s in ("locmon_mode", "mon_mode")])


def parse_tokens_to_double(c: str, tokens) -> F.Column:
    t = F.trim(F.col(c).cast("string"))
    return F.when((t == "") | F.upper(t).isin(*[x.upper() for x in tokens]), F.lit(None)).otherwise(t) \
            .try_cast("double")


def fill_token_median_cascade(df: DataFrame, reference: DataFrame, entity: str, month: str,
                              cols: Iterable[str], tokens: Iterable[str] = CLEAN_TOKENS,
                              accuracy: int = 10000) -> DataFrame:
    """Missing -> (entity, month) median, else month median (values parsed to
    double; tokens and blanks are missing)."""
    cols, toks = present(df, cols), list(tokens)
    if not cols:
        return df
    parse = lambda d: d.withColumns({c: parse_tokens_to_double(c, toks) for c in cols})
    # both levels of medians from one pass of mergeable sketches, written once
    both = materialize(two_level_stats(parse(reference), entity, month, {}, {c: F.col(c) for c in cols}, accuracy), "cascade-medians")
    lm, mm = _levels(both, entity, month, {c: f"{c}_locmon_median" for c in cols}, {c: f"{c}_mon_median" for c in cols})
    out = lookup_left_month(lookup_left_entity_month(parse(df), lm, entity, month), month_table(mm, is_written=True), month)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_locmon_median"), F.col(f"{c}_mon_median"))
                            for c in cols}) \
              .drop(*[f"{c}_{s}" for c in cols for s in ("locmon_median", "mon_median")])


def join_inner_month_mode(df: DataFrame, reference: DataFrame, month: str, col: str,
                          alias: str = "month_mode") -> DataFrame:
    """Inner join with the month mode of ``col``: months without a mode drop out."""
    mode = mode_by_group(reference, [month], col, alias)
    return df.join(month_table(mode), month)


__all__ = [
    "apply_entity_month", "apply_month", "fill_entity_month", "fill_mode_entity_month", "fill_month",
    "fill_month_mean", "fill_month_median", "fill_neighbour_mean", "fill_neighbours_then_entity_month",
    "fill_token_median_cascade", "fill_token_mode_cascade", "fit_entity_month", "fit_month",
    "join_inner_month_mode", "neighbour_mean_fill",
]
