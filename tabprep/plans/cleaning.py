"""The cleaning plan: fit statistics on a reference frame, apply them to any
frame with ONE window, ONE (entity, month) join and ONE broadcast probe of the
13-row month table before the window (what is needed of it after the window are literals).

Order of the stages (same as the surveyed script): month mean/median ->
row-neighbour average -> (entity, month) mean/median -> compass vectors
(neighbours -> month circular mean -> re-normalise) -> category mode ->
code mode cascade -> median cascade; then zero vectors, sentinel codes and
the extreme fraction are removed. Each stage reads and writes its own columns
only, which is what lets the stages share the joins and the window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.compass import direction_to_radians
from tabprep.operators.circular import direction_to_vector, neighbour_vector_fill, normalize_vectors
from tabprep.operators.impute import neighbour_mean_fill
from tabprep.operators.joins import MONTH_ROWS, lookup_left_entity_month, lookup_left_month, month_values
from tabprep.operators.normalize import normalize_observations, present
from tabprep.operators.outliers import (drop_sentinel_codes, drop_zero_vectors, extreme_predicate, numbered,
                                        removal_report)
from tabprep.operators.predicates import filter_labelled
from tabprep.operators.split import in_train
from tabprep.operators.stats import modes_two_levels, two_level_stats
from tabprep.operators.windows import NEXT, PREV, neighbour_values
from tabprep.rules import SPLIT_FRACTIONS, CleaningSpec
from tabprep.session import materialize, release

TRAIN, TEST = "train", "test"


def _uniq(xs):
    out = []
    for x in xs:
        if x not in out:
            out.append(x)
    return out


@dataclass
class CleaningModel:
    spec: CleaningSpec
    month_stats: DataFrame         # <= 13 rows, keyed by month
    entity_month_stats: DataFrame  # one row per (entity, month) of the reference
    columns: dict
    written: list = field(default_factory=list)  # paths of the tables written so far
    month_rows: list = field(default_factory=list)  # the rows of month_stats where they are few

    # ---------------------------------------------------------------- fit
    @classmethod
    def fit(cls, reference: DataFrame, spec: CleaningSpec, materialize_stats: bool = True) -> "CleaningModel":
        lay, written = spec.layout, []
        means = present(reference, spec.mean_filled)
        medians = present(reference, spec.median_filled)
        dirs = present(reference, spec.direction_columns)
        modes = present(reference, spec.mode_filled)
        mcasc = present(reference, spec.mode_cascade)
        dcasc = present(reference, spec.median_cascade)
        acc = spec.accuracy

        # ONE aggregate by (entity, month) into sums, counts and sketches gives both
        # levels of means, medians and circular means by merging.
        keys = [lay.entity, lay.month]
        meds = _uniq(medians + dcasc)
        averaged = {f"{c}__mean": F.col(c) for c in means}
        for c in dirs:
            r = direction_to_radians(c)
            averaged |= {f"{c}__cx": F.cos(r), f"{c}__cy": F.sin(r)}
        gs = two_level_stats(reference, *keys, averaged, {f"{c}__median": F.col(c) for c in meds}, acc, "__g")
        # ONE pass of value counts gives both levels of modes; they are merged
        # with the statistics by a union and one small aggregate (no join).
        mtargets = _uniq(modes + mcasc)
        if mtargets:
            mo = modes_two_levels(reference, lay.entity, lay.month, mtargets, "__g")
            mo = mo.withColumnsRenamed({t: f"{t}__mode" for t in mtargets})
            vals = [c for c in gs.columns if c not in (*keys, "__g")] + [f"{t}__mode" for t in mtargets]
            gs = (gs.unionByName(mo, allowMissingColumns=True).groupBy(*keys, "__g")
                    .agg(*[F.max(c).alias(c) for c in vals]))
        if materialize_stats:
            # a fitted model holds its statistics: written once (they are
            # small), so applying the model to train and test reads them
            # instead of re-aggregating the reference, and the planner sees
            # their real size when it picks the join strategy
            gs = materialize(gs, "cleaning-stats", written)
        mon = gs.filter(F.col("__g") == 1).select(
            lay.month, *[F.col(f"{c}__mean").alias(f"{c}_mon_mean") for c in means],
            *[F.col(f"{c}__median").cast(reference.schema[c].dataType).alias(f"{c}_mon_median") for c in meds],
            *[F.col(f"{c}__c{a}").alias(f"{c}__mon_u{a}") for c in dirs for a in ("x", "y")],
            *[F.col(f"{c}__mode").alias(f"{c}_mon_mode") for c in mcasc])
        mon = normalize_vectors(mon, [f"{c}__mon" for c in dirs], spec.eps) if dirs else mon
        em = gs.filter(F.col("__g") == 0).select(
            *keys, *[F.col(f"{c}__mean").alias(f"{c}_locmon_mean") for c in means],
            *[F.col(f"{c}__median").cast(reference.schema[c].dataType).alias(f"{c}_locmon_median") for c in meds],
            *[F.col(f"{c}__mode").alias(f"{c}_locmon_mode") for c in mtargets])
        cols = dict(means=means, medians=medians, dirs=dirs, modes=modes, mcasc=mcasc, dcasc=dcasc)
        # the month table's size is checked before it is hinted; its few rows also serve as literals
        rows = mon.limit(MONTH_ROWS + 1).collect() if materialize_stats else []
        if 0 < len(rows) <= MONTH_ROWS:
            return cls(spec, F.broadcast(mon), em, cols, written, rows)
        return cls(spec, mon, em, cols, written)

    def release(self, spark) -> None:
        """Deletes the tables the model has written; frames made by it cannot be read afterwards."""
        release(spark, self.written)

    # ---------------------------------------------------------------- apply
    def impute(self, df: DataFrame, bucket="auto", half: str | None = None) -> DataFrame:
        """All fills, no row removed: the month table probed once (broadcast,
        before the window), 1 window, 1 (entity, month) join.
        ``half``: a column that names the part of a split; neighbours stay within it."""
        lay, c = self.spec.layout, self.columns
        means, medians, dirs = c["means"], c["medians"], c["dirs"]
        num = means + medians
        base_cols = df.columns

        # 1. month mean / median (broadcast: the month table is bounded). Only
        #    the columns used here are joined, so nothing extra rides the
        #    window's shuffle; the rest is probed again after the window.
        pre = [f"{x}_mon_mean" for x in means] + [f"{x}_mon_median" for x in medians]
        d = lookup_left_month(df, self.month_stats.select(lay.month, *pre), lay.month)
        d = d.withColumns({**{x: F.coalesce(F.col(x), F.col(f"{x}_mon_mean")) for x in means},
                           **{x: F.coalesce(F.col(x), F.col(f"{x}_mon_median")) for x in medians}}).drop(*pre)
        # 2. compass -> unit vectors
        d = direction_to_vector(d, dirs)
        vec = [f"{x}_{a}" for x in dirs for a in ("ux", "uy")]
        # 3. one window for every neighbour lookup
        d = neighbour_values(d, [lay.entity] if half is None else [half, lay.entity], lay.order, num + vec, bucket,
                             written=self.written)
        fills = {x: neighbour_mean_fill(x) for x in num}
        for x in dirs:
            fills.update(neighbour_vector_fill(x))
        d = d.withColumns(fills).drop(*[x + s for x in num + vec for s in (PREV, NEXT)])
        # 4. one (entity, month) join for every remaining fill; the month's compass
        #    means and cascade fallbacks are literals of the plan
        d = lookup_left_entity_month(d, self.entity_month_stats, lay.entity, lay.month)
        post = [f"{x}__mon_{a}" for x in dirs for a in ("ux", "uy")]
        post += [f"{x}_mon_mode" for x in c["mcasc"]] + [f"{x}_mon_median" for x in c["dcasc"]]
        if post and self.month_rows:
            d = d.withColumns(month_values(self.month_rows, lay.month, post))
        elif post:
            d = lookup_left_month(d, self.month_stats.select(lay.month, *post), lay.month)
        outs = {**{x: F.coalesce(F.col(x), F.col(f"{x}_locmon_mean")) for x in means},
                **{x: F.coalesce(F.col(x), F.col(f"{x}_locmon_median")) for x in medians}}
        for x in dirs:
            for a in ("ux", "uy"):
                outs[f"{x}_{a}"] = F.coalesce(F.col(f"{x}_{a}"), F.col(f"{x}__mon_{a}"))
        d = normalize_vectors(d.withColumns(outs), dirs, self.spec.eps)
        casc = {x: F.coalesce(F.col(x), F.col(f"{x}_locmon_mode")) for x in c["modes"]}
        d = d.withColumns(casc)
        casc = {x: F.coalesce(F.col(x), F.col(f"{x}_locmon_mode"), F.col(f"{x}_mon_mode")) for x in c["mcasc"]}
        d = d.withColumns(casc)
        casc = {x: F.coalesce(F.col(x), F.col(f"{x}_locmon_median"), F.col(f"{x}_mon_median")) for x in c["dcasc"]}
        d = d.withColumns(casc)
        return d.select(*base_cols, *vec)

    def _key(self) -> list[str]:
        lay = self.spec.layout
        return [lay.row_id] if lay.row_id else [lay.entity, lay.time]

    def remove(self, df: DataFrame, half: str | None = None) -> DataFrame:
        """Zero vectors, sentinel codes, then the extreme fraction (of each half by itself).

        The trim reads its input more than once, so it is written first."""
        s = self.spec
        out = drop_zero_vectors(df, self.columns["dirs"])
        out = drop_sentinel_codes(out, s.sentinel_columns, s.sentinel_code, s.null_is_ok)
        if not s.trim_column or s.trim_column not in out.columns:
            return out
        rows = numbered(out, "cleaned-before-trim", self.written)
        trim = (s.trim_column, self._key(), s.trim_fraction, s.trim_side, s.accuracy)
        if half is None:
            return rows.filter(~extreme_predicate(rows, *trim)).select(*df.columns)
        keep = F.lit(True)
        for name in (TRAIN, TEST):
            own = F.col(half) == name
            keep = keep & ~(own & extreme_predicate(rows.filter(own), *trim))
        return rows.filter(keep).select(*df.columns)

    def transform(self, df: DataFrame, bucket="auto") -> DataFrame:
        return self.remove(self.impute(df, bucket))

    def transform_halves(self, df: DataFrame, half: str = "half", bucket="auto") -> DataFrame:
        """``df`` whose column ``half`` is TRAIN or TEST, each half cleaned by itself in one plan."""
        return self.remove(self.impute(df, bucket, half), half)

    def report(self, imputed: DataFrame) -> DataFrame:
        """Rows removed per stage on ``imputed`` (see ``removal_report``)."""
        s = self.spec
        return removal_report(imputed, self.columns["dirs"], s.sentinel_columns, s.sentinel_code,
                              s.trim_column, self._key(), s.trim_fraction, s.trim_side, s.null_is_ok, s.accuracy)


def with_half(df: DataFrame, id_col: str, label: str | None = None, classes=None, fraction: float = SPLIT_FRACTIONS[0]) -> DataFrame:
    """The labelled rows with the hashed split's side in ``half``."""
    if label is not None:
        df = df.filter(F.col(label).isNotNull()) if classes is None else filter_labelled(df, label, classes)
    return df.withColumn("half", F.when(in_train(id_col, fraction), TRAIN).otherwise(TEST))


def normalize_for(df: DataFrame, spec: CleaningSpec, numeric_text_cols=(), date_format=None) -> DataFrame:
    lay = spec.layout
    return normalize_observations(df, lay.time, lay.month, spec.direction_columns, spec.yes_no_columns,
                                  numeric_text_cols=numeric_text_cols, date_format=date_format)
