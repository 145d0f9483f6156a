"""Grouped statistics: means, medians, modes and circular means.

Each function is ONE grouped aggregate over all the requested columns (partial
aggregation runs before the shuffle, so hot groups are pre-combined map-side).
Medians are KLL sketches of ``accuracy`` values: exact for groups of up to that many, with
a rank error of about 2.3 / accuracy**0.9 (0.06 % for 10,000) beyond, and at most some
three times that many doubles however large the group. They merge across
partitions, and across groups: two-level statistics come from one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.compass import direction_to_radians, normalize_xy
from tabprep.functions.missing import nullify_tokens
from tabprep.operators.normalize import present
from tabprep.rules import CLEAN_TOKENS


def sketch(x: Column, accuracy: int) -> Column:
    """Aggregate: a mergeable sketch of the values that are neither NULL nor NaN."""
    return F.kll_sketch_agg_double(x.cast("double"), accuracy)


def middle(sketched: Column) -> Column:
    """Lower median of a sketch; NULL if it holds no value."""
    return F.when(F.kll_sketch_get_n_double(sketched) > 0, F.kll_sketch_get_quantile_double(sketched, F.lit(0.5)))


def median(df: DataFrame, c: str, accuracy: int) -> Column:
    """Aggregate: the lower median of a column, in its own type."""
    return middle(sketch(F.col(c), accuracy)).cast(df.schema[c].dataType)


def grouped_stats(df: DataFrame, keys: list[str], means: Iterable[str] = (), medians: Iterable[str] = (),
                  accuracy: int = 10000, mean_suffix: str = "_mean", median_suffix: str = "_median") -> DataFrame:
    """Per group: ``avg`` of ``means`` and approximate median of ``medians``."""
    aggs = [F.avg(F.col(c)).alias(c + mean_suffix) for c in present(df, means)]
    aggs += [median(df, c, accuracy).alias(c + median_suffix) for c in present(df, medians)]
    return df.groupBy(*keys).agg(*aggs)


def two_level_stats(df: DataFrame, entity: str, month: str, means: Mapping[str, Column], medians: Mapping[str, Column],
                    accuracy: int = 10000, flag: str = "__g") -> DataFrame:
    """Means and medians (output name -> expression) per (entity, month), with ``flag`` = 0, and per month, with ``flag`` = 1 and
    entity NULL. The rows are aggregated once, by (entity, month), into sums, counts and sketches; both levels merge these."""
    parts = [f for i, x in enumerate(means.values()) for f in (
        F.sum(x.cast("double")).alias(f"__s{i}"), F.count(x).alias(f"__n{i}"))]
    parts += [sketch(x, accuracy).alias(f"__q{i}") for i, x in enumerate(medians.values())]
    fine = df.groupBy(entity, month).agg(*parts) if parts else df.select(entity, month).distinct()
    both = [F.try_divide(F.sum(f"__s{i}"), F.sum(f"__n{i}")).alias(name) for i, name in enumerate(means)]
    both += [middle(F.kll_merge_agg_double(f"__q{i}", accuracy)).alias(name) for i, name in enumerate(medians)]
    return fine.groupingSets([[entity, month], [month]], entity, month).agg(F.grouping(entity).alias(flag), *both)


def mean_by(df: DataFrame, keys: list[str], cols: Iterable[str]) -> DataFrame:
    return grouped_stats(df, keys, means=cols)


def median_by(df: DataFrame, keys: list[str], cols: Iterable[str], accuracy: int = 10000) -> DataFrame:
    return grouped_stats(df, keys, medians=cols, accuracy=accuracy)


def median_excluding_tokens(df: DataFrame, keys: list[str], col: str, tokens: Iterable[str] = CLEAN_TOKENS,
                            accuracy: int = 10000) -> DataFrame:
    """Approximate median of the values that are not missing tokens (text is
    trimmed, tokens and blanks dropped, then ``try_cast`` to double)."""
    s = F.trim(F.col(col).cast("string"))
    v = F.when(s == "", F.lit(None)).otherwise(nullify_tokens(F.upper(s), list(tokens)))
    x = F.when(v.isNull(), F.lit(None)).otherwise(s).try_cast("double")
    return df.groupBy(*keys).agg(middle(sketch(x, accuracy)).alias(f"{col}_median"))


def value_counts(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, target, count) over the non-NULL values of ``target``."""
    return (df.filter(F.col(target).isNotNull())
              .groupBy(*keys, target).agg(F.count(F.lit(1)).alias("count")))


def mode_by_group(df: DataFrame, keys: list[str], target: str, alias: str | None = None) -> DataFrame:
    """Most frequent non-NULL value per group; ties go to the smallest value.

    Two aggregates, no window: the minimum of (-count, value) per group.
    """
    best = F.min(F.struct((-F.col("count")).alias("neg_count"), F.col(target).alias("v")))
    return (value_counts(df, keys, target).groupBy(*keys).agg(best.alias("__best"))
            .select(*keys, F.col("__best.v").alias(alias or target)))


def _modes(df: DataFrame, sets: list[list[str]], targets: list[str], names: list[str]) -> DataFrame:
    """Modes of the targets for every key set: the keys, ``__g_<key>`` (1 where a
    set leaves the key out) and a column for each target.

    The (column, value) pairs are unfolded into rows, every value in a field of
    its own type, and counted in ONE grouping-sets pass; a second aggregate
    takes the minimum of (-count, value), so ties go to the smallest value.
    """
    keys = list(dict.fromkeys(k for ks in sets for k in ks))
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [f"__v{i}" for i in range(len(targets))]
    pairs = F.array(*[F.struct(F.lit(i).alias("__col"), *[
        (F.col(t) if j == i else F.lit(None).cast(types[targets[j]])).alias(f) for j, f in enumerate(fields)])
        for i, t in enumerate(targets)])
    long = df.select(*keys, F.inline(pairs)).filter(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())
    flags = [f"__g_{k}" for k in keys]
    counts = long.groupingSets([[*ks, "__col", *fields] for ks in sets], *keys, "__col", *fields).agg(
        F.count(F.lit(1)).alias("count"), *[F.grouping(k).alias(f) for k, f in zip(keys, flags)])

    def best(i):
        struct = F.struct((-F.col("count")).alias("n"), F.col(fields[i]).alias("v"))
        return F.min(F.when(F.col("__col") == i, struct))["v"].alias(names[i])
    return counts.groupBy(*keys, *flags).agg(*[best(i) for i in range(len(targets))])


def modes_by_group(df: DataFrame, keys: list[str], targets: Iterable[str], suffix: str = "_mode") -> DataFrame:
    """Mode of several columns per group, in one pass over the frame."""
    targets = present(df, targets)
    if not targets:
        return df.select(*keys).distinct()
    names = [t + suffix for t in targets]
    return _modes(df, [list(keys)], targets, names).select(*keys, *names)


def modes_by_sets(df: DataFrame, sets: list[list[str]], targets: Iterable[str],
                  suffixes: list[str]) -> list[DataFrame]:
    """``modes_by_group`` for several key sets in one pass over the frame."""
    targets = present(df, targets)
    if not targets:
        return [df.select(*ks).distinct() for ks in sets]
    found = _modes(df, sets, targets, [f"{t}__mode" for t in targets])
    keys = list(dict.fromkeys(k for ks in sets for k in ks))
    return [found.filter(reduce(and_, [F.col(f"__g_{k}") == int(k not in ks) for k in keys])).select(
        *ks, *[F.col(f"{t}__mode").alias(t + suffix) for t in targets]) for ks, suffix in zip(sets, suffixes)]


def modes_two_levels(df: DataFrame, entity: str, month: str, targets: Iterable[str],
                     flag: str = "__g") -> DataFrame:
    """Modes per (entity, month) and per month in one frame: rows with
    ``flag`` = 0 are (entity, month) groups, ``flag`` = 1 month groups (entity NULL)."""
    targets = present(df, targets)
    found = _modes(df, [[entity, month], [month]], targets, [f"__m_{t}" for t in targets])
    return found.select(entity, month, F.col(f"__g_{entity}").alias(flag), *[F.col(f"__m_{t}").alias(t) for t in targets])


def join_counts_to_max(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Group counts joined with their per-group maximum (equi-join on keys).

    The maximum is a partial aggregate, and the join of a hot key is split by
    AQE's skew handling, so no group is gathered into one task."""
    counts = value_counts(df, keys, target)
    mx = counts.groupBy(*keys).agg(F.max("count").alias("max_count"))
    return counts.join(mx, keys, "inner").filter(F.col("count") == F.col("max_count")).drop("max_count")


def mode_by_group_ties(df: DataFrame, keys: list[str], target: str, method: str = "join") -> DataFrame:
    """All values reaching the group's maximum count (ties kept).

    ``method="window"``: ``max(count) over (partition by keys)`` (one task per
    group: only for groups of bounded size); default: the skew-safe join."""
    if method == "window":
        counts = value_counts(df, keys, target)
        mx = F.max("count").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
        return counts.withColumn("__max", mx).filter(F.col("count") == F.col("__max")).drop("__max")
    return join_counts_to_max(df, keys, target)


def top1_per_group(df: DataFrame, keys: list[str], target: str, method: str = "aggregate") -> DataFrame:
    """The first value per group by count desc, value asc, with its count.

    ``method="window"`` is the literal ``row_number() ... = 1`` (one task per
    group); the default is the same choice as ``min(struct(-count, value))``,
    an aggregate that combines map-side, so a hot group never lands in one task.
    """
    counts = value_counts(df, keys, target)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(F.desc("count"), F.col(target))
        return counts.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(target).alias("v")))
    return (counts.groupBy(*keys).agg(best.alias("__b"))
            .select(*keys, F.col("__b.v").alias(target), (-F.col("__b.n")).alias("count")))


def circular_mean_by(df: DataFrame, keys: list[str], dir_cols: Iterable[str], eps: float = 1e-9,
                     suffix: str = "_mon") -> DataFrame:
    """Per group and compass column: the mean unit vector, re-normalised.

    avg(cos), avg(sin) of the known labels; a norm not above ``eps`` (or no
    known label) gives (0, 0). All columns in one aggregate.
    """
    aggs = []
    for c in present(df, dir_cols):
        r = direction_to_radians(c)
        aggs += [F.avg(F.cos(r)).alias(f"{c}{suffix}_ux"), F.avg(F.sin(r)).alias(f"{c}{suffix}_uy")]
    g = df.groupBy(*keys).agg(*aggs)
    outs = {}
    for c in present(df, dir_cols):
        x, y = normalize_xy(F.col(f"{c}{suffix}_ux"), F.col(f"{c}{suffix}_uy"), eps)
        outs[f"{c}{suffix}_ux"], outs[f"{c}{suffix}_uy"] = x, y
    return g.withColumns(outs)
