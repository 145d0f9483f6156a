"""Row neighbours (lag/lead by one) per entity in time order, skew-safe.

The frame is written once with a row number, which ends every tie of the order,
so whatever comes before it runs once. One narrow aggregate over the
written table counts the rows of the entities. If the largest entity has at most
``rows_per_range`` rows, a plain window per entity is a bounded task and needs one
shuffle. Otherwise the written table is range-partitioned by (entity, order, row
number) into ranges of about that many rows: tasks have equal shares
however rows are spread over entities and times. The window then runs over
(range, entity), and the rows at the edges of a range take their neighbour
from the adjacent one through a table with one row for each (range, entity), joined on
the columns the window is partitioned by, so the frame is not shuffled again. Both give the
plain window over the same total order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, ShortType, StringType, TimestampNTZType, TimestampType)

from tabprep.functions.names import unused
from tabprep.session import materialize

PREV, NEXT = "_prev", "_next"
#: Rows of an entity, or of a range of several, that one task takes.
ROWS_PER_RANGE = 1_000_000


def _non_null_key(df: DataFrame, col: str) -> tuple[Column, Column]:
    """(value with NULL replaced by a default of its type, is-NULL flag): a
    non-NULL pair that groups exactly like the column (NULLs together)."""
    t = df.schema[col].dataType
    c = F.col(col)
    if isinstance(t, StringType):
        d = F.lit("")
    elif isinstance(t, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)):
        d = F.lit(0).cast(t)
    elif isinstance(t, DateType):
        d = F.lit(dt.date(1970, 1, 1))
    elif isinstance(t, (TimestampType, TimestampNTZType)):
        d = F.lit(dt.datetime(1970, 1, 1)).cast(t)
    elif isinstance(t, BooleanType):
        d = F.lit(False)
    else:  # nested columns: their JSON text groups the same way
        return F.coalesce(F.to_json(F.struct(c)), F.lit("")), c.isNull()
    return F.coalesce(c, d), c.isNull()


def neighbour_values(df: DataFrame, entity: str | list[str], order: list[str], cols: Iterable[str],
                     bucket: str | None = "auto", prev_suffix: str = PREV, next_suffix: str = NEXT,
                     max_gap_days: int | None = None, written: list | None = None,
                     rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``<c>_prev`` / ``<c>_next``: the value of the previous / next row of
    the same entity in ``order`` (NULL at the entity's first / last row).

    ``bucket``: "auto" counts the rows of the entities and goes by entity or by
    range; "range" always goes by range; None is the literal form, one
    window partition per entity and no written table. ``max_gap_days``: a
    neighbour further away than that in ``order[0]`` (a date or timestamp)
    counts as absent. The written tables' paths are appended to ``written``.
    """
    cols = list(cols)
    if not cols:
        return df
    entities = [entity] if isinstance(entity, str) else list(entity)
    taken = list(dict.fromkeys([*cols, *([order[0]] if max_gap_days is not None else [])]))
    near = {c: (unused(df.columns, f"__p{i}"), unused(df.columns, f"__n{i}")) for i, c in enumerate(taken)}
    both = near.__getitem__
    if bucket is None:
        d = _by_entity(df, entities, order, taken, both)
    elif bucket in ("auto", "range"):
        row = unused(df.columns, "__row")
        t = materialize(df.withColumn(row, F.monotonically_increasing_id()), "neighbours", written)
        sizes = t.groupBy(*entities).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        if bucket == "auto" and (sizes.most or 0) <= rows_per_range:
            d = _by_entity(t, entities, [*order, row], taken, both)
        else:
            parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sizes.total or 0) // rows_per_range + 1)
            d = _by_range(t, entities, [*order, row], taken, both, parts, written)
    else:
        raise ValueError("bucket must be 'auto', 'range' or None")

    def value(c, which):
        if max_gap_days is None:
            return F.col(both(c)[which])
        gap = F.abs(F.datediff(F.col(order[0]), F.col(both(order[0])[which])))
        return F.when(gap <= max_gap_days, F.col(both(c)[which]))

    added = {f"{c}{s}": value(c, which) for c in cols for which, s in enumerate((prev_suffix, next_suffix))}
    return d.withColumns(added).select(*[x for x in df.columns if x not in added], *added)


def _by_entity(t: DataFrame, entities, order, cols, both) -> DataFrame:
    w = Window.partitionBy(*entities).orderBy(*order)
    return t.withColumns({n: f(c, 1).over(w) for c in cols for n, f in zip(both(c), (F.lag, F.lead))})


def _by_range(t: DataFrame, entities, order, cols, both, parts: int, written) -> DataFrame:
    own = lambda name: unused([*t.columns, *[n for c in cols for n in both(c)]], name)
    part, place, first, last = (own(n) for n in ("__range", "__place", "__first", "__last"))
    flags = {}
    for i, e in enumerate(entities):
        value, null = _non_null_key(t, e)
        flags |= {own(f"__k{i}"): value, own(f"__k{i}_null"): null}
    sort = [*entities, *order]
    ranged = t.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    r = materialize(ranged, "neighbours-ranged", written).withColumns(flags)
    keys = [part, *flags]
    w = Window.partitionBy(*keys).orderBy(place)
    d = r.withColumns({**{n: f(c, 1).over(w) for c in cols for n, f in zip(both(c), (F.lag, F.lead))},
                       first: F.lag(place, 1).over(w).isNull(), last: F.lead(place, 1).over(w).isNull()})
    # One row for each (range, entity): hash aggregates of fixed-width columns, combined before the shuffle.
    heads, tails = ({c: own(f"{n}{i}") for i, c in enumerate(cols)} for n in ("__head", "__tail"))
    before, after = ({c: own(f"{n}{i}") for i, c in enumerate(cols)} for n in ("__before", "__after"))
    low = own("__lo")
    ends = r.groupBy(*keys).agg(F.min(place).alias(low), *[
        f(F.col(c), F.col(place)).alias(names[c]) for c in cols for names, f in ((heads, F.min_by), (tails, F.max_by))])
    we = Window.partitionBy(*flags).orderBy(low)
    edges = ends.select(*keys, *[F.lag(tails[c], 1).over(we).alias(before[c]) for c in cols],
                        *[F.lead(heads[c], 1).over(we).alias(after[c]) for c in cols])
    fixed = {}
    for c in cols:
        p, q = both(c)
        fixed[p] = F.when(F.col(first), F.col(before[c])).otherwise(F.col(p))
        fixed[q] = F.when(F.col(last), F.col(after[c])).otherwise(F.col(q))
    return d.join(edges, keys, "left").withColumns(fixed)
