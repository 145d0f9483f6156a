"""Lookup joins of fitted statistics back onto observation frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.session import materialize

#: 12 months and NULL.
MONTH_ROWS = 13


def month_table(stats: DataFrame, is_written: bool = False) -> DataFrame:
    """A table of month statistics, written once (unless it is read from a written table) and hinted for broadcast if it
    does have at most MONTH_ROWS rows; a larger one (the column is no calendar month) is left to AQE."""
    stats = stats if is_written else materialize(stats, "month-stats")
    return F.broadcast(stats) if stats.limit(MONTH_ROWS + 1).count() <= MONTH_ROWS else stats


def month_values(rows: list, month: str, columns: Iterable[str]) -> dict[str, Column]:
    """Column name -> the month's value, from the collected rows of a month table of at most MONTH_ROWS rows: literals
    in the plan, so that a second lookup of the table needs no second join."""
    known = [r for r in rows if r[month] is not None]

    def value(c):
        pairs = [x for r in known if r[c] is not None for x in (F.lit(r[month]), F.lit(r[c]))]
        return F.try_element_at(F.create_map(*pairs), F.col(month)) if pairs else F.lit(None)
    return {c: value(c) for c in columns}


def lookup_left_month(df: DataFrame, stats: DataFrame, month: str = "Month") -> DataFrame:
    return df.join(stats, month, "left")


def lookup_left_entity_month(df: DataFrame, stats: DataFrame, entity: str = "Location",
                             month: str = "Month") -> DataFrame:
    """No hint: AQE measures the statistics at run time."""
    return df.join(stats, [entity, month], "left")
