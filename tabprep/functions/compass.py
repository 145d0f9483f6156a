"""Compass labels as angles and unit vectors (no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprep.rules import COMPASS_POINTS, COMPASS_STEP_DEGREES


def compass_degrees() -> dict[str, float]:
    """Label -> degrees, built from the point list and the step."""
    return {p: i * COMPASS_STEP_DEGREES for i, p in enumerate(COMPASS_POINTS)}


def _compass_map() -> Column:
    pairs = [(F.lit(k), F.lit(v)) for k, v in compass_degrees().items()]
    return F.create_map(*chain.from_iterable(pairs))


def direction_to_radians(c: str | Column) -> Column:
    """Compass label -> radians; unknown labels and NULL give NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.radians(F.element_at(_compass_map(), col))


def unit_norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def normalize_xy(x: Column, y: Column, eps: float = 1e-9) -> tuple[Column, Column]:
    """Divide (x, y) by its norm; norm not above ``eps`` (or NULL) -> (0, 0)."""
    n = unit_norm(x, y)
    ok = n > F.lit(eps)
    return (F.when(ok, x / n).otherwise(F.lit(0.0)),
            F.when(ok, y / n).otherwise(F.lit(0.0)))
