"""Column expressions for missing values and token handling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprep.rules import CLEAN_TOKENS, PROFILE_TOKENS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column, tokens: Iterable[str] = PROFILE_TOKENS, trim_tokens: bool = False) -> Column:
    """NULL, blank after trim, or a missing token (compared lower-case).

    ``trim_tokens=False`` keeps the literal rule: ``" NA "`` is not a token.
    Never NULL itself, so it can be summed or negated safely.
    """
    s = _col(c).cast("string")
    low = F.lower(F.trim(s) if trim_tokens else s)
    toks = [t.lower() for t in tokens]
    return F.coalesce(s.isNull() | (F.trim(s) == "") | low.isin(*toks), F.lit(True))


def nullify_tokens(c: str | Column, tokens: Iterable[str] = CLEAN_TOKENS) -> Column:
    """Token values become NULL; everything else is kept as is."""
    v = _col(c)
    return F.when(v.cast("string").isin(*list(tokens)), F.lit(None)).otherwise(v)


def all_present(cols: Iterable[str], tokens: Iterable[str] = PROFILE_TOKENS) -> Column:
    """True when none of the columns is missing (AND over all of them)."""
    preds = [~is_missing(c, tokens) for c in cols]
    return reduce(and_, preds, F.lit(True))


def any_true(preds: list[Column]) -> Column:
    """OR of predicates; an empty list is false."""
    return reduce(or_, preds) if preds else F.lit(False)
