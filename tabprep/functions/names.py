"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from every name in ``taken`` (case aside)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
