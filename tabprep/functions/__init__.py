"""Scalar column expressions."""

from tabprep.functions.compass import direction_to_radians, normalize_xy, unit_norm
from tabprep.functions.missing import all_present, any_true, is_missing, nullify_tokens

__all__ = [
    "all_present", "any_true", "direction_to_radians", "is_missing",
    "normalize_xy", "nullify_tokens", "unit_norm",
]
