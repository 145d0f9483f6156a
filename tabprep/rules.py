"""Preset rule sets for weather-shaped observation frames.

Everything below the "fixed values" marker must keep these exact values for
results to agree with the surveyed script; operators take plain Python lists
and dicts, so any other frame passes its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the surveyed script's for matching results).
# ---------------------------------------------------------------------------

# Missing-value tokens used by the quality profile (compared lower-case).
PROFILE_TOKENS = ("na", "nan", "null", "n/a", "none", "missing")

# Missing-value tokens used by the cleaning step (compared after upper+trim).
CLEAN_TOKENS = ("NA", "N/A", "NULL", "NONE", "MISSING", "-", "?")

# Yes/no columns and their valid domain.
YES_NO_COLUMNS = ("RainToday", "RainTomorrow")
YES_NO_DOMAIN = ("Yes", "No")

# Truthy / falsy spellings for boolean shares.
TRUE_SPELLINGS = ("true", "yes", "1")
FALSE_SPELLINGS = ("false", "no", "0")

# Compass columns and the 16-point compass, clockwise from north in 22.5° steps.
DIRECTION_COLUMNS = ("WindGustDir", "WindDir9am", "WindDir3pm")
COMPASS_POINTS = (
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
)
COMPASS_STEP_DEGREES = 22.5

# Valid ranges [min, max] of the numeric measures.
RANGES = {
    "Rainfall": (0.0, 1000.0),
    "Evaporation": (0.0, 500.0),
    "Sunshine": (0.0, 24.0),
    "WindGustSpeed": (0.0, 200.0),
    "WindSpeed9am": (0.0, 200.0),
    "WindSpeed3pm": (0.0, 200.0),
    "Humidity9am": (0.0, 100.0),
    "Humidity3pm": (0.0, 100.0),
    "Cloud9am": (0.0, 9.0),
    "Cloud3pm": (0.0, 9.0),
    "Pressure9am": (800.0, 1100.0),
    "Pressure3pm": (800.0, 1100.0),
    "Temp9am": (-50.0, 60.0),
    "Temp3pm": (-50.0, 60.0),
    "MinTemp": (-50.0, 60.0),
    "MaxTemp": (-50.0, 60.0),
}

# Numeric measures, in the order of the statistics report.
NUMERIC_COLUMNS = (
    "MinTemp", "MaxTemp", "Temp9am", "Temp3pm",
    "Rainfall", "Evaporation", "Sunshine",
    "WindGustSpeed", "WindSpeed9am", "WindSpeed3pm",
    "Humidity9am", "Humidity3pm",
    "Pressure9am", "Pressure3pm",
    "Cloud9am", "Cloud3pm",
)

# Filled with the mean ("normal") vs. the median ("non-normal").
MEAN_FILLED = ("MinTemp", "MaxTemp", "Temp9am", "Temp3pm", "Pressure9am", "Pressure3pm")
MEDIAN_FILLED = (
    "Rainfall", "Evaporation", "Sunshine", "Humidity9am", "Humidity3pm",
    "Cloud9am", "Cloud3pm", "WindGustSpeed", "WindSpeed9am", "WindSpeed3pm",
)

# Category filled with the (Location, Month) mode.
MODE_FILLED = ("RainToday",)
# Code columns filled by the mode cascade, and their sentinel code.
MODE_CASCADE = ("Cloud9am", "Cloud3pm")
SENTINEL_COLUMNS = ("Cloud9am", "Cloud3pm")
SENTINEL_CODE = 9
# Median cascade and the extreme-value trim.
MEDIAN_CASCADE = ("Evaporation",)
TRIM_COLUMN = "Evaporation"
TRIM_FRACTION = 1.0 / 1000.0

# Pair averages (output, first, second) and the floored one.
PAIR_AVERAGES = (
    ("Temp_avg", "Temp9am", "Temp3pm"),
    ("Pressure_avg", "Pressure9am", "Pressure3pm"),
    ("Humidity_avg", "Humidity9am", "Humidity3pm"),
    ("WindSpeed_avg", "WindSpeed9am", "WindSpeed3pm"),
)
PAIR_AVERAGES_FLOOR = (("Cloud_avg", "Cloud9am", "Cloud3pm"),)

# Columns dropped before the feature stage.
DROP_COLUMNS = (
    "RainToday", "Location", "Date", "Sunshine",
    "Temp9am", "Temp3pm", "Pressure9am", "Pressure3pm",
    "Humidity9am", "Humidity3pm", "WindSpeed9am", "WindSpeed3pm",
    "Cloud9am", "Cloud3pm", "Month",
)

# Continuous (binned and scaled) feature columns.
CONTINUOUS_COLUMNS = (
    "MinTemp", "MaxTemp", "Temp_avg", "Rainfall", "Evaporation",
    "WindGustSpeed", "WindSpeed_avg", "Humidity_avg", "Pressure_avg",
)

# Split and binning parameters.
SPLIT_SEED = 2025
SPLIT_FRACTIONS = (0.8, 0.2)
BIN_RELATIVE_ERROR = 0.02
BIN_MIN_BUCKETS = 3
BIN_MAX_BUCKETS = 10
DATE_FORMAT = "yyyy-MM-dd"

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Names of the structural columns of an observation frame."""

    entity: str = "Location"
    time: str = "Date"
    month: str = "Month"
    row_id: str | None = None  # tie-breaker inside (entity, time); None = time only
    label: str = "RainTomorrow"

    @property
    def order(self) -> list[str]:
        return [self.time] + ([self.row_id] if self.row_id else [])


@dataclass(frozen=True)
class CleaningSpec:
    """Which columns each cleaning stage acts on (absent columns are skipped)."""

    layout: Layout = field(default_factory=Layout)
    mean_filled: tuple[str, ...] = MEAN_FILLED
    median_filled: tuple[str, ...] = MEDIAN_FILLED
    direction_columns: tuple[str, ...] = DIRECTION_COLUMNS
    yes_no_columns: tuple[str, ...] = YES_NO_COLUMNS
    mode_filled: tuple[str, ...] = MODE_FILLED
    mode_cascade: tuple[str, ...] = MODE_CASCADE
    median_cascade: tuple[str, ...] = MEDIAN_CASCADE
    sentinel_columns: tuple[str, ...] = SENTINEL_COLUMNS
    sentinel_code: int = SENTINEL_CODE
    trim_column: str | None = TRIM_COLUMN
    trim_fraction: float = TRIM_FRACTION
    trim_side: str = "high"
    eps: float = 1e-9
    accuracy: int = 10000
    null_is_ok: bool = False


WEATHER = CleaningSpec()
