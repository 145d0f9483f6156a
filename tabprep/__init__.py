"""tabprep: profile, split, clean, impute and prepare tabular observations on Spark."""

__version__ = "0.1.0"
