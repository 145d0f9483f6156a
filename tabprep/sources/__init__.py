"""Sources and sinks: CSV, the driver's parquet tables, the ``obs`` fixture."""

from tabprep.sources.csv import scan_csv, write_csv
from tabprep.sources.fixtures import OBS_LAYOUT, obs, obs_from_orders, obs_with_duplicates, read_table
from tabprep.sources.overview import first_rows, frame_overview

__all__ = ["OBS_LAYOUT", "first_rows", "frame_overview", "obs", "obs_from_orders",
           "obs_with_duplicates", "read_table", "scan_csv", "write_csv"]
