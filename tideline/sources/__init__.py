"""Raw CSV, curated Parquet and result files."""

from tideline.sources.curated import (
    create_database,
    curate_product_events,
    curate_retail,
    own_database,
    read_curated,
    refresh_partitions,
    register_curated,
    write_curated,
)
from tideline.sources.export import export_csv
from tideline.sources.raw import read_raw, read_retail_source, register_raw, write_raw

__all__ = [
    "create_database",
    "curate_product_events",
    "curate_retail",
    "export_csv",
    "own_database",
    "read_curated",
    "read_raw",
    "read_retail_source",
    "refresh_partitions",
    "register_curated",
    "register_raw",
    "write_curated",
    "write_raw",
]
