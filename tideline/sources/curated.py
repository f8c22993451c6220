"""Typed Parquet tables, partitioned by year and month."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.schemas import PARTITION_COLUMNS, RAW_COLUMNS, curated_schema

# Fixed value: timestamp text of the raw files, whole seconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _typed(table: str, parsed_at: Column, clock: str, values: dict[str, Column]) -> list[Column]:
    fields = {field.name: field.dataType for field in curated_schema(table).fields}
    columns = [
        (parsed_at if name == clock else values.get(name, F.col(name)).cast(fields[name])).alias(name)
        for name in RAW_COLUMNS[table]
    ]
    partitions = [
        F.year(parsed_at).cast("string").alias("year"),
        F.month(parsed_at).cast("string").alias("month"),
    ]
    return columns + partitions


def curate_retail(raw: DataFrame) -> DataFrame:
    """Typed retail lines. Malformed numbers or dates raise (ANSI casts)."""
    parsed_at = F.to_timestamp_ntz(F.col("invoice_date"), F.lit(TIMESTAMP_FORMAT))
    return raw.select(*_typed("online_retail", parsed_at, "invoice_date", {}))


def curate_product_events(raw: DataFrame) -> DataFrame:
    """Typed product events; fractions of a second go, empty text becomes NULL."""
    whole_seconds = F.substring("event_timestamp", 1, 19)
    parsed_at = F.to_timestamp_ntz(whole_seconds, F.lit(TIMESTAMP_FORMAT))
    optional = {
        name: F.nullif(F.col(name), F.lit("")) for name in ("amount", "is_fraud", "kyc_result")
    }
    return raw.select(*_typed("product_events", parsed_at, "event_timestamp", optional))


def write_curated(
    curated: DataFrame,
    path: str,
    mode: str = "errorifexists",
    cluster_by: Sequence[str] = (),
    rebalance: bool = True,
) -> None:
    """Snappy Parquet under ``year=…/month=…``.

    Rows are rebalanced on the partition columns first, so a month becomes a few
    files rather than one per input task. Adaptive execution splits a month that
    is larger than the advisory partition size over several tasks, so a month
    with a third of all rows is not one task's work. ``cluster_by`` sorts inside
    each file (``event_name`` lets readers skip row groups). Turn ``rebalance``
    off when the input already arrives month by month: it saves the shuffle.
    """
    if rebalance:
        curated = curated.hint("rebalance", *PARTITION_COLUMNS)
    if cluster_by:
        curated = curated.sortWithinPartitions(*PARTITION_COLUMNS, *cluster_by)
    writer = curated.write.mode(mode).partitionBy(*PARTITION_COLUMNS)
    writer.option("compression", "snappy").parquet(path)


def read_curated(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Curated table by path; the fixed schema keeps year and month as text."""
    return spark.read.schema(curated_schema(table)).parquet(path)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


@contextmanager
def own_database(spark: SparkSession, name: str) -> Iterator[str]:
    """A database for the length of a ``with`` block; it goes with all its entries, also on errors.

    Files of external tables stay. Frames over its tables must be read or written inside the block.
    """
    spark.sql(f"CREATE DATABASE {name}")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def register_curated(spark: SparkSession, name: str, path: str, table: str) -> None:
    """Catalog entry over curated files; run :func:`refresh_partitions` after."""
    columns = ", ".join(
        f"{field.name} {field.dataType.simpleString()}" for field in curated_schema(table).fields
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{path}'"
    )


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Register partition folders that another writer added to the table."""
    spark.catalog.recoverPartitions(name)
