"""CSV inputs. No schema inference: every column is read as text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.schemas import RAW_COLUMNS, raw_schema

# Text fields hold commas and doubled quotes, so the quote escapes itself.
_CSV = {"header": "true", "sep": ",", "quote": '"', "escape": '"'}


def read_raw(
    spark: SparkSession, path: str | Sequence[str], table: str, multi_line: bool = False
) -> DataFrame:
    """Raw CSV of one of the fixed tables; names come from position, not header.

    Each file's first line is skipped. Files are split across tasks, so a field
    may not contain a line break unless ``multi_line`` is set; a file is then read by
    a single task. A record with too few or too many fields raises, as does the first
    half of one that a line break cut in two.
    """
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(raw_schema(table)).options(
        **_CSV, enforceSchema="true", mode="FAILFAST", multiLine=str(multi_line).lower()
    ).csv(paths)


def register_raw(spark: SparkSession, name: str, path: str, table: str) -> None:
    """Catalog entry over raw CSV files that stay where they are."""
    columns = ", ".join(f"{column} STRING" for column in RAW_COLUMNS[table])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING csv "
        "OPTIONS (header 'true', sep ',', quote '\"', escape '\"', enforceSchema 'true') "
        f"LOCATION '{path}'"
    )


def read_retail_source(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = False,
) -> DataFrame:
    """Uncleaned retail exports, concatenated by column name.

    A column that one source lacks is NULL for its rows. ``multi_line`` allows
    line breaks inside quoted fields; a file is then read by a single task, so
    leave it off unless the files need it. The files of one source share one
    header; one that differs raises rather than being bound by position.
    """
    sources = [paths] if isinstance(paths, str) else list(paths)
    if not sources:
        raise ValueError("no retail source given")
    reader = spark.read.options(
        **_CSV, encoding=encoding, multiLine=str(multi_line).lower(), enforceSchema="false"
    )
    frames = [reader.csv(source) for source in sources]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def write_raw(cleaned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw-layer CSV of a typed frame; times as whole seconds, NULL as empty.

    A line break inside a text raises: readers that split files would cut its record in two.
    """
    broken = F.raise_error(F.lit("a text holds a line break, which raw CSV files cannot"))
    checked = {
        name: F.when(F.col(name).rlike(r"[\r\n]"), broken).otherwise(F.col(name))
        for name, kind in cleaned.dtypes
        if kind == "string"
    }
    cleaned.withColumns(checked).write.mode(mode).options(
        **_CSV,
        timestampFormat="yyyy-MM-dd HH:mm:ss",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
    ).csv(path)
