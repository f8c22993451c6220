"""Result files for reporting tools."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, every field quoted, and millisecond timestamps.

    Dates are written as midnight, the form reports already expect for day, week
    and month keys. Spark's writer gives NULL as ``""``, not as a bare empty
    field; CSV readers take both for empty.
    """
    result.write.mode(mode).options(
        header="true",
        quoteAll="true",
        quote='"',
        escape='"',
        dateFormat="yyyy-MM-dd 00:00:00.000",
        timestampFormat="yyyy-MM-dd HH:mm:ss.SSS",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSS",
    ).csv(path)
