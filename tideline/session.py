"""Session settings the operators are tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tideline", **conf: str) -> SparkSession:
    """Session with UTC time, ANSI casts and string partition columns.

    ``conf`` takes further settings with ``__`` in place of the dots, e.g.
    ``spark__sql__shuffle__partitions="8"``. Nothing here fixes the degree of
    parallelism: on a cluster that is the job's own setting, and adaptive
    execution sizes the partitions below it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # year and month are text in the curated layer ("2024", "1").
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
