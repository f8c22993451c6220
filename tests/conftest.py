import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from tideline import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[*]",
        app="tideline-tests",
        spark__sql__shuffle__partitions="8",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Builds product events from (user, name, time[, amount, fraud, result, channel])."""

    def build(*rows):
        padded = [tuple(row) + (None,) * (7 - len(row)) for row in rows]
        raw = spark.createDataFrame(
            padded,
            "user_id string, event_name string, event_timestamp string, amount double, "
            "is_fraud boolean, kyc_result string, channel string",
        )
        return raw.withColumn("event_timestamp", raw.event_timestamp.cast("timestamp_ntz"))

    return build


@pytest.fixture
def purchases(spark):
    """Builds transactions from (customer, time)."""

    def build(*rows):
        raw = spark.createDataFrame(list(rows), "customer_id int, invoice_date string")
        return raw.withColumn("invoice_date", raw.invoice_date.cast("timestamp_ntz"))

    return build
