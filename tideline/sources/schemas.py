"""Fixed table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the raw CSV files, in file order, all text.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "online_retail": (
        "invoice_no",
        "stock_code",
        "description",
        "quantity",
        "invoice_date",
        "unit_price",
        "customer_id",
        "country",
        "total_price",
    ),
    "product_events": (
        "user_id",
        "channel",
        "event_name",
        "event_timestamp",
        "amount",
        "is_fraud",
        "kyc_result",
    ),
    "ab_test": ("customer_id", "variant", "converted"),
    "acquisition_costs": ("channel", "month", "acquisition_cost_pen"),
}

# Types of the curated columns that are not text.
CURATED_TYPES: dict[str, dict[str, T.DataType]] = {
    "online_retail": {
        "quantity": T.IntegerType(),
        "invoice_date": T.TimestampNTZType(),
        "unit_price": T.DoubleType(),
        # Wider than the reference's 32 bits, which larger sources exceed.
        "customer_id": T.LongType(),
        "total_price": T.DoubleType(),
    },
    "product_events": {
        "event_timestamp": T.TimestampNTZType(),
        "amount": T.DoubleType(),
        "is_fraud": T.BooleanType(),
    },
}

# Partition columns of both curated tables, unpadded text.
PARTITION_COLUMNS: tuple[str, str] = ("year", "month")


def raw_schema(table: str) -> T.StructType:
    """All-text schema of a raw table, bound to the file by position."""
    return T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS[table]])


def curated_schema(table: str) -> T.StructType:
    """Typed schema of a curated table with its partition columns last."""
    types = CURATED_TYPES[table]
    names = RAW_COLUMNS[table] + PARTITION_COLUMNS
    return T.StructType([T.StructField(name, types.get(name, T.StringType())) for name in names])
