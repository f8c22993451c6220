"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.ratios import exact_sum, rounded_money
from tideline.operators import abtest, cleaning, cohorts, engagement, funnel, metrics, product
from tideline.operators.results import DAU_VIEW, FIRST_PURCHASE_VIEW, MONTHLY_TRANSACTIONS_VIEW, register_views
from tideline.plans import mappings
from tideline.plans.storage import shared_folder, written
from tideline.sources import (
    curate_product_events,
    curate_retail,
    export_csv,
    own_database,
    read_curated,
    read_raw,
    read_retail_source,
    refresh_partitions,
    register_curated,
    write_curated,
    write_raw,
)
from tideline.sources.schemas import RAW_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]


def retail_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines through raw CSV and curated Parquet, counted per partition."""
    folder = shared_folder(spark)
    write_raw(cleaning.clean_retail(mappings.retail_source(spark, sf_dir)), f"{folder}/raw")
    raw = read_raw(spark, f"{folder}/raw", "online_retail")
    write_curated(curate_retail(raw), f"{folder}/curated")
    return (
        read_curated(spark, f"{folder}/curated", "online_retail")
        .groupBy("year", "month")
        .agg(
            F.count("*").alias("lines"),
            F.count_distinct("invoice_no").alias("invoices"),
            F.max("customer_id").alias("last_customer"),
            F.sum("quantity").alias("units"),
            F.min("invoice_date").alias("first_invoice"),
            F.max("description").alias("last_description"),
            rounded_money(exact_sum("total_price")).alias("revenue"),
        )
    )


def events_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events through curated Parquet into the step funnel."""
    folder = shared_folder(spark)
    curated = curate_product_events(mappings.raw_product_events(spark, sf_dir))
    write_curated(curated, f"{folder}/curated", cluster_by=["event_name"])
    return product.step_funnel(read_curated(spark, f"{folder}/curated", "product_events"))


def retail_sources_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uncleaned exports, one without descriptions, read back and cleaned.

    One pass over the joined lines writes both: rows go to the folder of their export.
    """
    folder = f"{shared_folder(spark)}/exports"
    older = F.coalesce(F.col("InvoiceDate") < F.lit("1998-01-01").cast("date"), F.lit(False))
    lines = mappings.retail_source(spark, sf_dir).withColumns(
        {"Description": F.when(older, F.col("Description")), "export": F.when(older, "older").otherwise("newer")}
    )
    text = {"header": "true", "encoding": "ISO-8859-1", "escape": '"'}
    lines.write.partitionBy("export").options(**text).csv(folder)
    source = read_retail_source(spark, [f"{folder}/export={name}" for name in ("older", "newer")])
    return (
        cleaning.clean_retail(source)
        .groupBy("Country")
        .agg(
            F.count("*").alias("lines"),
            F.count("Description").alias("described"),
            F.sum("Quantity").alias("units"),
            F.max("InvoiceDate").alias("last_invoice"),
            rounded_money(exact_sum("TotalPrice")).alias("revenue"),
        )
    )


def events_csv_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV events, with their empty texts and fractions of seconds, curated, into the step funnel."""
    return product.step_funnel(_curated_csv_events(spark, sf_dir))


def events_csv_kyc_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into the identity check rates."""
    return metrics.kyc_rates(_curated_csv_events(spark, sf_dir))


def _curated_csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/events"
    write_raw(mappings.raw_product_events(spark, sf_dir), path)
    return curate_product_events(read_raw(spark, path, "product_events"))


def _csv_ab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ab_test"
    write_raw(mappings.ab_test(spark, sf_dir).select(*RAW_COLUMNS["ab_test"]), path)
    return read_raw(spark, path, "ab_test")


def cac_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per new user from raw CSV costs."""
    path = f"{shared_folder(spark)}/costs"
    write_raw(mappings.channel_costs(spark, sf_dir), path)
    return metrics.cac(mappings.order_events(spark, sf_dir), read_raw(spark, path, "acquisition_costs"))


def catalog_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated events registered in a database, their partitions recovered, counted through SQL.

    The counts are kept as a table of their own, so the database is dropped before they are
    returned, and a call leaves nothing in the catalog.
    """
    folder = shared_folder(spark)
    write_curated(curate_product_events(mappings.raw_product_events(spark, sf_dir)), f"{folder}/events")
    database = "tideline_" + folder.rpartition("-")[2].replace("/", "_")
    with own_database(spark, database):
        register_curated(spark, f"{database}.product_events", f"{folder}/events", "product_events")
        refresh_partitions(spark, f"{database}.product_events")
        spark.sql(
            f"CREATE OR REPLACE VIEW {database}.pagos AS SELECT * FROM {database}.product_events "
            "WHERE event_name IN ('first_transaction', 'repeat_transaction')"
        )
        counted = spark.sql(
            f"SELECT e.year, e.month, e.eventos, coalesce(p.pagos, 0) AS pagos "
            f"FROM (SELECT year, month, count(*) AS eventos FROM {database}.product_events GROUP BY ALL) e "
            f"LEFT JOIN (SELECT year, month, count(*) AS pagos FROM {database}.pagos GROUP BY ALL) p "
            "ON e.year = p.year AND e.month = p.month"
        )
        return written(counted, f"{folder}/counts")


def retail_by_month_and_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and revenue of every month and country, from the curated layer's partitions."""
    path = f"{shared_folder(spark)}/retail"
    write_curated(_curated_retail(spark, sf_dir), path)
    return read_curated(spark, path, "online_retail").groupBy("year", "month", "country").agg(
        F.count("*").alias("lines"), rounded_money(exact_sum("total_price")).alias("revenue")
    )


def views_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views through SQL: per month, new customers, active users and payment volume."""
    register_views(mappings.transactions(spark, sf_dir), mappings.product_events(spark, sf_dir))
    return spark.sql(
        f"""
        WITH acquired AS (
            SELECT substring(CAST(acquisition_cohort_month AS STRING), 1, 7) AS month, count(*) AS customers,
                   min(first_purchase_date) AS earliest
            FROM {FIRST_PURCHASE_VIEW} GROUP BY 1),
        active AS (
            SELECT substring(CAST(activity_day AS STRING), 1, 7) AS month, count(*) AS days, max(dau) AS most_users
            FROM {DAU_VIEW} GROUP BY 1),
        paid AS (
            SELECT month, count(*) AS payments, count_if(is_fraud) AS frauds FROM {MONTHLY_TRANSACTIONS_VIEW} GROUP BY 1)
        SELECT month, customers, earliest, days, most_users, payments, frauds
        FROM acquired FULL JOIN active USING (month) FULL JOIN paid USING (month)"""
    )


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort matrix through a result file."""
    path = f"{shared_folder(spark)}/cohorts"
    export_csv(cohorts.cohort_matrix(mappings.transactions(spark, sf_dir)), path)
    columns = (
        "cohort_month STRING, month_number BIGINT, cohort_customers BIGINT, "
        "active_customers BIGINT, pct_retained DOUBLE"
    )
    exported = spark.read.schema(columns).csv(path, header=True)
    return exported.withColumn("cohort_month", F.to_date(F.substring("cohort_month", 1, 10)))


def _curated_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_retail(mappings.retail_source(spark, sf_dir))
    return curate_retail(
        cleaned.select(
            F.col("InvoiceNo").alias("invoice_no"),
            F.col("StockCode").alias("stock_code"),
            F.col("Description").alias("description"),
            F.col("Quantity").cast("string").alias("quantity"),
            F.col("InvoiceDate").cast("string").alias("invoice_date"),
            F.col("UnitPrice").cast("string").alias("unit_price"),
            F.col("CustomerID").cast("string").alias("customer_id"),
            F.col("Country").alias("country"),
            F.col("TotalPrice").cast("string").alias("total_price"),
        )
    )


def _rounded(frame: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    """Float sums rounded: their last digits depend on the order of addition."""
    return frame.withColumns({name: F.round(name, digits) for name in names})


def _query(operator: Callable[..., DataFrame], *inputs: Query) -> Query:
    return lambda spark, sf_dir: operator(*(read(spark, sf_dir) for read in inputs))


QUERIES: dict[str, Query] = {
    "first_purchase": _query(funnel.first_purchase, mappings.transactions),
    "activation": _query(funnel.activation, mappings.transactions),
    "acquisition_funnel": _query(funnel.acquisition_funnel, mappings.transactions),
    "cohort_matrix": _query(cohorts.cohort_matrix, mappings.transactions),
    "retention_alert": _query(cohorts.retention_alert, mappings.transactions),
    "ab_rates": _query(abtest.ab_rates, mappings.ab_test),
    "ab_difference": _query(
        lambda ab: _rounded(
            abtest.ab_difference(ab), "tasa_control", "tasa_test", "diferencia_absoluta", digits=12
        ),
        mappings.ab_test,
    ),
    "ab_significance": _query(lambda ab: _rounded_test(abtest.ab_significance(ab)), mappings.ab_test),
    "ab_significance_by_experiment": _query(
        lambda ab: _rounded_test(abtest.ab_significance(ab, by="experiment")), mappings.ab_test
    ),
    "step_funnel": _query(product.step_funnel, mappings.product_events),
    "step_times": _query(product.step_times, mappings.product_events),
    "users_per_event": _query(product.users_per_event, mappings.product_events),
    "dau": _query(engagement.dau, mappings.engagement_events),
    "rolling_active_users": _query(engagement.rolling_active_users, mappings.engagement_events),
    "rolling_active_users_orders": _query(
        lambda tx: engagement.rolling_active_users(tx, "customer_id", "invoice_date"),
        mappings.transactions,
    ),
    "rolling_active_users_with_today": _query(
        lambda events: engagement.rolling_active_users(events, days=7, include_current_day=True),
        mappings.engagement_events,
    ),
    "stickiness_weekly": _query(engagement.stickiness_weekly, mappings.engagement_events),
    "cac": _query(metrics.cac, mappings.order_events, mappings.channel_costs),
    "kyc_rates": _query(metrics.kyc_rates, mappings.product_events),
    "kyc_rates_customers": _query(metrics.kyc_rates, mappings.customer_checks),
    "monthly_transactions": _query(metrics.monthly_transactions, mappings.order_events),
    "tpv": _query(metrics.tpv, mappings.order_events),
    "arpu": _query(metrics.arpu, mappings.order_events),
    "ltv": _query(metrics.ltv, mappings.order_events),
    "ltv_to_cac": _query(metrics.ltv_to_cac, mappings.order_events, mappings.channel_costs),
    "fraud_rate": _query(metrics.fraud_rate, mappings.order_events),
    "clean_retail": _query(cleaning.clean_retail, mappings.retail_source),
    "clean_retail_stats": _query(cleaning.clean_retail_stats, mappings.retail_source),
    "curate_retail": _curated_retail,
    "curate_product_events": _query(curate_product_events, mappings.raw_product_events),
    "retail_sources_roundtrip": retail_sources_roundtrip,
    "retail_csv_roundtrip": retail_csv_roundtrip,
    "events_parquet_roundtrip": events_parquet_roundtrip,
    "export_roundtrip": export_roundtrip,
    "events_csv_funnel": events_csv_funnel,
    "events_csv_kyc_rates": events_csv_kyc_rates,
    "ab_rates_csv": _query(abtest.ab_rates, _csv_ab_test),
    "ab_significance_csv": _query(lambda ab: _rounded_test(abtest.ab_significance(ab)), _csv_ab_test),
    "cac_csv": cac_csv,
    "catalog_partitions": catalog_partitions,
    "retail_by_month_and_country": retail_by_month_and_country,
    "views_in_sql": views_in_sql,
}


def _rounded_test(result: DataFrame) -> DataFrame:
    return _rounded(
        result,
        "tasa_control",
        "tasa_test",
        "diferencia_absoluta",
        "diferencia_relativa_pct",
        "z_score",
        "p_value",
        digits=9,
    )
