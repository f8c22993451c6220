"""Monthly acquisition cohorts and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.ratios import percent


def _active_customers(
    transactions: DataFrame, customer: str, ts: str, last_month: int | None = None
) -> DataFrame:
    """Active customers per cohort and month number, from one set of months per customer.

    Tasks combine the purchases of a customer into a set of month numbers, at most twelve a
    year however many lines the customer has; these sets are the only facts that are shuffled.
    """
    day = F.to_date(ts)
    months = transactions.select(
        F.col(customer).alias("customer_id"), (F.year(day) * 12 + F.month(day) - 1).alias("active")
    ).filter(F.col("customer_id").isNotNull() & F.col("active").isNotNull())
    sets = months.groupBy("customer_id").agg(F.collect_set("active").alias("months"))
    numbered = sets.select(F.array_min("months").alias("first"), F.explode("months").alias("active")).select(
        "first", (F.col("active") - F.col("first")).cast("bigint").alias("month_number")
    )
    if last_month is not None:
        numbered = numbered.filter(F.col("month_number") <= last_month)
    counted = numbered.groupBy("first", "month_number").agg(F.count("*").alias("active_customers"))
    cohort = F.make_date(F.floor(F.col("first") / 12).cast("int"), F.pmod("first", F.lit(12)) + 1, F.lit(1))
    return counted.select(cohort.alias("cohort_month"), "month_number", "active_customers")


def _with_retention(cells: DataFrame) -> DataFrame:
    """Cohort size next to each cell: it is the cohort's own month-0 cell."""
    by_cohort = Window.partitionBy("cohort_month").orderBy("month_number")
    return cells.withColumn(
        "cohort_customers", F.first("active_customers").over(by_cohort)
    ).withColumn("pct_retained", percent("active_customers", "cohort_customers"))


def cohort_matrix(
    transactions: DataFrame, customer: str = "customer_id", ts: str = "invoice_date"
) -> DataFrame:
    """Observed cells of the cohort matrix in long form, ordered."""
    cells = _with_retention(_active_customers(transactions, customer, ts))
    return cells.select(
        "cohort_month", "month_number", "cohort_customers", "active_customers", "pct_retained"
    ).orderBy("cohort_month", "month_number")


def retention_alert(
    transactions: DataFrame,
    customer: str = "customer_id",
    ts: str = "invoice_date",
    threshold: float = 5,
    lookback: int = 3,
) -> DataFrame:
    """Month-1 retention of the latest cohort that has any, against those before.

    The comparison is the mean of up to ``lookback`` earlier cohorts' rounded
    percentages. A drop of more than ``threshold`` points raises the alert.
    """
    month_one = _with_retention(
        _active_customers(transactions, customer, ts, last_month=1)
    ).filter(F.col("month_number") == 1)
    return alert_from_month_one(month_one, threshold, lookback)


def alert_from_month_one(month_one: DataFrame, threshold: float = 5, lookback: int = 3) -> DataFrame:
    """The alert row from one (cohort_month, pct_retained) row per cohort."""
    recent = month_one.orderBy(F.desc("cohort_month")).limit(lookback + 1)
    ranked = recent.withColumn(
        "age", F.row_number().over(Window.orderBy(F.desc("cohort_month")))
    )
    compared = ranked.agg(
        F.max("cohort_month").alias("mes_mas_reciente"),
        F.max(F.when(F.col("age") == 1, F.col("pct_retained"))).alias("latest"),
        F.avg(F.when(F.col("age") > 1, F.col("pct_retained"))).alias("earlier"),
    ).filter(F.col("mes_mas_reciente").isNotNull())
    # The two states.
    state = F.when(
        F.col("earlier") - F.col("latest") > threshold, f"ALERTA: caida > {threshold:g}pp"
    ).otherwise("OK")
    return compared.select(
        "mes_mas_reciente",
        F.col("latest").alias("retencion_mes_mas_reciente"),
        F.round("earlier", 2).alias("retencion_promedio_3_meses_previos"),
        F.round(F.col("latest") - F.col("earlier"), 2).alias("diferencia_puntos_pct"),
        state.alias("estado"),
    )
