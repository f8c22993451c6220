"""Acquisition, activation and retention of customers from their purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import day_of, month_of
from tideline.functions.ratios import percent


def first_purchase(
    transactions: DataFrame, customer: str = "customer_id", ts: str = "invoice_date"
) -> DataFrame:
    """Time of each customer's first purchase and the month it falls in."""
    firsts = transactions.groupBy(F.col(customer).alias("customer_id")).agg(
        F.min(ts).alias("first_purchase_date")
    )
    return firsts.withColumn("acquisition_cohort_month", month_of("first_purchase_date"))


def _customer_flags(
    transactions: DataFrame, customer: str, ts: str, days: int, months: int
) -> DataFrame:
    """Per customer: first day, bought again within ``days``, bought again later.

    Tasks combine the purchases of a customer into a set of days, which the calendar
    bounds however many lines the customer has, and only these sets are shuffled, once.
    The next distinct day is at most ``days`` after the first exactly when some distinct
    day is, so the set is looked through, not sorted.
    """
    sets = (
        transactions.filter(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"))
        .agg(F.collect_set(day_of(ts)).alias("days"))
    )
    first = F.col("first_purchase_day")
    limit = F.add_months(first, months)

    def soon(day: Column) -> Column:
        return (day > first) & (day <= F.date_add(first, days))

    def later(day: Column) -> Column:
        return (day > F.date_add(first, days)) & (day <= limit)

    return sets.withColumn("first_purchase_day", F.array_min("days")).select(
        "customer_id",
        "first_purchase_day",
        F.when(F.exists("days", soon), 1).otherwise(0).alias("activated"),
        F.when(F.exists("days", later), 1).otherwise(0).alias("returned"),
    )


def activation(
    transactions: DataFrame,
    customer: str = "customer_id",
    ts: str = "invoice_date",
    days: int = 30,
) -> DataFrame:
    """Per customer: first purchase day and whether a second day follows in time.

    Several purchases on the first day do not activate.
    """
    flags = _customer_flags(transactions, customer, ts, days, months=0)
    return flags.select("customer_id", "first_purchase_day", "activated")


def acquisition_funnel(
    transactions: DataFrame,
    customer: str = "customer_id",
    ts: str = "invoice_date",
    days: int = 30,
    months: int = 3,
) -> DataFrame:
    """One row: customers acquired, activated and retained, with both rates.

    Retained means activated and seen again after the activation window but no
    later than ``months`` after the first purchase, so the purchase that
    activates never counts as retention too.
    """
    flags = _customer_flags(transactions, customer, ts, days, months)
    totals = flags.agg(
        F.count("*").alias("clientes_adquiridos"),
        F.sum("activated").alias("clientes_activados"),
        F.sum(F.col("activated") * F.col("returned")).alias("clientes_retenidos"),
    )
    return totals.withColumns(
        {
            "pct_activacion": percent("clientes_activados", "clientes_adquiridos"),
            "pct_retencion_sobre_activados": percent("clientes_retenidos", "clientes_activados"),
        }
    )
