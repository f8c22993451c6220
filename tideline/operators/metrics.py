"""Acquisition cost, payment volume, revenue per user, lifetime value, fraud.

Operators take product events. Months are grouped as dates and labelled
``yyyy-MM`` once few rows are left.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import month_label, month_of
from tideline.functions.ratios import count_where, exact_sum, percent, ratio, rounded_money

# Event names and results the metrics look for.
SIGNUP = "signup"
TRANSACTIONS = ("first_transaction", "repeat_transaction")
CHECK_EVENT = "complete_kyc"
APPROVED = "kyc_approved"
REJECTED = "kyc_rejected"

# Fixed value: note shown with the lifetime value. It says six months whatever the data hold.
LTV_NOTE = "Aproximacion: ventana de datos de 6 meses, no cohorte madura"


@dataclass(frozen=True)
class EventColumns:
    """Names that the operators' columns have in an event table."""

    user_id: str = "user_id"
    channel: str = "channel"
    event_name: str = "event_name"
    event_timestamp: str = "event_timestamp"
    amount: str = "amount"
    is_fraud: str = "is_fraud"
    kyc_result: str = "kyc_result"


@dataclass(frozen=True)
class CostColumns:
    """Names that the operators' columns have in a cost table."""

    channel: str = "channel"
    month: str = "month"
    acquisition_cost_pen: str = "acquisition_cost_pen"


EVENTS, COSTS = EventColumns(), CostColumns()


def _named(frame: DataFrame, columns: EventColumns | CostColumns) -> DataFrame:
    """The columns that are there, under the operators' names."""
    there = {name: given for name, given in asdict(columns).items() if given in frame.columns}
    return frame.select(*[F.col(given).alias(name) for name, given in there.items()])


def _transactions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_name").isin(*TRANSACTIONS)).select(
        month_of("event_timestamp").alias("month_start"), "user_id", "amount", "is_fraud"
    )


def _with_month(grouped: DataFrame) -> DataFrame:
    """Label and order of grouped rows, the label first."""
    others = [name for name in grouped.columns if name != "month_start"]
    return grouped.select(month_label("month_start").alias("month"), *others).orderBy(
        F.asc_nulls_last("month")
    )


def _new_users_with_cost(events: DataFrame, costs: DataFrame) -> DataFrame:
    """New users per channel and month next to what the channel cost then.

    Both sides are grouped or small before the join. Neither is hinted: Spark
    broadcasts one only after seeing that it is small enough.
    """
    signups = events.filter(F.col("event_name") == SIGNUP)
    new_users = (
        signups.groupBy("channel", month_of("event_timestamp").alias("month_start"))
        .agg(F.count_distinct("user_id").alias("nuevos_usuarios"))
        .withColumn("month", month_label("month_start"))
    )
    spent = costs.select(
        "channel", "month", F.col("acquisition_cost_pen").cast("double").alias("acquisition_cost_pen")
    )
    return new_users.join(spent, ["channel", "month"])


def cac(
    events: DataFrame, costs: DataFrame, columns: EventColumns = EVENTS, cost_columns: CostColumns = COSTS
) -> DataFrame:
    """Cost per new user of each channel and month."""
    return (
        _new_users_with_cost(_named(events, columns), _named(costs, cost_columns))
        .select(
            "channel",
            "month",
            "nuevos_usuarios",
            "acquisition_cost_pen",
            F.round(ratio("acquisition_cost_pen", "nuevos_usuarios"), 2).alias("cac_pen"),
        )
        .orderBy("month", "channel")
    )


def kyc_rates(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """Identity checks per channel and in total, with the total (NULL channel) last.

    The total adds up the channels' counts instead of grouping every event twice;
    without any check it is still there, with a count of zero.
    """
    result = F.col("kyc_result")
    per_channel = (
        _named(events, columns)
        .filter(F.col("event_name") == CHECK_EVENT)
        .groupBy("channel")
        .agg(
            F.count("*").alias("total_kyc"),
            count_where(result == APPROVED).alias("aprobados"),
            count_where(result == REJECTED).alias("rechazados"),
        )
        .withColumn("is_total", F.lit(0))
    )
    total = per_channel.agg(
        F.lit(None).cast("string").alias("channel"),
        F.coalesce(F.sum("total_kyc"), F.lit(0)).alias("total_kyc"),
        F.sum("aprobados").alias("aprobados"),
        F.sum("rechazados").alias("rechazados"),
        F.lit(1).alias("is_total"),
    )
    return (
        per_channel.unionByName(total)
        .orderBy(F.asc_nulls_last("channel"), "is_total")
        .select(
            "channel",
            "total_kyc",
            "aprobados",
            "rechazados",
            percent("aprobados", "total_kyc").alias("pct_aprobacion"),
            percent("rechazados", "total_kyc").alias("pct_rechazo"),
        )
    )


def monthly_transactions(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """First and repeat transactions with their month."""
    return _transactions(_named(events, columns)).select(
        month_label("month_start").alias("month"), "user_id", "amount", "is_fraud"
    )


def tpv(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """Payment volume, number of transactions and mean ticket per month."""
    volumes = (
        _transactions(_named(events, columns))
        .groupBy("month_start")
        .agg(
            rounded_money(exact_sum("amount")).alias("tpv_pen"),
            F.count("*").alias("n_transacciones"),
            F.round(ratio(exact_sum("amount"), F.count("amount")), 2).alias("ticket_promedio_pen"),
        )
    )
    return _with_month(volumes)


def arpu(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """Payment volume (unrounded), active users and volume per user, per month."""
    volumes = (
        _transactions(_named(events, columns))
        .groupBy("month_start")
        .agg(
            exact_sum("amount").cast("double").alias("tpv_pen"),
            F.count_distinct("user_id").alias("usuarios_activos"),
        )
        .withColumn("arpu_pen", F.round(ratio("tpv_pen", "usuarios_activos"), 2))
    )
    return _with_month(volumes)


def _ltv_parts(events: DataFrame) -> DataFrame:
    """One row: mean monthly revenue per user and mean active months per user.

    Both come from one table of (user, month) sums, grouped once by month and
    once by user through grouping sets, so the events are read and shuffled once
    and no join brings the two means together.
    """
    user_months = (
        _transactions(events)
        .groupBy("user_id", "month_start")
        .agg(exact_sum("amount").alias("amount"))
    )
    by_month_and_user = user_months.groupingSets(
        [["month_start"], ["user_id"]], "month_start", "user_id"
    ).agg(
        F.grouping("user_id").alias("is_month"),
        ratio(F.sum("amount"), F.count("user_id")).alias("revenue_per_user"),
        F.count("month_start").alias("active_months"),
    )
    is_month = F.col("is_month") == 1
    return by_month_and_user.agg(
        F.avg(F.when(is_month, F.col("revenue_per_user"))).alias("arpu"),
        F.avg(F.when(~is_month, F.col("active_months"))).alias("months"),
    )


def ltv(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """Simple lifetime value: mean monthly revenue per user x mean active months."""
    return _ltv_parts(_named(events, columns)).select(
        F.round("arpu", 2).alias("arpu_promedio_pen"),
        F.round("months", 2).alias("retencion_promedio_meses"),
        F.round(F.col("arpu") * F.col("months"), 2).alias("ltv_simplificado_pen"),
        F.lit(LTV_NOTE).alias("nota_metodologica"),
    )


def ltv_to_cac(
    events: DataFrame, costs: DataFrame, columns: EventColumns = EVENTS, cost_columns: CostColumns = COSTS
) -> DataFrame:
    """Lifetime value over acquisition cost per channel, best channel first.

    A channel's cost is all it spent over all its new users, not the mean of its
    months. The lifetime value is one number for all channels and enters as a
    scalar subquery.
    """
    events, costs = _named(events, columns), _named(costs, cost_columns)
    lifetime = _ltv_parts(events).select((F.col("arpu") * F.col("months")).alias("ltv")).scalar()
    channels = (
        _new_users_with_cost(events, costs)
        .groupBy("channel")
        .agg(ratio(exact_sum("acquisition_cost_pen"), F.sum("nuevos_usuarios")).alias("cac"))
        .withColumn("ltv", lifetime)
    )
    return channels.select(
        "channel",
        F.round("cac", 2).alias("cac_promedio_pen"),
        F.round("ltv", 2).alias("ltv_simplificado_pen"),
        F.round(ratio("ltv", "cac"), 2).alias("ratio_ltv_cac"),
    ).orderBy(F.desc_nulls_last("ratio_ltv_cac"))


def fraud_rate(events: DataFrame, columns: EventColumns = EVENTS) -> DataFrame:
    """Transactions, fraudulent ones and their percentage (3 digits) per month."""
    frauds = (
        _transactions(_named(events, columns))
        .groupBy("month_start")
        .agg(
            F.count("*").alias("total_transacciones"),
            count_where(F.col("is_fraud")).alias("transacciones_fraude"),
        )
        .withColumn("tasa_fraude_pct", percent("transacciones_fraude", "total_transacciones", 3))
    )
    return _with_month(frauds)
