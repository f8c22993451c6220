"""The operators' input tables, derived from the driver's test tables.

Every mapping is row-local or an equi join, uses whole tables and repeats no
ranking per user, so that one user with a third of the rows is no problem here
either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.dates import month_label, month_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as purchases."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS customer_id", "o_orderdate AS invoice_date", "o_totalprice AS total_price"
    )


def retail_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an uncleaned retail export.

    Pending orders play the cancelled ones, seventh lines the returns, and every
    twentieth customer number is missing.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    countries = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .join(countries, orders.o_custkey == countries.c_custkey)
    )
    return joined.selectExpr(
        "if(o_orderstatus = 'P', concat('C', o_orderkey), string(o_orderkey)) AS Invoice",
        "string(l_partkey) AS StockCode",
        "p_name AS Description",
        "int(if(l_linenumber = 7, -l_quantity, l_quantity)) AS Quantity",
        "o_orderdate AS InvoiceDate",
        "l_extendedprice / nullif(l_quantity, 0) AS Price",
        "if(o_custkey % 20 <> 0, o_custkey, NULL) AS `Customer ID`",
        "n_name AS Country",
    )


def engagement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, for the operators that only need a user and a time."""
    return table(spark, sf_dir, "events").selectExpr("user_id", "ts AS event_timestamp")


# How far a user gets follows from the user's number.
_LOGS_IN = "user_id % 20 <> 0"
_VIEWS = f"({_LOGS_IN} AND user_id % 4 <> 1)"
_APPLIES = f"({_VIEWS} AND user_id % 5 < 3)"
_PAYS = f"({_VIEWS} AND user_id % 5 < 2)"


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a product event; none is dropped.

    Users who never log in keep signing up, and what a user cannot do yet is a
    login instead.
    """
    named = table(spark, sf_dir, "events").selectExpr(
        "*",
        f"""CASE
            WHEN NOT {_LOGS_IN} OR event_type = 'signup' THEN 'signup'
            WHEN {_VIEWS} AND event_type = 'view' AND event_id % 3 <> 0 THEN 'view_service'
            WHEN {_APPLIES} AND event_type = 'click' THEN 'start_application'
            WHEN {_APPLIES} AND event_type = 'error' THEN 'complete_kyc'
            WHEN {_PAYS} AND event_type = 'purchase' AND event_id % 4 = 0 THEN 'first_transaction'
            WHEN {_PAYS} AND event_type = 'purchase' THEN 'repeat_transaction'
            ELSE 'login' END AS event_name""",
    )
    paid = "event_name IN ('first_transaction', 'repeat_transaction')"
    return named.selectExpr(
        "user_id",
        "CASE WHEN user_id % 10 < 2 THEN 'referido' WHEN user_id % 10 < 5 THEN 'pagado' "
        "ELSE 'organico' END AS channel",
        "event_name",
        "ts AS event_timestamp",
        f"if({paid}, value, NULL) AS amount",
        f"if({paid}, event_id % 67 = 0, NULL) AS is_fraud",
        f"if(event_name = 'complete_kyc', if({_PAYS}, 'kyc_approved', 'kyc_rejected'), NULL) "
        "AS kyc_result",
    )


def raw_product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product events as the raw CSV holds them: all text, empty for missing."""
    return product_events(spark, sf_dir).selectExpr(
        "string(user_id) AS user_id",
        "channel",
        "event_name",
        "string(event_timestamp) AS event_timestamp",
        "coalesce(string(amount), '') AS amount",
        "coalesce(string(is_fraud), '') AS is_fraud",
        "coalesce(kyc_result, '') AS kyc_result",
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' sign-ups and orders as product events over 80 months.

    A customer signs up with the first order, in the channel named by the market
    segment. Orders carry no channel, as no metric asks for a transaction's.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("joined_at"))
    signups = firsts.join(customer, firsts.o_custkey == customer.c_custkey).selectExpr(
        "o_custkey AS user_id",
        "c_mktsegment AS channel",
        "'signup' AS event_name",
        "joined_at AS event_timestamp",
        "double(NULL) AS amount",
        "boolean(NULL) AS is_fraud",
    )
    paid = orders.selectExpr(
        "o_custkey AS user_id",
        "string(NULL) AS channel",
        "if(o_orderstatus = 'F', 'first_transaction', 'repeat_transaction') AS event_name",
        "o_orderdate AS event_timestamp",
        "o_totalprice AS amount",
        "o_orderkey % 67 = 0 AS is_fraud",
    )
    return signups.unionByName(paid)


def channel_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition costs as text, from the sign-ups of each channel and month."""
    signups = order_events(spark, sf_dir).filter("event_name = 'signup'")
    counted = signups.groupBy("channel", month_of("event_timestamp").alias("start")).count()
    return counted.select(
        "channel",
        month_label("start").alias("month"),
        F.expr(
            "string(round(count * (10 + length(channel)) * (1 + (month(start) % 5) / 20.0D), 2))"
        ).alias("acquisition_cost_pen"),
    )


def customer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity check per customer, approved with a positive balance."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "c_mktsegment AS channel",
        "'complete_kyc' AS event_name",
        "if(c_acctbal > 0, 'kyc_approved', 'kyc_rejected') AS kyc_result",
    )


def ab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in two variants; ``converted`` is text, as in the raw file."""
    return table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey) AS customer_id",
        "if(c_custkey % 2 = 0, 'control', 'test') AS variant",
        "if(c_acctbal > if(c_custkey % 2 = 0, 9100, 8700), '1', '0') AS converted",
        "c_mktsegment AS experiment",
    )
