"""What has to hold whatever the size: plan shapes and skewed keys."""

import re

import harness
from plans import final_plan
from pyspark.sql import functions as F

from tideline.operators.cohorts import cohort_matrix
from tideline.operators.engagement import rolling_active_users
from tideline.operators.funnel import acquisition_funnel
from tideline.operators.metrics import kyc_rates, ltv
from tideline.operators.product import step_funnel, step_times
from tideline.plans import mappings

SMALL = f"{harness.TESTDATA}/sf0.001"


def shuffles(plan, partitioning="hashpartitioning"):
    return len(re.findall(rf"(?<!Reused)Exchange {re.escape(partitioning)}", plan))


def test_facts_are_combined_before_every_shuffle(spark):
    purchases = mappings.transactions(spark, SMALL)
    events = mappings.product_events(spark, SMALL)
    # One row of flags or times per user.
    assert shuffles(final_plan(step_funnel(events))) == 1
    assert shuffles(final_plan(step_times(events))) == 1
    # One set of days or months per customer, then sums per cell of the matrix.
    assert shuffles(final_plan(acquisition_funnel(purchases))) == 1
    assert shuffles(final_plan(cohort_matrix(purchases)), "hashpartitioning(customer_id") == 1
    assert shuffles(final_plan(cohort_matrix(purchases)), "hashpartitioning(first") == 1
    # Distinct (user, mark) pairs, the pairs by user, then sums per day.
    assert shuffles(final_plan(rolling_active_users(events))) == 3
    for frame in (acquisition_funnel(purchases), rolling_active_users(events), cohort_matrix(purchases)):
        plan = final_plan(frame)
        # The scan's own stage already aggregates, by hash; facts meet no window.
        scan_stage = plan.rsplit("Exchange hashpartitioning", 1)[1]
        assert "HashAggregate" in scan_stage and "Window" not in scan_stage


def test_facts_are_scanned_once(spark):
    events = mappings.product_events(spark, SMALL)
    orders = mappings.order_events(spark, SMALL)
    for frame in (rolling_active_users(events), step_funnel(events), ltv(orders)):
        assert final_plan(frame).count("FileScan") == 1
    assert "ReusedExchange" in final_plan(kyc_rates(events))


def test_one_user_with_half_of_the_rows(spark):
    """The hot user reaches the shuffle as one row per day and task."""
    events = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id % 60 AS int))").alias(
            "event_timestamp"
        ),
    )
    result = rolling_active_users(events)
    rows = {str(row.activity_day): row.mau for row in result.collect()}
    assert len(rows) == 59
    naive = (
        events.select("user_id", F.to_date("event_timestamp").alias("d"))
        .distinct()
        .select("user_id", F.explode(F.expr("sequence(date_add(d, 1), date_add(d, 30))")).alias("day"))
        .distinct()
        .groupBy("day")
        .count()
    )
    expected = {str(row.day): row["count"] for row in naive.collect()}
    assert rows == {day: expected[day] for day in rows}


def test_one_customer_with_half_of_the_purchases(spark):
    """The hot customer reaches the shuffle as one set of days per task."""
    purchases = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("customer_id"),
        F.expr("timestamp_ntz'2024-01-31 12:00:00' + make_dt_interval(cast(id % 200 AS int))").alias("invoice_date"),
    )
    (row,) = acquisition_funnel(purchases).collect()
    assert tuple(row)[:3] == (100_001, 1, 1)
    cells = {(str(r.cohort_month), r.month_number): r.active_customers for r in cohort_matrix(purchases).collect()}
    assert cells["2024-01-01", 1] == 1 and cells["2024-01-01", 6] == 1
    assert sum(n for (_, month), n in cells.items() if month == 0) == 100_001
