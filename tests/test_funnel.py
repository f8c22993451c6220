import datetime as dt

from tideline.operators.funnel import acquisition_funnel, activation, first_purchase


def activated(frame):
    return {row.customer_id: row.activated for row in activation(frame).collect()}


def test_first_purchase_keeps_the_time_and_the_month(purchases):
    frame = first_purchase(purchases((1, "2020-03-05 10:00:00"), (1, "2020-02-29 23:59:59")))
    assert [tuple(row) for row in frame.collect()] == [
        (1, dt.datetime(2020, 2, 29, 23, 59, 59), dt.date(2020, 2, 1))
    ]


def test_first_purchase_keeps_unknown_customers(purchases):
    frame = first_purchase(purchases((None, "2020-03-05 10:00:00"), (1, "2020-02-01 00:00:00")))
    assert {row.customer_id for row in frame.collect()} == {None, 1}


def test_same_day_repeat_does_not_activate(purchases):
    assert activated(purchases((1, "2020-01-01 08:00:00"), (1, "2020-01-01 20:00:00"))) == {1: 0}


def test_activation_window_ends_with_day_thirty(purchases):
    frame = purchases(
        (1, "2020-01-01 23:00:00"),
        (1, "2020-01-31 01:00:00"),
        (2, "2020-01-01 01:00:00"),
        (2, "2020-02-01 00:00:00"),
        (3, "2020-01-01 00:00:00"),
    )
    assert activated(frame) == {1: 1, 2: 0, 3: 0}


def test_only_the_next_day_counts_from_the_first_purchase(purchases):
    # 31 days after the first, one day after the second: still not activated.
    frame = purchases((1, "2020-01-01"), (1, "2020-02-01"), (1, "2020-02-02"))
    assert activated(frame) == {1: 0}


def test_unknown_customers_are_not_activated(purchases):
    assert activated(purchases((None, "2020-01-01"), (None, "2020-01-02"))) == {}


def test_activation_with_another_window(purchases):
    frame = purchases((1, "2020-01-01"), (1, "2020-01-08"))
    assert activation(frame, days=6).collect()[0].activated == 0
    assert activation(frame, days=7).collect()[0].activated == 1


def funnel(frame, **options):
    (row,) = acquisition_funnel(frame, **options).collect()
    return tuple(row)


def test_the_activating_purchase_is_no_retention(purchases):
    assert funnel(purchases((1, "2020-01-01"), (1, "2020-01-20"))) == (1, 1, 0, 100.0, 0.0)


def test_retention_starts_after_day_thirty(purchases):
    on_day_30 = purchases((1, "2020-01-01"), (1, "2020-01-20"), (1, "2020-01-31"))
    on_day_31 = purchases((1, "2020-01-01"), (1, "2020-01-20"), (1, "2020-02-01"))
    assert funnel(on_day_30)[2] == 0
    assert funnel(on_day_31)[2] == 1


def test_retention_ends_three_months_after_the_first_purchase(purchases):
    last_day = purchases((1, "2020-01-15"), (1, "2020-01-20"), (1, "2020-04-15 23:00:00"))
    day_after = purchases((1, "2020-01-15"), (1, "2020-01-20"), (1, "2020-04-16"))
    assert funnel(last_day)[2] == 1
    assert funnel(day_after)[2] == 0


def test_three_months_end_with_a_short_month(purchases):
    # 30 November plus three months is the end of February.
    last_day = purchases((1, "2020-11-30"), (1, "2020-12-10"), (1, "2021-02-28"))
    day_after = purchases((1, "2020-11-30"), (1, "2020-12-10"), (1, "2021-03-01"))
    assert funnel(last_day)[2] == 1
    assert funnel(day_after)[2] == 0


def test_second_purchase_on_day_31_is_neither(purchases):
    assert funnel(purchases((1, "2020-01-01"), (1, "2020-02-01"))) == (1, 0, 0, 0.0, None)


def test_empty_funnel(purchases):
    assert funnel(purchases((1, "2020-01-01")).limit(0)) == (0, None, None, None, None)


def test_customer_without_any_date_is_acquired_only(purchases):
    assert funnel(purchases((1, None), (2, "2020-01-01"), (2, "2020-01-02")))[:3] == (2, 1, 0)


def test_published_rates(spark):
    from pyspark.sql import functions as F

    from tideline.functions.ratios import percent

    counts = spark.range(1).select(F.lit(5878).alias("a"), F.lit(1138).alias("b"), F.lit(666).alias("c"))
    (row,) = counts.select(percent("b", "a"), percent("c", "b")).collect()
    assert tuple(row) == (19.36, 58.52)
