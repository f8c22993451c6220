import datetime as dt

from tideline.operators.cohorts import alert_from_month_one, cohort_matrix, retention_alert


def cells(frame):
    return [tuple(row) for row in cohort_matrix(frame).collect()]


def test_matrix_lists_observed_cells_in_order(purchases):
    frame = purchases(
        (1, "2020-12-31"),
        (1, "2021-01-01"),
        (1, "2021-03-01"),
        (1, "2021-03-15"),
        (2, "2020-12-01"),
        (3, "2021-01-05"),
    )
    december, january = dt.date(2020, 12, 1), dt.date(2021, 1, 1)
    assert cells(frame) == [
        (december, 0, 2, 2, 100.0),
        (december, 1, 2, 1, 50.0),
        (december, 3, 2, 1, 50.0),
        (january, 0, 1, 1, 100.0),
    ]


def test_matrix_ignores_unknown_customers_and_times(purchases):
    assert cells(purchases((None, "2020-12-31"), (1, None))) == []


def test_matrix_counts_years_apart(purchases):
    assert [row[1] for row in cells(purchases((1, "2019-11-30"), (1, "2021-02-01")))] == [0, 15]


def month_one(spark, *rates):
    rows = [(dt.date(2011, 1 + i, 1), rate) for i, rate in enumerate(rates)]
    return spark.createDataFrame(rows, "cohort_month date, pct_retained double")


def alert(frame, **options):
    (row,) = alert_from_month_one(frame, **options).collect()
    return tuple(row)


def test_published_alert(spark):
    frame = month_one(spark, 21.57, 27.36, 26.98, 32.13, 14.14)
    assert alert(frame) == (dt.date(2011, 5, 1), 14.14, 28.82, -14.68, "ALERTA: caida > 5pp")


def test_drop_of_exactly_the_threshold_is_fine(spark):
    assert alert(month_one(spark, 25.0, 20.0))[3:] == (-5.0, "OK")
    assert alert(month_one(spark, 25.01, 20.0))[4] == "ALERTA: caida > 5pp"


def test_first_cohort_has_nothing_to_compare(spark):
    assert alert(month_one(spark, 40.0)) == (dt.date(2011, 1, 1), 40.0, None, None, "OK")


def test_alert_options(spark):
    frame = month_one(spark, 90.0, 30.0, 28.0)
    assert alert(frame, lookback=1)[2] == 30.0
    assert alert(frame, lookback=1, threshold=1)[4] == "ALERTA: caida > 1pp"


def test_no_cohort_no_row(purchases):
    assert retention_alert(purchases((1, "2020-01-01"))).collect() == []


def test_cohorts_without_month_one_are_skipped(purchases):
    frame = purchases(
        *((customer, "2020-01-10") for customer in range(7)),
        *((customer, "2020-02-10") for customer in (0, 1)),
        *((customer, "2020-03-10") for customer in (10, 11, 12)),
        (10, "2020-04-10"),
        (20, "2020-05-10"),
        (20, "2020-07-10"),
    )
    # January 2/7 = 28.57, March 1/3 = 33.33; May was never seen in June.
    (row,) = retention_alert(frame).collect()
    assert tuple(row) == (dt.date(2020, 3, 1), 33.33, 28.57, 4.76, "OK")


def test_rates_are_rounded_before_they_are_averaged(purchases):
    rows, customer = [], 0
    # Sizes 3, 7 and 7 with one returning each: 33.33, 14.29, 14.29, then 0 of 2 plus 1.
    for month, size in ((1, 3), (3, 7), (5, 7), (7, 2)):
        for member in range(size):
            rows.append((customer, f"2020-{month:02d}-10"))
            if member == 0:
                rows.append((customer, f"2020-{month + 1:02d}-10"))
            customer += 1
    (row,) = retention_alert(purchases(*rows)).collect()
    assert row.retencion_promedio_3_meses_previos == 20.64  # 20.63 from unrounded rates
