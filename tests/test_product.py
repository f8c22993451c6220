from tideline.operators.product import step_funnel, step_times, users_per_event

T = "2024-01-01 00:00:00"


def funnel(frame):
    return [tuple(row) for row in step_funnel(frame).collect()]


def test_steps_and_both_rates(events):
    frame = events(
        *((f"u{i}", "signup", T) for i in range(8)),
        *((f"u{i}", "signup", T) for i in range(8)),
        *((f"u{i}", "login", T) for i in range(4)),
        *((f"u{i}", "view_service", T) for i in range(3)),
        *((f"u{i}", "start_application", T) for i in range(3)),
        ("u0", "complete_kyc", T, None, None, "kyc_approved"),
        ("u1", "complete_kyc", T, None, None, "kyc_rejected"),
        ("u0", "first_transaction", T),
        ("u0", "repeat_transaction", T),
        ("u9", None, T),
    )
    assert funnel(frame) == [
        (1, "signup", 8, 100.0, None),
        (2, "login", 4, 50.0, 50.0),
        (3, "view_service", 3, 37.5, 75.0),
        (4, "start_application", 3, 37.5, 100.0),
        (5, "complete_kyc", 2, 25.0, 66.67),
        (6, "kyc_approved", 1, 12.5, 50.0),
        (7, "first_transaction", 1, 12.5, 100.0),
    ]


def test_unseen_steps_vanish_but_the_approved_check(events):
    frame = events(
        ("a", "signup", T),
        ("a", "complete_kyc", T, None, None, "kyc_rejected"),
        ("a", "first_transaction", T),
    )
    assert funnel(frame) == [
        (1, "signup", 1, 100.0, None),
        (5, "complete_kyc", 1, 100.0, 100.0),
        (6, "kyc_approved", 0, 0.0, 0.0),
        (7, "first_transaction", 1, 100.0, None),
    ]


def test_funnel_of_nothing_is_one_row(events):
    assert funnel(events(("a", "other", T))) == [(6, "kyc_approved", 0, None, None)]


def test_a_user_with_both_check_results_is_approved_once(events):
    frame = events(
        ("a", "complete_kyc", T, None, None, "kyc_rejected"),
        ("a", "complete_kyc", T, None, None, "kyc_approved"),
        ("a", "complete_kyc", T, None, None, None),
    )
    assert [row[2] for row in funnel(frame)] == [1, 1]


def test_published_rates(spark):
    from pyspark.sql import functions as F

    from tideline.functions.ratios import percent

    users = [3000, 2851, 2125, 854, 854, 719, 605]
    steps = spark.createDataFrame(list(zip(users, [3000] + users)), "u long, p long")
    rows = steps.select(percent("u", F.lit(3000)), percent("u", "p")).collect()
    assert [row[0] for row in rows] == [100.0, 95.03, 70.83, 28.47, 28.47, 23.97, 20.17]
    assert [row[1] for row in rows][1:] == [95.03, 74.54, 40.19, 100.0, 84.19, 84.14]


def test_times_use_first_events_and_signed_whole_minutes(events):
    frame = events(
        ("a", "signup", "2024-01-01 00:00:50"),
        ("a", "login", "2024-01-01 00:01:10"),  # 20 seconds: no whole minute
        ("a", "login", "2024-01-02 00:00:00"),
        ("a", "view_service", "2023-12-31 23:01:10"),  # an hour early
        ("b", "signup", "2024-01-01 00:00:00"),
        ("b", "login", "2024-01-01 01:00:59"),
        ("c", "signup", "2024-01-01 00:00:00"),  # no login: in no mean
    )
    (row,) = step_times(frame).collect()
    assert row.horas_signup_a_login == 0.5
    assert row.horas_login_a_view_service == -1.0
    assert row.horas_complete_kyc_a_first_transaction is None
    assert row.asDict().keys() == {
        "horas_signup_a_login",
        "horas_login_a_view_service",
        "horas_view_service_a_start_application",
        "horas_start_application_a_complete_kyc",
        "horas_complete_kyc_a_first_transaction",
    }


def test_times_do_not_depend_on_the_session_time_zone(spark, events):
    # 02:30 does not exist in New York on that day.
    frame = events(("a", "signup", "2024-03-10 02:30:00"), ("a", "login", "2024-03-10 06:30:00"))
    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    spark.conf.set(zone, "America/New_York")
    try:
        assert step_times(frame).first().horas_signup_a_login == 4.0
    finally:
        spark.conf.set(zone, before)


def test_users_per_event(events):
    frame = events(("a", "signup", T), ("a", "signup", T), ("b", "signup", T), ("a", "repeat_transaction", T))
    assert {tuple(row) for row in users_per_event(frame).collect()} == {
        ("signup", 2),
        ("repeat_transaction", 1),
    }
