import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tideline.operators.engagement import daily_activity, dau, rolling_active_users, stickiness_weekly


def seen(events, *rows):
    return events(*((user, "login", at) for user, at in rows))


def rolling(frame, **options):
    rows = rolling_active_users(frame, **options).collect()
    return [(str(row.activity_day), row.mau) for row in rows]


def test_dau(events):
    frame = seen(events, ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 23:59:59"), ("b", "2024-01-01 12:00:00"))
    assert [(str(row.activity_day), row.dau) for row in dau(frame).collect()] == [("2024-01-01", 2)]


def test_a_day_is_outside_its_own_window(events):
    frame = seen(events, ("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"))
    assert rolling(frame) == [("2024-01-02", 1)]


def test_exact_midnight_is_inside(events):
    frame = seen(events, ("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:01"))
    assert rolling(frame) == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_window_is_open_thirty_days_back(events):
    exactly = seen(events, ("a", "2024-01-01 00:00:00"), ("b", "2024-01-31 12:00:00"))
    assert rolling(exactly) == [("2024-01-01", 1)]
    just_inside = seen(events, ("a", "2024-01-01 00:00:00.000001"), ("b", "2024-01-31 12:00:00"))
    assert rolling(just_inside) == [("2024-01-31", 1)]


def test_days_without_events_have_no_row(events):
    frame = seen(events, ("a", "2024-01-01 10:00:00"), ("a", "2024-01-05 10:00:00"))
    assert rolling(frame) == [("2024-01-05", 1)]


def test_current_day_can_be_included(events):
    frame = seen(events, ("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"), ("c", "2024-01-04 00:00:00"))
    assert rolling(frame, days=2, include_current_day=True) == [
        ("2024-01-01", 1),
        ("2024-01-02", 2),
        ("2024-01-04", 1),
    ]


def test_events_without_user_open_a_window_but_count_nobody(events):
    frame = seen(events, (None, "2024-01-01 10:00:00"), (None, "2024-01-02 10:00:00"), ("b", "2024-01-03 10:00:00"))
    days = [(str(r.activity_day), r.dau, r.mau) for r in daily_activity(frame).orderBy("activity_day").collect()]
    assert days == [("2024-01-02", 0, 0), ("2024-01-03", 1, 0)]


def test_stickiness_can_pass_one_hundred(events):
    frame = seen(
        events,
        ("a", "2024-01-02 10:00:00"),
        ("b", "2024-01-03 10:00:00"),
        ("c", "2024-01-03 10:00:00"),
        ("a", "2024-01-08 10:00:00"),
    )
    rows = [(str(r.activity_week), *tuple(r)[1:]) for r in stickiness_weekly(frame).collect()]
    assert rows == [("2024-01-01", 2.0, 1.0, 200.0), ("2024-01-08", 1.0, 3.0, 33.33)]


MOMENTS = st.tuples(
    st.integers(0, 4),
    st.integers(0, 40),
    st.sampled_from(["00:00:00", "00:00:00.000001", "12:00:00", "23:59:59.999999"]),
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(MOMENTS, min_size=1, max_size=40), st.integers(1, 12))
def test_rolling_users_equal_the_definition(events, moments, days):
    start = dt.datetime(2024, 2, 20)
    rows = []
    for user, offset, clock in moments:
        day = (start + dt.timedelta(days=offset)).strftime("%Y-%m-%d")
        rows.append((f"u{user}", dt.datetime.fromisoformat(f"{day} {clock}")))
    expected = []
    for day in sorted({at.date() for _, at in rows}):
        end = dt.datetime.combine(day, dt.time())
        inside = {user for user, at in rows if end - dt.timedelta(days=days) < at <= end}
        if inside:
            expected.append((str(day), len(inside)))
    frame = seen(events, *((user, str(at)) for user, at in rows))
    assert rolling(frame, days=days) == expected
