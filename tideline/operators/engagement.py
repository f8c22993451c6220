"""Daily users, rolling users and their ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import day_of, is_midnight, week_of
from tideline.functions.ratios import ratio


def dau(events: DataFrame, user: str = "user_id", ts: str = "event_timestamp") -> DataFrame:
    """Distinct users per day."""
    return events.groupBy(day_of(ts).alias("activity_day")).agg(
        F.count_distinct(user).alias("dau")
    )


def daily_activity(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "event_timestamp",
    days: int = 30,
    include_current_day: bool = False,
) -> DataFrame:
    """Per active day: its users, and the users of the window that ends at its start.

    The window of day d is ``(d - days, d]`` up to d's midnight, so d itself is
    outside it but for events at exactly midnight; ``include_current_day`` takes
    the ``days`` calendar days up to and including d instead. Days without any
    event, and days whose window is empty, have no row.

    There is no join of days with events. Events are reduced to distinct marks of a
    user, two per day at most: at midnight, and later that day. A mark puts the user
    into the windows of ``days`` days from the next midnight on, or until the user's
    next mark takes over. Each mark so adds one user at a day and takes one off at a
    later day, and a running sum over days gives the users of every window. The work
    is one mark per (user, day) for any window length; one user's marks, like the
    unpartitioned running sum, are bounded by the calendar however many events there
    are.
    """
    at = F.col(ts).cast("timestamp_ntz")
    # Twice the day, plus one after midnight: half up it is the first window's day.
    after_midnight = F.lit(0) if include_current_day else F.when(is_midnight(at), 0).otherwise(1)
    marks = (
        events.filter(F.col(ts).isNotNull())
        .select(
            F.col(user).alias("user_id"),
            (2 * F.unix_date(day_of(at)) + after_midnight).alias("mark"),
        )
        .distinct()
    )
    next_mark = F.lead("mark").over(Window.partitionBy("user_id").orderBy("mark"))
    # Rows without a user open windows but count no user.
    counts = F.when(F.col("user_id").isNotNull(), 1).otherwise(0)
    followed = marks.select("mark", next_mark.alias("next"), counts.alias("counts"))

    def day(mark: str) -> Column:
        return F.shiftright(mark, 1)

    def enters(mark: str) -> Column:
        return F.shiftright(F.col(mark) + 1, 1)

    last_of_day = F.col("next").isNull() | (day("next") > day("mark"))
    leaves = F.least(enters("mark") + days, enters("next"))  # least() skips a missing next
    zero, one, users = F.lit(0), F.lit(1), F.col("counts")
    changes = (
        followed.select(
            F.stack(
                F.lit(3),
                *(F.when(last_of_day, day("mark")), one, users, zero, zero),
                *(enters("mark"), zero, zero, one, users),
                *(leaves, zero, zero, -one, -users),
            ).alias("day_number", "present", "users", "open_step", "user_step")
        )
        .filter(F.col("day_number").isNotNull())
        .withColumn("activity_day", F.date_from_unix_date("day_number"))
    )
    by_day = changes.groupBy("activity_day").agg(
        F.max("present").alias("present"),
        F.sum("users").alias("dau"),
        F.sum("open_step").alias("open_step"),
        F.sum("user_step").alias("user_step"),
    )
    so_far = Window.orderBy("activity_day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        by_day.withColumn("open", F.sum("open_step").over(so_far))
        .withColumn("mau", F.sum("user_step").over(so_far))
        .filter((F.col("present") == 1) & (F.col("open") > 0))
        .select("activity_day", "dau", "mau")
    )


def rolling_active_users(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "event_timestamp",
    days: int = 30,
    include_current_day: bool = False,
) -> DataFrame:
    """Distinct users of the rolling window of every active day, ordered."""
    activity = daily_activity(events, user, ts, days, include_current_day)
    return activity.select("activity_day", "mau").orderBy("activity_day")


def stickiness_weekly(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "event_timestamp",
    days: int = 30,
    include_current_day: bool = False,
) -> DataFrame:
    """Per ISO week: mean daily users, mean rolling users and mean ratio in %.

    With the default window a day's users need not be among its rolling users, so
    the ratio can pass 100 %.
    """
    activity = daily_activity(events, user, ts, days, include_current_day)
    return (
        activity.groupBy(week_of("activity_day").alias("activity_week"))
        .agg(
            F.round(F.avg("dau"), 1).alias("dau_promedio_semana"),
            F.round(F.avg("mau"), 1).alias("mau_promedio_semana"),
            F.round(F.avg(ratio("dau", "mau")) * 100, 2).alias("stickiness_pct_promedio"),
        )
        .orderBy("activity_week")
    )
