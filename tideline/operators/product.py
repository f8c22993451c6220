"""Step funnel of the product: users per step and time between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import whole_minutes
from tideline.functions.ratios import percent

# Events of the funnel, in order.
STEP_EVENTS = (
    "signup",
    "login",
    "view_service",
    "start_application",
    "complete_kyc",
    "first_transaction",
)

# The approved identity check is a step of its own after the check.
CHECK_EVENT = "complete_kyc"
APPROVED = "kyc_approved"
FUNNEL_STEPS = (
    "signup",
    "login",
    "view_service",
    "start_application",
    "complete_kyc",
    "kyc_approved",
    "first_transaction",
)


def step_funnel(
    events: DataFrame,
    user: str = "user_id",
    event: str = "event_name",
    check_result: str = "kyc_result",
) -> DataFrame:
    """Distinct users per step, as % of the first step and of the step before.

    One scan and one shuffle reduce events to a row of flags per user, which are
    counted side by side and unpivoted; no event is duplicated for the check, which
    feeds two steps. A step nobody reached is left out, except the approved check,
    which always has a row.
    """
    is_step = {step: F.col(event) == step for step in STEP_EVENTS}
    is_step[APPROVED] = is_step[CHECK_EVENT] & (F.col(check_result) == APPROVED)
    reached = (
        events.filter(F.col(event).isin(*STEP_EVENTS) & F.col(user).isNotNull())
        .groupBy(user)
        .agg(*[F.bool_or(is_step[step]).alias(step) for step in FUNNEL_STEPS])
    )
    users = reached.agg(*[F.count_if(step).alias(step) for step in FUNNEL_STEPS])
    steps = users.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(order).alias("step_order"),
                        F.lit(step).alias("event_name"),
                        F.col(step).alias("usuarios_unicos"),
                    )
                    for order, step in enumerate(FUNNEL_STEPS, start=1)
                ]
            )
        )
    ).filter((F.col("usuarios_unicos") > 0) | (F.col("event_name") == APPROVED))
    in_order = Window.orderBy("step_order")
    first, before = F.first("usuarios_unicos").over(in_order), F.lag("usuarios_unicos").over(in_order)
    return steps.select(
        "step_order",
        "event_name",
        "usuarios_unicos",
        percent("usuarios_unicos", first).alias("pct_sobre_signup"),
        percent("usuarios_unicos", before).alias("pct_conversion_paso_anterior"),
    ).orderBy("step_order")


def step_times(
    events: DataFrame,
    user: str = "user_id",
    event: str = "event_name",
    ts: str = "event_timestamp",
) -> DataFrame:
    """One row: mean hours from each step's first time to the next step's.

    Differences are signed whole minutes. A user without one of the two steps is
    no part of that mean.
    """
    at = F.col(ts).cast("timestamp_ntz")
    firsts = (
        events.filter(F.col(event).isin(*STEP_EVENTS))
        .groupBy(user)
        .agg(*[F.min(F.when(F.col(event) == step, at)).alias(step) for step in STEP_EVENTS])
    )
    return firsts.agg(
        *[
            F.round(F.avg(whole_minutes(start, end)) / 60.0, 2).alias(
                f"horas_{start}_a_{end}"
            )
            for start, end in zip(STEP_EVENTS, STEP_EVENTS[1:])
        ]
    )


def users_per_event(
    events: DataFrame, user: str = "user_id", event: str = "event_name"
) -> DataFrame:
    """Distinct users of every event name."""
    return events.groupBy(F.col(event).alias("event_name")).agg(
        F.count_distinct(user).alias("usuarios_unicos")
    )
