"""The product funnel on a second mapping of the events, with known figures.

Here a step is a user's first event of a kind, found by ranking; fine for a small
table, and independent of the mapping the registered queries use.
"""

import harness
import pytest

from tideline.operators.metrics import kyc_rates
from tideline.operators.product import step_funnel, step_times, users_per_event

RANKED = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn,
         user_id % 20 <> 0 AND user_id % 4 <> 1 AS views
  FROM events_for_ranking
),
named AS (
  SELECT *, CASE
    WHEN event_type = 'signup' AND rn = 1 THEN 'signup'
    WHEN event_type = 'view' AND rn = 1 AND user_id % 20 <> 0 THEN 'login'
    WHEN event_type = 'view' AND rn = 2 AND views THEN 'view_service'
    WHEN event_type = 'click' AND rn = 1 AND views AND user_id % 5 < 3 THEN 'start_application'
    WHEN event_type = 'error' AND rn = 1 AND views AND user_id % 5 < 3 THEN 'complete_kyc'
    WHEN event_type = 'purchase' AND views AND user_id % 5 < 2
      THEN IF(rn = 1, 'first_transaction', 'repeat_transaction') END AS event_name
  FROM ranked
)
SELECT user_id, event_name, ts AS event_timestamp,
       CASE WHEN user_id % 10 < 2 THEN 'referido' WHEN user_id % 10 < 5 THEN 'pagado'
            ELSE 'organico' END AS channel,
       IF(event_name = 'complete_kyc', IF(user_id % 5 < 2, 'kyc_approved', 'kyc_rejected'), NULL)
         AS kyc_result
FROM named WHERE event_name IS NOT NULL
"""


@pytest.fixture(scope="module")
def ranked(spark):
    path = f"{harness.TESTDATA}/sf0.01/events.parquet"
    spark.read.parquet(path).createOrReplaceTempView("events_for_ranking")
    return spark.sql(RANKED)


def test_users_per_step(ranked):
    rows = step_funnel(ranked).collect()
    assert [row.usuarios_unicos for row in rows] == [150, 142, 104, 59, 59, 36, 36]


def test_hours_between_steps(ranked):
    assert tuple(step_times(ranked).first()) == (-3.64, 54.76, -53.28, -1.06, 5.74)


def test_users_with_repeat_transactions(ranked):
    rows = {row.event_name: row.usuarios_unicos for row in users_per_event(ranked).collect()}
    assert rows["repeat_transaction"] == 36
    assert ranked.filter("event_name = 'repeat_transaction'").count() == 419


def test_checks_by_channel(ranked):
    rows = [tuple(row)[:3] for row in kyc_rates(ranked).collect()]
    assert rows == [("organico", 30, 22), ("pagado", 15, 0), ("referido", 14, 14), (None, 59, 36)]
