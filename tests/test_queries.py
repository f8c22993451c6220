"""Every registered query against its independent SQL, whole results compared."""

import harness
import pytest
from plans import executed

import __spark_entry__ as contract
from tideline.operators.results import RESULT_COLUMNS
from tideline.plans.oracle import ORACLE
from tideline.plans.queries import QUERIES

SMALL = f"{harness.TESTDATA}/sf0.001"
MIDDLE = f"{harness.TESTDATA}/sf0.01"

SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def small():
    return harness.duck(SMALL)


@pytest.fixture(scope="module")
def middle():
    return harness.duck(MIDDLE)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys() and ORACLE.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    """Values, names and types; and the plan that gave them."""
    frame = contract.queries()[name](spark, SMALL)
    sql = contract.oracle_sql()[name]
    assert harness.spark_result(frame) == harness.duck_result(small, sql)
    types = {field.name: SPARK_TO_DUCK[field.dataType.simpleString()] for field in frame.schema}
    described = small.execute(sql).description
    assert types == {column[0]: str(column[1]) for column in described}
    if name in RESULT_COLUMNS:
        assert tuple(frame.columns) == RESULT_COLUMNS[name]
    plan = executed(frame)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name.startswith("ab_significance") == ("Python" in plan)


@pytest.mark.parametrize(
    "name",
    ["acquisition_funnel", "cohort_matrix", "retention_alert", "rolling_active_users_orders", "ltv_to_cac"],
)
def test_query_equals_sql_on_more_rows(spark, middle, name):
    frame = contract.queries()[name](spark, MIDDLE)
    assert harness.spark_result(frame) == harness.duck_result(middle, contract.oracle_sql()[name])


@pytest.mark.parametrize(
    "name",
    ["first_purchase", "acquisition_funnel", "stickiness_weekly", "step_times", "cac", "curate_product_events"],
)
def test_results_do_not_depend_on_the_session_time_zone(spark, small, name):
    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    spark.conf.set(zone, "Pacific/Auckland")
    try:
        result = harness.spark_result(contract.queries()[name](spark, SMALL))
    finally:
        spark.conf.set(zone, before)
    assert result == harness.duck_result(small, contract.oracle_sql()[name])


def test_entry_is_the_acquisition_funnel(spark):
    (row,) = contract.entry(spark).collect()
    assert row.clientes_adquiridos == 150


def test_known_results(spark):
    """Figures worked out beforehand on the same tables."""
    queries = contract.queries()
    (funnel,) = queries["acquisition_funnel"](spark, MIDDLE).collect()
    assert tuple(funnel) == (1500, 171, 33, 11.4, 19.3)
    assert queries["cohort_matrix"](spark, MIDDLE).count() == 1845
    (alert,) = queries["retention_alert"](spark, MIDDLE).collect()
    assert str(alert[0]) == "2001-06-01" and tuple(alert[1:]) == (100.0, 66.67, 33.33, "OK")
    (stats,) = queries["clean_retail_stats"](spark, MIDDLE).collect()
    assert tuple(stats) == (60000, 2914, 19507, 5340, 32239, 27761)
    weeks = queries["stickiness_weekly"](spark, MIDDLE).collect()
    assert tuple(weeks[0])[1:] == (131.3, 147.3, 89.39)
    assert tuple(weeks[1])[1:] == (134.7, 150.0, 89.81)
    (ltv,) = queries["ltv"](spark, MIDDLE).collect()
    assert tuple(ltv)[:3] == (268363.09, 9.37, 2515456.71)
    (rates,) = queries["ab_significance"](spark, MIDDLE).collect()
    assert tuple(rates)[:4] == (69, 750, 93, 750)
