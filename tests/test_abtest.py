import math

import pytest

from tideline.operators.abtest import ab_difference, ab_rates, ab_significance, significance_of_counts


@pytest.fixture
def ab(spark):
    def build(**variants):
        rows = []
        for name, (hits, size) in variants.items():
            rows += [(name, "1")] * hits + [(name, "0")] * (size - hits)
        return spark.createDataFrame(rows or [("x", "0")], "variant string, converted string").filter(
            "variant <> 'x'"
        )

    return build


PUBLISHED = {"control": (188, 2500), "test": (276, 2500)}


def test_rates(ab):
    assert [tuple(row) for row in ab_rates(ab(**PUBLISHED)).collect()] == [
        ("control", 2500, 188, 7.52),
        ("test", 2500, 276, 11.04),
    ]


def test_difference_is_not_rounded(ab):
    (row,) = ab_difference(ab(**PUBLISHED)).collect()
    assert tuple(row) == (0.0752, 0.1104, 0.035199999999999995, 2500, 2500)


def test_difference_without_a_variant(ab):
    (row,) = ab_difference(ab(control=(1, 4))).collect()
    assert tuple(row) == (0.25, None, None, 4, None)


def test_published_significance(ab):
    (row,) = ab_significance(ab(**PUBLISHED)).collect()
    assert tuple(row)[:4] == (188, 2500, 276, 2500)
    assert row.diferencia_absoluta == 0.035199999999999995
    assert row.diferencia_relativa_pct == pytest.approx(46.80851063829787, rel=1e-14)
    assert row.z_score == pytest.approx(4.289159149877533, rel=1e-14)
    assert row.p_value == pytest.approx(1.7935082624376264e-05, rel=1e-9)
    assert row.significativo_95pct is True
    assert row.interpretacion == (
        "La variante 'test' convierte 11.04% vs. 7.52% de 'control' (+3.52 p.p., +46.8% relativo). "
        "Con z=4.29 y p=1.79e-05 (< 0.05), la diferencia es estadísticamente significativa al 95% "
        "de confianza: se recomienda lanzar la variante 'test'."
    )


def test_drop_shows_its_sign_and_no_recommendation(ab):
    (row,) = ab_significance(ab(control=(13, 160), test=(12, 160))).collect()
    assert row.significativo_95pct is False
    # 8.125 is a tie in binary too and goes to the even digit; the difference is no tie.
    assert "7.50% vs. 8.12% de 'control' (-0.63 p.p., -7.7% relativo)" in row.interpretacion
    assert "NO es" in row.interpretacion


def test_missing_variant_has_no_test(ab):
    (row,) = ab_significance(ab(test=(3, 10))).collect()
    assert (row.n_control, row.n_test) == (0, 10)
    assert (row.z_score, row.p_value, row.significativo_95pct, row.interpretacion) == (None,) * 4


def test_rates_without_variance_have_no_test(ab):
    (row,) = ab_significance(ab(control=(0, 10), test=(0, 10))).collect()
    assert row.diferencia_absoluta == 0.0
    assert (row.z_score, row.p_value, row.interpretacion) == (None, None, None)


def test_control_without_conversions_has_no_relative_change(ab):
    (row,) = ab_significance(ab(control=(0, 10), test=(5, 10))).collect()
    assert row.diferencia_relativa_pct is None
    assert "(+50.00 p.p.). Con z=" in row.interpretacion


def test_unknown_outcomes_count_as_no_trial(spark):
    rows = [("control", "1"), ("control", None), ("test", "0"), ("test", "1")]
    (row,) = ab_significance(spark.createDataFrame(rows, "variant string, converted string")).collect()
    assert (row.n_control, row.n_test) == (1, 2)


def test_many_experiments_in_one_job(spark, ab):
    from pyspark.sql import functions as F

    both = ab(**PUBLISHED).withColumn("exp", F.lit("a")).unionByName(
        ab(control=(1, 5), test=(2, 5)).withColumn("exp", F.lit("b"))
    )
    rows = {row.exp: row for row in ab_significance(both, by="exp").collect()}
    assert rows["a"].z_score == pytest.approx(4.289159149877533, rel=1e-14)
    assert rows["b"].n_test == 5


def test_p_value_keeps_its_precision_in_the_tail(spark):
    counts = spark.createDataFrame(
        [(1000, 100000, 2000, 100000)],
        "conversiones_control long, n_control long, conversiones_test long, n_test long",
    )
    (row,) = significance_of_counts(counts).collect()
    assert 0 < row.p_value < 1e-70
    assert row.p_value == pytest.approx(math.erfc(row.z_score / math.sqrt(2)), rel=1e-12)
