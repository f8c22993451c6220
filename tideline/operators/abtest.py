"""Two-variant conversion tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ratios import percent, ratio
from tideline.functions.stats import formatted, two_sided_p

# Names of the two variants.
CONTROL = "control"
TEST = "test"


def ab_rates(ab: DataFrame, variant: str = "variant", converted: str = "converted") -> DataFrame:
    """Users, conversions and conversion percentage of every variant."""
    counts = ab.groupBy(F.col(variant).alias("variant")).agg(
        F.count("*").alias("usuarios"),
        F.sum(F.col(converted).cast("int")).alias("conversiones"),
    )
    rates = counts.withColumn("tasa_conversion_pct", percent("conversiones", "usuarios"))
    return rates.orderBy(F.asc_nulls_last("variant"))


def ab_difference(
    ab: DataFrame, variant: str = "variant", converted: str = "converted"
) -> DataFrame:
    """One row: both unrounded rates, test minus control, and both sizes.

    A variant without rows gives NULLs.
    """
    hit = F.col(converted).cast("int")

    def size(name: str) -> Column:
        return F.nullif(F.count_if(F.col(variant) == name), F.lit(0))

    sums = ab.agg(
        F.sum(F.when(F.col(variant) == CONTROL, hit)).alias("control_hits"),
        F.sum(F.when(F.col(variant) == TEST, hit)).alias("test_hits"),
        size(CONTROL).alias("n_control"),
        size(TEST).alias("n_test"),
    )
    control, test = ratio("control_hits", "n_control"), ratio("test_hits", "n_test")
    return sums.select(
        control.alias("tasa_control"),
        test.alias("tasa_test"),
        (test - control).alias("diferencia_absoluta"),
        "n_control",
        "n_test",
    )


def ab_significance(
    ab: DataFrame,
    variant: str = "variant",
    converted: str = "converted",
    by: str | None = None,
) -> DataFrame:
    """Two-proportion z-test with pooled variance, one row per experiment.

    ``by`` names the experiment column; without it all rows are one experiment.
    Facts are only counted; the test itself is arithmetic on one row each. A
    missing variant, or rates without any variance, leave z, p and text NULL.
    """
    hit = F.col(converted).cast("int")
    keys = [by] if by else []

    def hits(name: str) -> Column:
        return F.sum(F.when(F.col(variant) == name, hit))

    def size(name: str) -> Column:
        return F.count(F.when(F.col(variant) == name, hit))

    counts = ab.groupBy(*keys).agg(
        hits(CONTROL).alias("conversiones_control"),
        size(CONTROL).alias("n_control"),
        hits(TEST).alias("conversiones_test"),
        size(TEST).alias("n_test"),
    )
    return significance_of_counts(counts, keys)


def significance_of_counts(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The z-test on rows that already hold both variants' counts."""
    rates = counts.withColumns(
        {
            "tasa_control": ratio("conversiones_control", "n_control"),
            "tasa_test": ratio("conversiones_test", "n_test"),
            "pooled": ratio(
                F.col("conversiones_control") + F.col("conversiones_test"),
                F.col("n_control") + F.col("n_test"),
            ),
        }
    )
    spread = F.sqrt(
        F.col("pooled")
        * (1 - F.col("pooled"))
        * (ratio(F.lit(1), "n_control") + ratio(F.lit(1), "n_test"))
    )
    change = F.col("tasa_test") - F.col("tasa_control")
    tested = rates.withColumns(
        {
            "diferencia_absoluta": change,
            "diferencia_relativa_pct": ratio(100 * change, "tasa_control"),
            "z_score": ratio(change, spread),
        }
    ).withColumn("p_value", two_sided_p("z_score"))
    significant = F.col("p_value") < 0.05
    return tested.select(
        *(keys or []),
        "conversiones_control",
        "n_control",
        "conversiones_test",
        "n_test",
        "tasa_control",
        "tasa_test",
        "diferencia_absoluta",
        "diferencia_relativa_pct",
        "z_score",
        "p_value",
        significant.alias("significativo_95pct"),
        _verdict(significant).alias("interpretacion"),
    )


def _verdict(significant: Column) -> Column:
    # Wording of the verdict.
    rates = (
        "La variante 'test' convierte %(test).2f%% vs. %(control).2f%% de 'control' "
        "(%(change)+.2f p.p."
    )
    relative = ", %(relative)+.1f%% relativo"
    scores = "). Con z=%(z).2f y p=%(p).2e "
    launch = (
        "(< 0.05), la diferencia es estadísticamente significativa al 95%% de confianza: "
        "se recomienda lanzar la variante 'test'."
    )
    no_launch = (
        "(>= 0.05), la diferencia NO es estadísticamente significativa al 95%% de confianza."
    )
    pattern = F.concat(
        F.lit(rates),
        F.when(F.col("diferencia_relativa_pct").isNotNull(), relative).otherwise(""),
        F.lit(scores),
        F.when(significant, launch).otherwise(no_launch),
    )
    return formatted(
        F.when(F.col("p_value").isNotNull(), pattern),
        test=100 * F.col("tasa_test"),
        control=100 * F.col("tasa_control"),
        change=100 * F.col("diferencia_absoluta"),
        relative=F.col("diferencia_relativa_pct"),
        z=F.col("z_score"),
        p=F.col("p_value"),
    )
