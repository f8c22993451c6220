"""Names that reports read: result columns and views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideline.operators.engagement import dau
from tideline.operators.funnel import first_purchase
from tideline.operators.metrics import monthly_transactions

# Columns of every result, in order.
RESULT_COLUMNS: dict[str, tuple[str, ...]] = {
    "first_purchase": ("customer_id", "first_purchase_date", "acquisition_cohort_month"),
    "activation": ("customer_id", "first_purchase_day", "activated"),
    "acquisition_funnel": (
        "clientes_adquiridos",
        "clientes_activados",
        "clientes_retenidos",
        "pct_activacion",
        "pct_retencion_sobre_activados",
    ),
    "cohort_matrix": (
        "cohort_month",
        "month_number",
        "cohort_customers",
        "active_customers",
        "pct_retained",
    ),
    "retention_alert": (
        "mes_mas_reciente",
        "retencion_mes_mas_reciente",
        "retencion_promedio_3_meses_previos",
        "diferencia_puntos_pct",
        "estado",
    ),
    "ab_rates": ("variant", "usuarios", "conversiones", "tasa_conversion_pct"),
    "ab_difference": ("tasa_control", "tasa_test", "diferencia_absoluta", "n_control", "n_test"),
    "ab_significance": (
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
        "significativo_95pct",
        "interpretacion",
    ),
    "step_funnel": (
        "step_order",
        "event_name",
        "usuarios_unicos",
        "pct_sobre_signup",
        "pct_conversion_paso_anterior",
    ),
    "step_times": (
        "horas_signup_a_login",
        "horas_login_a_view_service",
        "horas_view_service_a_start_application",
        "horas_start_application_a_complete_kyc",
        "horas_complete_kyc_a_first_transaction",
    ),
    "users_per_event": ("event_name", "usuarios_unicos"),
    "dau": ("activity_day", "dau"),
    "rolling_active_users": ("activity_day", "mau"),
    "stickiness_weekly": (
        "activity_week",
        "dau_promedio_semana",
        "mau_promedio_semana",
        "stickiness_pct_promedio",
    ),
    "cac": ("channel", "month", "nuevos_usuarios", "acquisition_cost_pen", "cac_pen"),
    "kyc_rates": (
        "channel",
        "total_kyc",
        "aprobados",
        "rechazados",
        "pct_aprobacion",
        "pct_rechazo",
    ),
    "monthly_transactions": ("month", "user_id", "amount", "is_fraud"),
    "tpv": ("month", "tpv_pen", "n_transacciones", "ticket_promedio_pen"),
    "arpu": ("month", "tpv_pen", "usuarios_activos", "arpu_pen"),
    "ltv": (
        "arpu_promedio_pen",
        "retencion_promedio_meses",
        "ltv_simplificado_pen",
        "nota_metodologica",
    ),
    "ltv_to_cac": ("channel", "cac_promedio_pen", "ltv_simplificado_pen", "ratio_ltv_cac"),
    "fraud_rate": ("month", "total_transacciones", "transacciones_fraude", "tasa_fraude_pct"),
    "clean_retail_stats": (
        "filas_originales",
        "filas_sin_customer_id_descartadas",
        "filas_canceladas_descartadas",
        "filas_cantidad_o_precio_no_positivo_descartadas",
        "filas_finales",
        "total_filas_descartadas",
    ),
}

# Names of the views over the curated tables.
FIRST_PURCHASE_VIEW = "v_first_purchase"
DAU_VIEW = "v_dau"
MONTHLY_TRANSACTIONS_VIEW = "v_monthly_transactions"


def register_views(transactions: DataFrame, events: DataFrame) -> None:
    """Session views for SQL users, over curated retail lines and product events."""
    first_purchase(transactions).createOrReplaceTempView(FIRST_PURCHASE_VIEW)
    dau(events).createOrReplaceTempView(DAU_VIEW)
    monthly_transactions(events).createOrReplaceTempView(MONTHLY_TRANSACTIONS_VIEW)
