"""The registered queries once more, as plain SQL for DuckDB.

Written the direct way (range joins, self-joins, correlated subqueries), so that
it shares no shortcut with the operators it checks.
"""

from __future__ import annotations


def _rounded(expression: str, digits: int) -> str:
    # Half up on the decimal form, as Spark rounds doubles.
    return f"CAST(round(CAST({expression} AS DECIMAL(30, 12)), {digits}) AS DOUBLE)"


def _sum(expression: str) -> str:
    # Exact, whatever the order.
    return f"CAST(sum(CAST({expression} AS DECIMAL(28, 10))) AS DOUBLE)"


def _percent(part: str, whole: str, digits: int = 2) -> str:
    return _rounded(f"100.0::DOUBLE * ({part}) / nullif({whole}, 0)", digits)


# --- inputs ---------------------------------------------------------------------------------

PURCHASE_DAYS = """
days AS (
  SELECT DISTINCT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS d FROM orders
)"""

COHORT_CELLS = """
months AS (
  SELECT DISTINCT o_custkey AS customer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m
  FROM orders
),
joined_in AS (SELECT customer_id, min(m) AS cohort FROM months GROUP BY 1),
sizes AS (SELECT cohort, count(*) AS size FROM joined_in GROUP BY 1),
cells AS (
  SELECT j.cohort, date_diff('month', j.cohort, m.m) AS k, count(*) AS active
  FROM joined_in j JOIN months m USING (customer_id)
  GROUP BY 1, 2
)"""

AB = """
ab AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'test' END AS variant,
         CASE WHEN c_acctbal > CASE WHEN c_custkey % 2 = 0 THEN 9100 ELSE 8700 END
              THEN 1 ELSE 0 END AS converted,
         c_mktsegment AS experiment
  FROM customer
)"""

PRODUCT_EVENTS = """
users AS (
  SELECT user_id,
         user_id % 20 <> 0 AS logs_in,
         user_id % 20 <> 0 AND user_id % 4 <> 1 AS views,
         user_id % 20 <> 0 AND user_id % 4 <> 1 AND user_id % 5 IN (0, 1, 2) AS applies,
         user_id % 20 <> 0 AND user_id % 4 <> 1 AND user_id % 5 IN (0, 1) AS pays,
         CASE WHEN user_id % 10 IN (0, 1) THEN 'referido'
              WHEN user_id % 10 IN (2, 3, 4) THEN 'pagado' ELSE 'organico' END AS channel
  FROM (SELECT DISTINCT user_id FROM events)
),
named AS (
  SELECT e.*, u.channel, u.pays,
         CASE WHEN event_type = 'signup' OR NOT logs_in THEN 'signup'
              WHEN event_type = 'view' AND views AND event_id % 3 <> 0 THEN 'view_service'
              WHEN event_type = 'click' AND applies THEN 'start_application'
              WHEN event_type = 'error' AND applies THEN 'complete_kyc'
              WHEN event_type = 'purchase' AND pays AND event_id % 4 = 0 THEN 'first_transaction'
              WHEN event_type = 'purchase' AND pays THEN 'repeat_transaction'
              ELSE 'login' END AS event_name
  FROM events e JOIN users u USING (user_id)
),
pe AS (
  SELECT user_id, channel, event_name, ts AS event_timestamp,
         CASE WHEN event_name LIKE '%\\_transaction' ESCAPE '\\' THEN value END AS amount,
         CASE WHEN event_name LIKE '%\\_transaction' ESCAPE '\\' THEN event_id % 67 = 0 END
           AS is_fraud,
         CASE WHEN event_name = 'complete_kyc'
              THEN CASE WHEN pays THEN 'kyc_approved' ELSE 'kyc_rejected' END END AS kyc_result
  FROM named
)"""

ORDER_MONTHS = """
tx AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS user_id,
         o_totalprice AS amount, o_orderkey % 67 = 0 AS is_fraud
  FROM orders
)"""

SIGNUPS = """
signups AS (
  SELECT c_mktsegment AS channel, c_custkey AS user_id,
         (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS joined_at
  FROM customer
),
joined AS (
  SELECT channel, strftime(joined_at, '%Y-%m') AS month, month(joined_at) AS number,
         count(*) AS new_users
  FROM signups WHERE joined_at IS NOT NULL GROUP BY ALL
),
spent AS (
  SELECT channel, month, new_users,
         CAST(round(CAST(new_users * (10 + length(channel)) * (1 + (number % 5) / 20.0::DOUBLE)
                         AS DECIMAL(30, 12)), 2) AS DOUBLE) AS cost
  FROM joined
)"""

LTV_PARTS = f"""
monthly AS (
  SELECT month, {_sum('amount')} / count(DISTINCT user_id) AS per_user FROM tx GROUP BY 1
),
stays AS (SELECT user_id, count(DISTINCT month) AS n FROM tx GROUP BY 1),
value AS (
  SELECT (SELECT avg(per_user) FROM monthly) AS a, (SELECT avg(n) FROM stays) AS r
)"""

RETAIL = """
source AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END || o_orderkey AS invoice,
         CAST(l_partkey AS VARCHAR) AS stock, p_name AS description,
         CAST(CASE WHEN l_linenumber = 7 THEN -l_quantity ELSE l_quantity END AS INTEGER) AS quantity,
         o_orderdate AS sold_at, l_extendedprice / l_quantity AS price,
         CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE o_custkey END AS customer,
         n_name AS country
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
),
kept AS (
  SELECT *, quantity * price AS total FROM source
  WHERE customer IS NOT NULL AND invoice NOT LIKE 'C%' AND quantity > 0 AND price > 0
)"""

# --- shared bodies --------------------------------------------------------------------------

_TEST = f"""
counts AS (
  SELECT experiment,
         count(*) FILTER (variant = 'control') AS nc,
         count(*) FILTER (variant = 'test') AS nt,
         CAST(sum(converted) FILTER (variant = 'control') AS BIGINT) AS hc,
         CAST(sum(converted) FILTER (variant = 'test') AS BIGINT) AS ht
  FROM tested GROUP BY 1
),
scores AS (
  SELECT *, hc / nc AS pc, ht / nt AS pt,
         (ht / nt - hc / nc)
           / sqrt((hc + ht) / (nc + nt) * (1 - (hc + ht) / (nc + nt)) * (1 / nc + 1 / nt)) AS z
  FROM counts
),
-- Simpson's rule for the normal density from |z| on, where nothing cancels
tail AS (
  SELECT experiment,
         sum(CASE WHEN i IN (0, 12000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * exp(-0.5 * power(abs(z) + i * 0.001::DOUBLE, 2)) / sqrt(2 * pi()))
           * 0.001::DOUBLE / 3 AS area
  FROM scores, range(0, 12001) AS steps(i) GROUP BY 1
),
p AS (SELECT s.*, 2 * area AS p FROM scores s JOIN tail USING (experiment))
"""

_TEST_COLUMNS = f"""
  hc AS conversiones_control, nc AS n_control, ht AS conversiones_test, nt AS n_test,
  {_rounded('pc', 9)} AS tasa_control, {_rounded('pt', 9)} AS tasa_test,
  {_rounded('pt - pc', 9)} AS diferencia_absoluta,
  {_rounded('100 * (pt - pc) / nullif(pc, 0)', 9)} AS diferencia_relativa_pct,
  {_rounded('z', 9)} AS z_score, {_rounded('p', 9)} AS p_value,
  p < 0.05 AS significativo_95pct,
  printf('La variante ''test'' convierte %.2f%% vs. %.2f%% de ''control'' (%+.2f p.p.',
         100 * pt, 100 * pc, 100 * (pt - pc))
  || CASE WHEN pc > 0 THEN printf(', %+.1f%% relativo', 100 * (pt - pc) / pc) ELSE '' END
  || printf('). Con z=%.2f y p=%.2e ', z, p)
  || CASE WHEN p < 0.05
     THEN '(< 0.05), la diferencia es estadísticamente significativa al 95% de confianza: se recomienda lanzar la variante ''test''.'
     ELSE '(>= 0.05), la diferencia NO es estadísticamente significativa al 95% de confianza.' END
     AS interpretacion
"""

_STEP_FUNNEL = f"""
reached AS (
  SELECT 1 AS n, 'signup' AS step, (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'signup') AS u
  UNION ALL SELECT 2, 'login', (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'login')
  UNION ALL SELECT 3, 'view_service', (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'view_service')
  UNION ALL SELECT 4, 'start_application', (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'start_application')
  UNION ALL SELECT 5, 'complete_kyc', (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'complete_kyc')
  UNION ALL SELECT 6, 'kyc_approved', (SELECT count(DISTINCT user_id) FROM pe WHERE kyc_result = 'kyc_approved')
  UNION ALL SELECT 7, 'first_transaction', (SELECT count(DISTINCT user_id) FROM pe WHERE event_name = 'first_transaction')
),
seen AS (SELECT * FROM reached WHERE u > 0 OR n = 6)
SELECT n AS step_order, step AS event_name, u AS usuarios_unicos,
       {_percent('u', '(SELECT arg_min(u, n) FROM seen)')} AS pct_sobre_signup,
       {_percent('u', '(SELECT arg_max(b.u, b.n) FROM seen b WHERE b.n < seen.n)')}
         AS pct_conversion_paso_anterior
FROM seen
"""

_ROLLING = """
days AS (SELECT DISTINCT CAST(date_trunc('day', seen_at) AS TIMESTAMP) AS d FROM seen),
windows AS (
  SELECT d, count(DISTINCT user_id) AS users
  FROM days JOIN seen ON seen_at <= d AND seen_at > d - INTERVAL 30 DAY
  GROUP BY d
)"""

_EVENT_SEEN = "seen AS (SELECT user_id, ts AS seen_at FROM events)"
_ORDER_SEEN = "seen AS (SELECT o_custkey AS user_id, o_orderdate AS seen_at FROM orders)"


def _kyc(source: str) -> str:
    def line(channel: str) -> str:
        return f"""
  SELECT {channel} AS channel, count(*) AS total_kyc,
         count(*) FILTER (result = 'kyc_approved') AS aprobados,
         count(*) FILTER (result = 'kyc_rejected') AS rechazados
  FROM checks"""

    return f"""
WITH {source},
lines AS ({line('channel')} GROUP BY 1 UNION ALL {line('NULL')})
SELECT *, {_percent('aprobados', 'total_kyc')} AS pct_aprobacion,
       {_percent('rechazados', 'total_kyc')} AS pct_rechazo
FROM lines
"""


def _hours(start: str, end: str) -> str:
    minutes = f"avg(date_sub('minute', {start}, {end}))"
    return f"{_rounded(f'{minutes} / 60.0::DOUBLE', 2)} AS horas_{start}_a_{end}"


_STEP_NAMES = (
    "signup",
    "login",
    "view_service",
    "start_application",
    "complete_kyc",
    "first_transaction",
)

ORACLE: dict[str, str] = {
    "first_purchase": """
SELECT o_custkey AS customer_id, min(o_orderdate) AS first_purchase_date,
       CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS acquisition_cohort_month
FROM orders GROUP BY 1
""",
    "activation": f"""
WITH {PURCHASE_DAYS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d) AS n FROM days)
SELECT one.customer_id, one.d AS first_purchase_day,
       CASE WHEN two.d - one.d <= 30 THEN 1 ELSE 0 END AS activated
FROM numbered one
LEFT JOIN numbered two ON two.customer_id = one.customer_id AND two.n = 2
WHERE one.n = 1
""",
    "acquisition_funnel": f"""
WITH {PURCHASE_DAYS},
firsts AS (SELECT customer_id, min(d) AS f FROM days GROUP BY 1),
customers AS (
  SELECT EXISTS (FROM days x WHERE x.customer_id = c.customer_id AND x.d > f AND x.d - f <= 30) AS a,
         EXISTS (FROM days x WHERE x.customer_id = c.customer_id AND x.d - f > 30
                 AND x.d <= f + INTERVAL 3 MONTH) AS r
  FROM firsts c
),
totals AS (
  SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (a AND r) AS r FROM customers
)
SELECT n AS clientes_adquiridos, a AS clientes_activados, r AS clientes_retenidos,
       {_percent('a', 'n')} AS pct_activacion, {_percent('r', 'a')} AS pct_retencion_sobre_activados
FROM totals
""",
    "cohort_matrix": f"""
WITH {COHORT_CELLS}
SELECT cohort AS cohort_month, k AS month_number, size AS cohort_customers,
       active AS active_customers, {_percent('active', 'size')} AS pct_retained
FROM cells JOIN sizes USING (cohort)
""",
    "retention_alert": f"""
WITH {COHORT_CELLS},
first_month AS (
  SELECT cohort, {_percent('active', 'size')} AS pct
  FROM cells JOIN sizes USING (cohort) WHERE k = 1
),
latest AS (FROM first_month WHERE cohort = (SELECT max(cohort) FROM first_month)),
earlier AS (
  SELECT avg(pct) AS mean FROM (
    FROM first_month WHERE cohort < (SELECT cohort FROM latest) ORDER BY cohort DESC LIMIT 3)
)
SELECT cohort AS mes_mas_reciente, pct AS retencion_mes_mas_reciente,
       {_rounded('mean', 2)} AS retencion_promedio_3_meses_previos,
       {_rounded('pct - mean', 2)} AS diferencia_puntos_pct,
       CASE WHEN mean - pct > 5 THEN 'ALERTA: caida > 5pp' ELSE 'OK' END AS estado
FROM latest, earlier
""",
    "ab_rates": f"""
WITH {AB}
SELECT variant, count(*) AS usuarios, CAST(sum(converted) AS BIGINT) AS conversiones,
       {_percent('sum(converted)', 'count(*)')} AS tasa_conversion_pct
FROM ab GROUP BY 1
""",
    "ab_difference": f"""
WITH {AB},
control AS (SELECT avg(converted) AS rate, count(*) AS n FROM ab WHERE variant = 'control'),
test AS (SELECT avg(converted) AS rate, count(*) AS n FROM ab WHERE variant = 'test')
SELECT {_rounded('control.rate', 12)} AS tasa_control, {_rounded('test.rate', 12)} AS tasa_test,
       {_rounded('test.rate - control.rate', 12)} AS diferencia_absoluta,
       control.n AS n_control, test.n AS n_test
FROM control, test
""",
    "ab_significance": f"""
WITH {AB}, tested AS (SELECT variant, converted, 'all' AS experiment FROM ab), {_TEST}
SELECT {_TEST_COLUMNS} FROM p
""",
    "ab_significance_by_experiment": f"""
WITH {AB}, tested AS (FROM ab), {_TEST}
SELECT experiment, {_TEST_COLUMNS} FROM p
""",
    "step_funnel": f"WITH {PRODUCT_EVENTS}, {_STEP_FUNNEL}",
    "step_times": f"""
WITH {PRODUCT_EVENTS},
firsts AS (
  SELECT {', '.join(f"min(event_timestamp) FILTER (event_name = '{s}') AS {s}" for s in _STEP_NAMES)}
  FROM pe GROUP BY user_id
)
SELECT {', '.join(_hours(a, b) for a, b in zip(_STEP_NAMES, _STEP_NAMES[1:]))} FROM firsts
""",
    "users_per_event": f"""
WITH {PRODUCT_EVENTS}
SELECT event_name, count(DISTINCT user_id) AS usuarios_unicos FROM pe GROUP BY 1
""",
    "dau": """
SELECT CAST(ts AS DATE) AS activity_day, count(DISTINCT user_id) AS dau FROM events GROUP BY 1
""",
    "rolling_active_users": f"""
WITH {_EVENT_SEEN}, {_ROLLING}
SELECT CAST(d AS DATE) AS activity_day, users AS mau FROM windows
""",
    "rolling_active_users_orders": f"""
WITH {_ORDER_SEEN}, {_ROLLING}
SELECT CAST(d AS DATE) AS activity_day, users AS mau FROM windows
""",
    "rolling_active_users_with_today": """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
SELECT d AS activity_day, count(DISTINCT user_id) AS mau
FROM days JOIN events ON CAST(ts AS DATE) BETWEEN d - 6 AND d
GROUP BY d
""",
    "stickiness_weekly": f"""
WITH {_EVENT_SEEN}, {_ROLLING},
daily AS (
  SELECT CAST(date_trunc('day', seen_at) AS TIMESTAMP) AS d, count(DISTINCT user_id) AS dau
  FROM seen GROUP BY 1
)
SELECT CAST(date_trunc('week', d) AS DATE) AS activity_week,
       {_rounded('avg(dau)', 1)} AS dau_promedio_semana,
       {_rounded('avg(users)', 1)} AS mau_promedio_semana,
       {_rounded('100 * avg(dau / users)', 2)} AS stickiness_pct_promedio
FROM daily JOIN windows USING (d) GROUP BY 1
""",
    "cac": f"""
WITH {SIGNUPS}
SELECT channel, month, new_users AS nuevos_usuarios, cost AS acquisition_cost_pen,
       {_rounded('cost / new_users', 2)} AS cac_pen
FROM spent
""",
    "kyc_rates": _kyc(
        f"{PRODUCT_EVENTS}, checks AS "
        "(SELECT channel, kyc_result AS result FROM pe WHERE event_name = 'complete_kyc')"
    ),
    "kyc_rates_customers": _kyc(
        "checks AS (SELECT c_mktsegment AS channel, "
        "CASE WHEN c_acctbal > 0 THEN 'kyc_approved' ELSE 'kyc_rejected' END AS result FROM customer)"
    ),
    "monthly_transactions": f"WITH {ORDER_MONTHS} SELECT * FROM tx",
    "tpv": f"""
WITH {ORDER_MONTHS}
SELECT month, {_rounded(_sum('amount'), 2)} AS tpv_pen, count(*) AS n_transacciones,
       {_rounded(_sum('amount') + ' / count(amount)', 2)} AS ticket_promedio_pen
FROM tx GROUP BY 1
""",
    "arpu": f"""
WITH {ORDER_MONTHS}
SELECT month, {_sum('amount')} AS tpv_pen, count(DISTINCT user_id) AS usuarios_activos,
       {_rounded(_sum('amount') + ' / count(DISTINCT user_id)', 2)} AS arpu_pen
FROM tx GROUP BY 1
""",
    "ltv": f"""
WITH {ORDER_MONTHS}, {LTV_PARTS}
SELECT {_rounded('a', 2)} AS arpu_promedio_pen, {_rounded('r', 2)} AS retencion_promedio_meses,
       {_rounded('a * r', 2)} AS ltv_simplificado_pen,
       'Aproximacion: ventana de datos de 6 meses, no cohorte madura' AS nota_metodologica
FROM value
""",
    "ltv_to_cac": f"""
WITH {ORDER_MONTHS}, {LTV_PARTS}, {SIGNUPS},
channels AS (
  SELECT channel, {_sum('cost')} / sum(new_users) AS cac FROM spent GROUP BY 1
)
SELECT channel, {_rounded('cac', 2)} AS cac_promedio_pen,
       {_rounded('a * r', 2)} AS ltv_simplificado_pen,
       {_rounded('a * r / cac', 2)} AS ratio_ltv_cac
FROM channels, value
""",
    "fraud_rate": f"""
WITH {ORDER_MONTHS}
SELECT month, count(*) AS total_transacciones, count(*) FILTER (is_fraud) AS transacciones_fraude,
       {_percent('count(*) FILTER (is_fraud)', 'count(*)', 3)} AS tasa_fraude_pct
FROM tx GROUP BY 1
""",
    "clean_retail": f"""
WITH {RETAIL}
SELECT invoice AS InvoiceNo, stock AS StockCode, description AS Description, quantity AS Quantity,
       sold_at AS InvoiceDate, price AS UnitPrice, CAST(customer AS BIGINT) AS CustomerID,
       country AS Country, total AS TotalPrice
FROM kept
""",
    "clean_retail_stats": f"""
WITH {RETAIL},
a AS (SELECT count(*) AS n FROM source),
b AS (SELECT count(*) AS n FROM source WHERE customer IS NOT NULL),
c AS (SELECT count(*) AS n FROM source WHERE customer IS NOT NULL AND invoice NOT LIKE 'C%'),
d AS (SELECT count(*) AS n FROM kept)
SELECT a.n AS filas_originales, a.n - b.n AS filas_sin_customer_id_descartadas,
       b.n - c.n AS filas_canceladas_descartadas,
       c.n - d.n AS filas_cantidad_o_precio_no_positivo_descartadas,
       d.n AS filas_finales, a.n - d.n AS total_filas_descartadas
FROM a, b, c, d
""",
    "curate_retail": f"""
WITH {RETAIL}
SELECT invoice AS invoice_no, stock AS stock_code, description, quantity, sold_at AS invoice_date,
       price AS unit_price, CAST(customer AS BIGINT) AS customer_id, country, total AS total_price,
       CAST(year(sold_at) AS VARCHAR) AS year, CAST(month(sold_at) AS VARCHAR) AS month
FROM kept
""",
    "curate_product_events": f"""
WITH {PRODUCT_EVENTS}
SELECT CAST(user_id AS VARCHAR) AS user_id, channel, event_name,
       CAST(date_trunc('second', event_timestamp) AS TIMESTAMP) AS event_timestamp,
       amount, is_fraud, kyc_result,
       CAST(year(event_timestamp) AS VARCHAR) AS year,
       CAST(month(event_timestamp) AS VARCHAR) AS month
FROM pe
""",
    "retail_sources_roundtrip": f"""
WITH {RETAIL}
SELECT country AS "Country", count(*) AS lines, count(*) FILTER (year(sold_at) < 1998) AS described,
       CAST(sum(quantity) AS BIGINT) AS units, max(sold_at) AS last_invoice,
       {_rounded(_sum('total'), 2)} AS revenue
FROM kept GROUP BY 1
""",
    "retail_csv_roundtrip": f"""
WITH {RETAIL}
SELECT CAST(year(sold_at) AS VARCHAR) AS year, CAST(month(sold_at) AS VARCHAR) AS month,
       count(*) AS lines, count(DISTINCT invoice) AS invoices, CAST(max(customer) AS BIGINT) AS last_customer,
       CAST(sum(quantity) AS BIGINT) AS units, min(sold_at) AS first_invoice,
       max(description) AS last_description, {_rounded(_sum('total'), 2)} AS revenue
FROM kept GROUP BY 1, 2
""",
    "events_parquet_roundtrip": f"WITH {PRODUCT_EVENTS}, {_STEP_FUNNEL}",
}

ORACLE |= {
    "export_roundtrip": ORACLE["cohort_matrix"],
    "events_csv_funnel": ORACLE["step_funnel"],
    "events_csv_kyc_rates": ORACLE["kyc_rates"],
    "ab_rates_csv": ORACLE["ab_rates"],
    "ab_significance_csv": ORACLE["ab_significance"],
    "cac_csv": ORACLE["cac"],
    "catalog_partitions": f"""
WITH {PRODUCT_EVENTS}
SELECT CAST(year(event_timestamp) AS VARCHAR) AS year, CAST(month(event_timestamp) AS VARCHAR) AS month,
       count(*) AS eventos,
       count(*) FILTER (event_name IN ('first_transaction', 'repeat_transaction')) AS pagos
FROM pe GROUP BY 1, 2
""",
    "retail_by_month_and_country": f"""
WITH {RETAIL}
SELECT CAST(year(sold_at) AS VARCHAR) AS year, CAST(month(sold_at) AS VARCHAR) AS month, country,
       count(*) AS lines, {_rounded(_sum('total'), 2)} AS revenue
FROM kept GROUP BY 1, 2, 3
""",
    "views_in_sql": f"""
WITH {PRODUCT_EVENTS},
firsts AS (SELECT o_custkey, min(o_orderdate) AS t FROM orders GROUP BY 1),
daily AS (SELECT CAST(event_timestamp AS DATE) AS d, count(DISTINCT user_id) AS users FROM pe GROUP BY 1),
acquired AS (SELECT strftime(t, '%Y-%m') AS month, count(*) AS customers, min(t) AS earliest FROM firsts GROUP BY 1),
active AS (SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, max(users) AS most_users FROM daily GROUP BY 1),
paid AS (
  SELECT strftime(event_timestamp, '%Y-%m') AS month, count(*) AS payments, count(*) FILTER (is_fraud) AS frauds
  FROM pe WHERE event_name IN ('first_transaction', 'repeat_transaction') GROUP BY 1)
SELECT month, customers, earliest, days, most_users, payments, frauds
FROM acquired FULL JOIN active USING (month) FULL JOIN paid USING (month)
""",
}
