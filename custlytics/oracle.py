"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Built from shared CTE fragments so every query spells out the whole
derivation from the raw test tables."""

from __future__ import annotations

from custlytics.operators.ml import sample_param_grid
from custlytics.schemas import FEATURES

ORACLE: dict[str, str] = {}

TX = """tx AS (
  SELECT o.o_orderkey AS transaction_id, o.o_custkey AS customer_id,
         o.o_orderdate AS transaction_date, o.o_totalprice AS order_value,
         o.o_orderpriority AS channel, o.o_orderstatus AS payment_method,
         l.quantity, l.discount_used_pct
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS quantity,
           ROUND(AVG(l_discount), 6) AS discount_used_pct
    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey)"""

END = "(SELECT MAX(CAST(transaction_date AS DATE)) FROM tx)"

RFM = f"""rfm AS (
  SELECT customer_id,
         CAST({END} - MAX(CAST(transaction_date AS DATE)) AS INTEGER) AS recency,
         COUNT(transaction_id) AS frequency,
         CAST(ROUND(SUM(CAST(order_value AS DECIMAL(28,8))), 2) AS DOUBLE) AS monetary
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

SCORED = """e AS (
  SELECT quantile_cont(recency, [0.25, 0.5, 0.75]) AS q, COUNT(*) AS n FROM rfm),
ranked AS (
  SELECT r.*, e.q, e.n,
         ROW_NUMBER() OVER (ORDER BY frequency ASC, monetary DESC NULLS LAST, customer_id ASC) AS f_rank,
         ROW_NUMBER() OVER (ORDER BY monetary ASC NULLS FIRST, customer_id ASC) AS m_rank
  FROM rfm r CROSS JOIN e),
scored AS (
  SELECT ranked.* EXCLUDE (q, n, f_rank, m_rank),
         CAST(CASE WHEN recency IS NULL THEN NULL WHEN recency <= q[1] THEN 4 WHEN recency <= q[2] THEN 3
                   WHEN recency <= q[3] THEN 2 ELSE 1 END AS INTEGER) AS r_score,
         CAST(1 + CAST(f_rank > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(f_rank > 1 + (n - 1) * 0.5 AS INTEGER)
                + CAST(f_rank > 1 + (n - 1) * 0.75 AS INTEGER) AS INTEGER) AS f_score,
         CAST(1 + CAST(m_rank > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(m_rank > 1 + (n - 1) * 0.5 AS INTEGER)
                + CAST(m_rank > 1 + (n - 1) * 0.75 AS INTEGER) AS INTEGER) AS m_score
  FROM ranked),
segs AS (
  SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score,
         CASE WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'High-Value'
              WHEN r_score >= 3 AND f_score >= 2 THEN 'Repeat'
              WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'At-Risk'
              ELSE 'Low-Engagement' END AS segment
  FROM scored)"""


def mean_sql(total: str, n: str, scale_in: int = 0, decimals: int = 6) -> str:
    """Exact half-up mean of an integer sum (mirrors functions.money.exact_mean)."""
    num = f"CAST({total} AS HUGEINT) * {10 ** (decimals - scale_in)}"
    return (f"CAST(sign({num}) * ((2 * abs({num}) + {n}) // (2 * {n})) AS DOUBLE) / {10 ** decimals}")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE["rfm"] = with_(TX, RFM) + "SELECT * FROM rfm ORDER BY monetary DESC, customer_id"
ORACLE["global_rank"] = with_(TX, RFM) + """SELECT customer_id, frequency, monetary,
  ROW_NUMBER() OVER (ORDER BY frequency ASC, monetary DESC, customer_id ASC) AS rank FROM rfm"""
ORACLE["score_recency"] = with_(TX, RFM, SCORED) + "SELECT customer_id, recency, r_score FROM segs"
ORACLE["score_frequency"] = with_(TX, RFM, SCORED) + \
    "SELECT customer_id, frequency, monetary, f_score FROM segs"
ORACLE["score_monetary"] = with_(TX, RFM, SCORED) + "SELECT customer_id, monetary, m_score FROM segs"
ORACLE["rfm_scored"] = with_(TX, RFM, SCORED) + \
    "SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score, rfm_score FROM segs"
ORACLE["rfm_segments"] = with_(TX, RFM, SCORED) + "SELECT * FROM segs"
ORACLE["segment_summary"] = with_(TX, RFM, SCORED) + f"""SELECT segment, COUNT(customer_id) AS customers,
  {mean_sql("SUM(recency)", "COUNT(customer_id)")} AS avg_recency,
  {mean_sql("SUM(frequency)", "COUNT(customer_id)")} AS avg_frequency,
  {mean_sql("SUM(CAST(ROUND(monetary * 100) AS BIGINT))", "COUNT(customer_id)", 2)} AS avg_monetary
  FROM segs GROUP BY segment ORDER BY customers DESC, segment"""
ORACLE["segment_counts"] = with_(TX, RFM, SCORED) + \
    "SELECT segment, COUNT(*) AS customers FROM segs GROUP BY segment ORDER BY customers DESC, segment"

# ------------------------------------------------------------ quality (B)
TXGEO = """txg AS (
  SELECT tx.*, n.n_name AS customer_state FROM tx
  LEFT JOIN customer c ON tx.customer_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

ORACLE["dq_total_transactions"] = with_(TX) + "SELECT COUNT(*) AS total_transactions FROM tx"
ORACLE["dq_total_customers"] = with_(TX) + \
    "SELECT COUNT(DISTINCT customer_id) AS total_customers FROM tx"
ORACLE["dq_date_range"] = with_(TX) + """SELECT MIN(CAST(transaction_date AS DATE)) AS min_transaction_date,
  MAX(CAST(transaction_date AS DATE)) AS max_transaction_date FROM tx"""
ORACLE["dq_null_counts"] = with_(TX) + """SELECT
  CAST(SUM(CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_transaction_id,
  CAST(SUM(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_customer_id,
  CAST(SUM(CASE WHEN transaction_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_transaction_date,
  CAST(SUM(CASE WHEN order_value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_order_value,
  CAST(SUM(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_quantity
FROM tx"""
ORACLE["dq_duplicate_ids"] = with_(TX) + """SELECT transaction_id, COUNT(*) AS duplicate_count
  FROM tx GROUP BY transaction_id HAVING COUNT(*) > 1"""
ORACLE["dq_duplicate_line_ids"] = """SELECT l_orderkey AS order_id, l_linenumber AS line_number,
  COUNT(*) AS duplicate_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""
ORACLE["dq_nonpositive_value"] = with_(TX) + \
    "SELECT COUNT(*) AS non_positive_order_value_rows FROM tx WHERE order_value <= 0"
ORACLE["dq_nonpositive_event_value"] = """SELECT COUNT(*) AS non_positive_order_value_rows
  FROM events WHERE event_type = 'purchase' AND value <= 0"""
ORACLE["dq_nonpositive_quantity"] = with_(TX) + \
    "SELECT COUNT(*) AS non_positive_quantity_rows FROM tx WHERE quantity <= 0"
ORACLE["dq_one_time_customers"] = with_(TX) + """SELECT COUNT(*) AS one_time_customers FROM (
  SELECT customer_id FROM tx GROUP BY customer_id HAVING COUNT(transaction_id) = 1) t"""
ORACLE["dq_repeat_customers"] = with_(TX) + """SELECT COUNT(*) AS repeat_customers FROM (
  SELECT customer_id FROM tx GROUP BY customer_id HAVING COUNT(transaction_id) > 1) t"""
ORACLE["dist_channel"] = with_(TX) + """SELECT channel, COUNT(*) AS transactions FROM tx
  GROUP BY channel ORDER BY transactions DESC, channel"""
ORACLE["dist_category"] = """SELECT p.p_type AS product_category, COUNT(*) AS transactions
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY p.p_type ORDER BY transactions DESC, product_category"""
ORACLE["dist_state"] = with_(TX, TXGEO) + """SELECT customer_state, COUNT(DISTINCT customer_id) AS customers
  FROM txg GROUP BY customer_state ORDER BY customers DESC, customer_state"""
ORACLE["dist_state_generic"] = ORACLE["dist_state"]


def _suite_sql() -> str:
    body = with_(TX) + """,
s AS (SELECT COUNT(*) AS total_transactions,
        CAST(MIN(CAST(transaction_date AS DATE)) AS VARCHAR) AS min_transaction_date,
        CAST(MAX(CAST(transaction_date AS DATE)) AS VARCHAR) AS max_transaction_date,
        CAST(SUM(CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_transaction_id,
        CAST(SUM(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_customer_id,
        CAST(SUM(CASE WHEN transaction_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_transaction_date,
        CAST(SUM(CASE WHEN order_value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_order_value,
        CAST(SUM(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_quantity,
        COUNT(*) FILTER (WHERE order_value <= 0) AS non_positive_order_value_rows,
        COUNT(*) FILTER (WHERE quantity <= 0) AS non_positive_quantity_rows FROM tx),
pc AS (SELECT COUNT(customer_id) AS total_customers,
         COUNT(*) FILTER (WHERE n = 1) AS one_time_customers,
         COUNT(*) FILTER (WHERE n > 1) AS repeat_customers
       FROM (SELECT customer_id, COUNT(transaction_id) AS n FROM tx GROUP BY customer_id) g),
d AS (SELECT COUNT(*) AS duplicate_ids FROM (
        SELECT transaction_id FROM tx GROUP BY transaction_id HAVING COUNT(*) > 1) g),
one AS (SELECT * FROM s, pc, d)
"""
    checks = [
        (1, "total_transactions", "total_transactions", "INFO"),
        (2, "total_customers", "total_customers", "INFO"),
        (3, "date_range", "min_transaction_date", "INFO"),
        (3, "date_range", "max_transaction_date", "INFO"),
        (4, "null_check", "null_transaction_id", "ZERO"),
        (4, "null_check", "null_customer_id", "ZERO"),
        (4, "null_check", "null_transaction_date", "ZERO"),
        (4, "null_check", "null_order_value", "ZERO"),
        (4, "null_check", "null_quantity", "ZERO"),
        (5, "duplicate_transaction_id", "duplicate_ids", "ZERO"),
        (6, "non_positive_order_value", "non_positive_order_value_rows", "ZERO"),
        (7, "non_positive_quantity", "non_positive_quantity_rows", "ZERO"),
        (8, "one_time_customers", "one_time_customers", "INFO"),
        (9, "repeat_customers", "repeat_customers", "INFO"),
    ]
    parts = []
    for no, check, metric, rule in checks:
        status = (f"CASE WHEN {metric} IS NULL THEN 'NO DATA' WHEN CAST({metric} AS BIGINT) = 0 THEN 'PASS' ELSE 'FAIL' END"
                  if rule == "ZERO" else "'INFO'")
        parts.append(f"SELECT CAST({no} AS INTEGER) AS check_no, '{check}' AS check_name, "
                     f"'{metric}' AS metric, CAST({metric} AS VARCHAR) AS value, {status} AS status FROM one")
    return body + "\nUNION ALL\n".join(parts)


ORACLE["dq_suite"] = _suite_sql()

# ------------------------------------------------------------- cohort (D)
# a customer's first month by a window; months are counted as whole months
# between the first days of two months
COHORT = """act AS (
  SELECT customer_id, transaction_id, CAST(transaction_date AS DATE) AS day,
         date_trunc('month', transaction_date)::DATE AS month,
         MIN(CAST(transaction_date AS DATE)) OVER (PARTITION BY customer_id) AS first_day
  FROM tx WHERE customer_id IS NOT NULL),
assigned AS (
  SELECT customer_id, transaction_id, day AS transaction_date, strftime(month, '%Y-%m') AS order_month,
         strftime(first_day, '%Y-%m') AS cohort_month,
         CAST(date_diff('month', date_trunc('month', first_day)::DATE, month) + 1 AS INTEGER) AS cohort_index
  FROM act),
cells AS (
  SELECT cohort_month, cohort_index, COUNT(*) AS customers
  FROM (SELECT DISTINCT customer_id, cohort_month, cohort_index FROM assigned) GROUP BY ALL),
ret AS (
  SELECT *, CAST((2 * customers * 10000 + cohort_size) // (2 * cohort_size) AS DOUBLE) / 10000 AS retention_rate
  FROM (SELECT *, MAX(customers) FILTER (cohort_index = 1) OVER (PARTITION BY cohort_month) AS cohort_size FROM cells))"""

ORACLE["first_purchase"] = with_(TX, COHORT) + "SELECT customer_id, MIN(day) AS first_purchase_date, ANY_VALUE(strftime(first_day, '%Y-%m')) AS cohort_month FROM act GROUP BY customer_id"
ORACLE["cohort_assign"] = with_(TX, COHORT) + "SELECT * FROM assigned"
ORACLE["cohort_counts"] = with_(TX, COHORT) + "SELECT * FROM cells"
ORACLE["cohort_size"] = with_(TX, COHORT) + "SELECT cohort_month, customers AS cohort_size FROM cells WHERE cohort_index = 1"
ORACLE["cohort_retention"] = with_(TX, COHORT) + "SELECT cohort_month, cohort_index, customers, cohort_size, retention_rate FROM ret ORDER BY cohort_month, cohort_index"
ORACLE["cohort_12m"] = with_(TX, COHORT) + \
    "SELECT cohort_month, cohort_index, customers, cohort_size, retention_rate FROM ret WHERE cohort_index <= 12 ORDER BY cohort_month, cohort_index"
ORACLE["cohort_options"] = with_(TX, COHORT) + \
    "SELECT DISTINCT cohort_month FROM ret WHERE cohort_index <= 12 ORDER BY cohort_month"
ORACLE["cohort_latest"] = with_(TX, COHORT) + """SELECT cohort_month, cohort_index, customers, cohort_size,
  retention_rate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort_month ORDER BY cohort_index DESC) AS rn
  FROM ret WHERE cohort_index <= 12) t WHERE rn = 1 ORDER BY retention_rate DESC, cohort_month"""
ORACLE["cohort_matrix"] = with_(TX, COHORT) + "SELECT cohort_month, " + ", ".join(
    f"MAX(CASE WHEN cohort_index = {i} THEN retention_rate END) AS month_{i}" for i in range(1, 13)) + \
    " FROM ret WHERE cohort_index <= 12 GROUP BY cohort_month ORDER BY cohort_month"

# ------------------------------------------------------ churn and CLV (E)
def hud(num: str, den: str) -> str:
    """Integer num/den rounded half away from zero (den > 0), as in
    functions.money.half_up_div."""
    return f"(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))))"


def churn_cte(days: int = 90) -> str:
    """One grouped pass; the trailing window is a filtered aggregate.  Figures
    are the rounded sums, and ratios of the sums in units of 10^-8."""
    last = "MAX(day) OVER ()"
    return f"""dated AS (SELECT *, CAST(transaction_date AS DATE) AS day FROM tx),
lines AS (SELECT *, {last} AS end_day, day >= {last} - {days} AS recent FROM dated),
sums AS (
  SELECT customer_id, ANY_VALUE(end_day) AS end_day, MIN(day) AS lo, MAX(day) AS hi, COUNT(transaction_id) AS n,
         SUM(CAST(order_value AS DECIMAL(28,8))) AS spend, CAST(SUM(CAST(order_value AS DECIMAL(28,8))) * 100000000 AS HUGEINT) AS su,
         COUNT(order_value) AS nv, CAST(SUM(quantity) AS BIGINT) AS qty,
         CAST(SUM(CAST(discount_used_pct AS DECIMAL(28,8))) * 100000000 AS HUGEINT) AS sd,
         COUNT(discount_used_pct) AS nd, COUNT(DISTINCT date_trunc('month', day)) AS months,
         COUNT(transaction_id) FILTER (recent) AS rn, COUNT(*) FILTER (recent) AS rrows,
         SUM(CAST(order_value AS DECIMAL(28,8))) FILTER (recent) AS ru
  FROM lines WHERE customer_id IS NOT NULL GROUP BY customer_id),
cents AS (SELECT *, {hud("su", "nv * 1000000")} AS aov_c FROM sums),
churn AS (
  SELECT customer_id, lo AS first_purchase_date, hi AS last_purchase_date, n AS total_transactions,
    CAST(ROUND(spend, 2) AS DOUBLE) AS total_spend, CAST(aov_c AS DOUBLE) / 100 AS avg_order_value,
    qty AS quantity_total, CASE WHEN nd > 0 THEN CAST({hud("sd", "nd * 10000")} AS DOUBLE) / 10000 END AS discount_usage_rate,
    months AS active_months, CAST(hi - lo AS INTEGER) AS customer_lifespan_days,
    CAST(end_day - hi AS INTEGER) AS days_since_last_purchase,
    CAST(COALESCE(end_day - hi > {days}, false) AS INTEGER) AS churn_label,
    CAST({hud("n * aov_c * months", "12")} AS DOUBLE) / 100 AS clv_proxy,
    rn AS transactions_last_90_days, CAST(COALESCE(ROUND(ru, 2), 0) AS DOUBLE) AS spend_last_90_days
  FROM cents)"""


CHURN = churn_cte(90)

ORACLE["customer_churn"] = with_(TX, CHURN) + "SELECT * FROM churn ORDER BY customer_id"
ORACLE["customer_base"] = with_(TX, CHURN) + """SELECT customer_id, first_purchase_date, last_purchase_date,
  total_transactions, total_spend, avg_order_value, quantity_total, discount_usage_rate, active_months FROM churn"""
ORACLE["recent_activity"] = with_(TX, CHURN) + """SELECT c.customer_id, transactions_last_90_days,
  spend_last_90_days FROM churn c JOIN sums s ON c.customer_id = s.customer_id WHERE s.rrows > 0"""
ORACLE["churn_label"] = with_(TX, CHURN) + \
    "SELECT customer_id, days_since_last_purchase, churn_label FROM churn"
ORACLE["clv_proxy"] = with_(TX, CHURN) + """SELECT customer_id, total_transactions, avg_order_value,
  active_months, clv_proxy FROM churn"""
ORACLE["churn_distribution"] = with_(TX, CHURN) + """SELECT churn_label, COUNT(*) AS customers FROM churn
  GROUP BY churn_label ORDER BY customers DESC, churn_label"""

FEATS = """rfm AS (SELECT *, days_since_last_purchase AS recency, total_transactions AS frequency,
  total_spend AS monetary FROM churn)"""
ORACLE["model_base"] = with_(TX, CHURN, FEATS, SCORED) + "SELECT * FROM segs"

# ---------------------------------------------------- analyst views (G)
PRED = """pred AS (
  SELECT customer_id, segment, churn_label,
    CAST(days_since_last_purchase AS DOUBLE) / MAX(days_since_last_purchase) OVER () AS churn_probability,
    clv_proxy, frequency, monetary, f_score, m_score, total_transactions, total_spend, avg_order_value,
    active_months, quantity_total, discount_usage_rate, customer_lifespan_days
  FROM segs),
predb AS (
  SELECT *, CAST(churn_probability > 0.5 AS INTEGER) AS prediction,
    CASE WHEN churn_probability >= 0.0 AND churn_probability <= 0.3 THEN 'Low Risk'
         WHEN churn_probability > 0.3 AND churn_probability <= 0.7 THEN 'Medium Risk'
         WHEN churn_probability > 0.7 AND churn_probability <= 1.0 THEN 'High Risk' END AS risk_band
  FROM pred)"""
VBASE = (TX, CHURN, FEATS, SCORED, PRED)
PRED_COLS = ("customer_id, segment, churn_label, churn_probability, clv_proxy, frequency, monetary, "
             "f_score, m_score, total_transactions, total_spend, avg_order_value, active_months, "
             "quantity_total, discount_usage_rate, customer_lifespan_days, prediction")
VFILTER = ("segment IN ('High-Value', 'At-Risk') AND churn_probability BETWEEN 0.05 AND 0.95 "
           "AND clv_proxy >= 100000.0 AND clv_proxy <= 3000000.0")
TOPC = "customer_id, segment, churn_probability, clv_proxy, frequency, monetary"


def means_sql(decimals: int = 6) -> str:
    n = "COUNT(*)"
    return (f"ROUND(AVG(churn_probability), {decimals}) AS avg_churn_probability, "
            f"{mean_sql('SUM(CAST(ROUND(clv_proxy * 100) AS BIGINT))', n, 2)} AS avg_clv_proxy, "
            f"{mean_sql('SUM(frequency)', n)} AS avg_frequency, "
            f"{mean_sql('SUM(CAST(ROUND(monetary * 100) AS BIGINT))', n, 2)} AS avg_monetary")


def kpi_sql(where: str = "TRUE") -> str:
    return with_(*VBASE) + f"""SELECT COUNT(DISTINCT customer_id) AS customers,
  ROUND(AVG(churn_probability), 6) AS avg_churn_probability,
  {mean_sql('SUM(CAST(ROUND(clv_proxy * 100) AS BIGINT))', 'COUNT(*)', 2)} AS avg_clv_proxy,
  COUNT(DISTINCT CASE WHEN churn_probability >= 0.7 THEN customer_id END) AS high_risk_customers,
  {mean_sql('SUM(frequency)', 'COUNT(*)')} AS avg_frequency,
  {mean_sql('SUM(CAST(ROUND(monetary * 100) AS BIGINT))', 'COUNT(*)', 2)} AS avg_monetary
  FROM predb WHERE {where}"""


def risk_summary_sql(where: str = "TRUE") -> str:
    return with_(*VBASE) + f"""SELECT b.risk_band, COALESCE(a.customers, 0) AS customers,
  a.avg_churn_probability, a.avg_clv_proxy FROM
  (VALUES (0, 'Low Risk'), (1, 'Medium Risk'), (2, 'High Risk')) AS b(band_order, risk_band)
  LEFT JOIN (SELECT risk_band, COUNT(customer_id) AS customers,
               ROUND(AVG(churn_probability), 6) AS avg_churn_probability,
               {mean_sql('SUM(CAST(ROUND(clv_proxy * 100) AS BIGINT))', 'COUNT(*)', 2)} AS avg_clv_proxy
             FROM predb WHERE risk_band IS NOT NULL AND {where} GROUP BY risk_band) a
  ON a.risk_band = b.risk_band ORDER BY b.band_order"""


def box_sql(col: str) -> str:
    return with_(*VBASE) + f""", q AS (
  SELECT segment, ROUND(quantile_cont({col}, 0.25), 6) AS q1, ROUND(quantile_cont({col}, 0.5), 6) AS median,
         ROUND(quantile_cont({col}, 0.75), 6) AS q3
  FROM predb WHERE {col} IS NOT NULL GROUP BY segment),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT p.segment, COUNT(*) AS n, MIN({col}) AS min, f.q1, f.median, f.q3, MAX({col}) AS max,
  MIN(CASE WHEN {col} >= lo_f AND {col} <= hi_f THEN {col} END) AS lower_whisker,
  MAX(CASE WHEN {col} >= lo_f AND {col} <= hi_f THEN {col} END) AS upper_whisker,
  COUNT(*) FILTER (WHERE NOT ({col} >= lo_f AND {col} <= hi_f)) AS outliers
FROM predb p JOIN f ON p.segment = f.segment WHERE {col} IS NOT NULL
GROUP BY p.segment, f.q1, f.median, f.q3 ORDER BY p.segment"""


ORACLE["segment_options"] = with_(*VBASE) + \
    "SELECT DISTINCT segment FROM pred WHERE segment IS NOT NULL ORDER BY segment"
ORACLE["clv_bounds"] = with_(*VBASE) + """SELECT MIN(clv_proxy) AS clv_min, MAX(clv_proxy) AS clv_max,
  ROUND(MIN(clv_proxy), 0) AS slider_min, ROUND(MAX(clv_proxy), 0) AS slider_max FROM pred"""
ORACLE["filtered_customers"] = with_(*VBASE) + f"SELECT {PRED_COLS} FROM predb WHERE {VFILTER}"
ORACLE["risk_band"] = with_(*VBASE) + "SELECT customer_id, churn_probability, risk_band FROM predb"
ORACLE["kpi_row"] = kpi_sql()
ORACLE["kpi_row_filtered"] = kpi_sql(VFILTER)
ORACLE["segment_performance"] = with_(*VBASE) + f"""SELECT segment, COUNT(customer_id) AS customers,
  {means_sql()} FROM predb GROUP BY segment ORDER BY customers DESC, segment"""
ORACLE["segment_metric"] = with_(*VBASE) + f"""SELECT segment,
  {mean_sql('SUM(CAST(ROUND(clv_proxy * 100) AS BIGINT))', 'COUNT(*)', 2)} AS avg_clv_proxy
  FROM predb GROUP BY segment"""
ORACLE["risk_summary"] = risk_summary_sql()
ORACLE["risk_summary_filtered"] = risk_summary_sql("churn_probability BETWEEN 0.5 AND 1.0")
ORACLE["prob_histogram"] = with_(*VBASE) + """SELECT risk_band, bin,
  CAST(bin AS DOUBLE) * 1.0 / 30 AS bin_lo, CAST(bin + 1 AS DOUBLE) * 1.0 / 30 AS bin_hi, COUNT(*) AS customers
  FROM (SELECT risk_band, CAST(LEAST(FLOOR((churn_probability - 0.0) * 30 / 1.0), 29) AS INTEGER) AS bin
        FROM predb WHERE churn_probability BETWEEN 0.0 AND 1.0) t GROUP BY risk_band, bin"""
ORACLE["box_churn_probability"] = box_sql("churn_probability")
ORACLE["box_clv"] = box_sql("clv_proxy")
ORACLE["top_risk"] = with_(*VBASE) + \
    f"SELECT {TOPC} FROM predb ORDER BY churn_probability DESC, customer_id LIMIT 25"
ORACLE["top_clv"] = with_(*VBASE) + f"SELECT {TOPC} FROM predb ORDER BY clv_proxy DESC, customer_id LIMIT 25"
ORACLE["bottom_clv"] = with_(*VBASE) + f"SELECT {TOPC} FROM predb ORDER BY clv_proxy ASC, customer_id LIMIT 25"
ORACLE["customer_table"] = with_(*VBASE) + \
    f"SELECT {PRED_COLS} FROM predb WHERE {VFILTER} ORDER BY monetary ASC, customer_id LIMIT 50"
ORACLE["clv_vs_risk"] = with_(*VBASE) + "SELECT customer_id, segment, clv_proxy, churn_probability FROM predb"

# ------------------------------------------------------- churn model (F)
FEATURE_SQL = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in FEATURES)
HASH48 = "CAST(('0x' || substr(md5('{}' || CAST(customer_id AS VARCHAR)), 1, 12)) AS BIGINT)"
SPLIT = """mf AS (SELECT customer_id, churn_label FROM churn),
cnt AS (SELECT churn_label, COUNT(*) AS n FROM mf GROUP BY churn_label),
alloc AS (
  SELECT churn_label, n, CAST(FLOOR(0.2::DOUBLE * n) AS BIGINT)
    + CASE WHEN ROW_NUMBER() OVER (ORDER BY 0.2::DOUBLE * n - FLOOR(0.2::DOUBLE * n) DESC, churn_label)
           <= (SELECT CEIL(0.2::DOUBLE * SUM(n)) - SUM(FLOOR(0.2::DOUBLE * n)) FROM cnt) THEN 1 ELSE 0 END AS n_test
  FROM cnt),
rk AS (SELECT mf.*, ROW_NUMBER() OVER (PARTITION BY churn_label
         ORDER BY """ + HASH48.format("42:") + """, customer_id) AS w FROM mf),
split AS (
  SELECT rk.customer_id, rk.churn_label, CASE WHEN w <= a.n_test THEN 'test' ELSE 'train' END AS split,
         CASE WHEN w > a.n_test THEN CAST(""" + HASH48.format("42:fold:") + """ % 3 AS INTEGER) END AS fold
  FROM rk JOIN alloc a ON rk.churn_label = a.churn_label)"""
MBASE = (TX, CHURN, FEATS, SCORED, SPLIT)
EVAL = """ev AS (
  SELECT s.customer_id, s.churn_label,
         1.0 - CAST(g.customer_lifespan_days AS DOUBLE) / MAX(g.customer_lifespan_days) OVER () AS churn_probability
  FROM segs g JOIN split s ON g.customer_id = s.customer_id),
evt AS (SELECT e.*, CAST(churn_probability > 0.5 AS INTEGER) AS prediction
        FROM ev e JOIN split s ON e.customer_id = s.customer_id WHERE s.split = 'test'),
cm AS (
  SELECT l.churn_label, p.prediction, COALESCE(c.cnt, 0) AS count
  FROM (VALUES (0), (1)) l(churn_label) CROSS JOIN (VALUES (0), (1)) p(prediction)
  LEFT JOIN (SELECT churn_label, prediction, COUNT(*) AS cnt FROM evt GROUP BY 1, 2) c
    ON c.churn_label = l.churn_label AND c.prediction = p.prediction)"""

ORACLE["model_features"] = with_(TX, CHURN, FEATS, SCORED) + \
    f"SELECT customer_id, {FEATURE_SQL}, CAST(churn_label AS INTEGER) AS churn_label FROM segs"
ORACLE["stratified_split"] = with_(*MBASE) + "SELECT * FROM split"
ORACLE["stratified_split_sizes"] = with_(*MBASE) + \
    "SELECT churn_label, split, COUNT(*) AS rows FROM split GROUP BY churn_label, split"
ORACLE["class_weight"] = with_(*MBASE) + """SELECT COUNT(*) FILTER (WHERE churn_label = 0) AS negatives,
  COUNT(*) FILTER (WHERE churn_label = 1) AS positives,
  CAST(COUNT(*) FILTER (WHERE churn_label = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE churn_label = 1), 0)
    AS scale_pos_weight FROM split WHERE split = 'train'"""
ORACLE["confusion_matrix"] = with_(*MBASE, EVAL) + "SELECT * FROM cm ORDER BY churn_label, prediction"


def _report_sql() -> str:
    agg = """per AS (SELECT
  SUM(CASE WHEN churn_label = 0 AND prediction = 0 THEN count ELSE 0 END) AS tp0,
  SUM(CASE WHEN churn_label = 1 AND prediction = 1 THEN count ELSE 0 END) AS tp1,
  SUM(CASE WHEN prediction = 0 THEN count ELSE 0 END) AS pp0,
  SUM(CASE WHEN prediction = 1 THEN count ELSE 0 END) AS pp1,
  SUM(CASE WHEN churn_label = 0 THEN count ELSE 0 END) AS s0,
  SUM(CASE WHEN churn_label = 1 THEN count ELSE 0 END) AS s1,
  SUM(count) AS total FROM cm),
pr AS (SELECT *, CAST(tp0 AS DOUBLE) / NULLIF(pp0, 0) AS p0, CAST(tp0 AS DOUBLE) / NULLIF(s0, 0) AS r0,
              CAST(tp1 AS DOUBLE) / NULLIF(pp1, 0) AS p1, CAST(tp1 AS DOUBLE) / NULLIF(s1, 0) AS r1 FROM per),
f AS (SELECT *, 2 * p0 * r0 / NULLIF(p0 + r0, 0) AS f0, 2 * p1 * r1 / NULLIF(p1 + r1, 0) AS f1 FROM pr)"""
    sel = """
SELECT '0' AS class, ROUND(p0, 6) AS precision, ROUND(r0, 6) AS recall, ROUND(f0, 6) AS f1_score,
       CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', ROUND(p1, 6), ROUND(r1, 6), ROUND(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(CAST(tp0 + tp1 AS DOUBLE) / NULLIF(total, 0), 6),
       CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', ROUND((0.0 + p0 + p1) / 2, 6), ROUND((0.0 + r0 + r1) / 2, 6),
       ROUND((0.0 + f0 + f1) / 2, 6), CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', ROUND((0.0 + p0 * s0 + p1 * s1) / NULLIF(total, 0), 6),
       ROUND((0.0 + r0 * s0 + r1 * s1) / NULLIF(total, 0), 6),
       ROUND((0.0 + f0 * s0 + f1 * s1) / NULLIF(total, 0), 6), CAST(total AS BIGINT) FROM f"""
    return with_(*MBASE, EVAL, agg) + sel


ORACLE["classification_report"] = _report_sql()
ORACLE["roc_auc"] = with_(*MBASE, EVAL) + """, ps AS (
  SELECT churn_probability AS s, COUNT(*) FILTER (WHERE churn_label = 1) AS pos,
         COUNT(*) FILTER (WHERE churn_label = 0) AS neg FROM evt GROUP BY churn_probability),
run AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS below FROM ps),
t AS (SELECT CAST(SUM(pos * (2 * below + neg)) AS HUGEINT) AS num2, SUM(pos) AS positives,
        SUM(neg) AS negatives FROM run)
SELECT CASE WHEN positives * negatives > 0 THEN
         CAST((2 * num2 * 10000 + 2 * positives * negatives) // (4 * positives * negatives) AS DOUBLE) / 10000
       END AS roc_auc,
       CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives FROM t"""

# ------------------------------------------------------- sources (A)
ORACLE["tx_scan"] = with_(TX) + "SELECT * FROM tx"
ORACLE["tx_profile"] = with_(TX) + "SELECT COUNT(*) AS rows, 8 AS columns FROM tx"

# ------------------------------------------- purchase events (time of day)
EVENTS = """tx AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, ts AS transaction_date,
         value AS order_value, CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS DOUBLE) AS discount_used_pct
  FROM events WHERE event_type = 'purchase')"""
ORACLE["rfm_events"] = with_(EVENTS, RFM) + "SELECT * FROM rfm ORDER BY monetary DESC, customer_id"
ORACLE["event_churn"] = with_(EVENTS, churn_cte(1)) + "SELECT * FROM churn ORDER BY customer_id"
ORACLE["dq_suite_events"] = _suite_sql().replace(with_(TX), with_(EVENTS), 1)
ORACLE["model_base_join"] = ORACLE["model_base"]
ORACLE["rfm_fixed_as_of"] = with_(TX, RFM.replace(END, "DATE '2002-01-01'")) + \
    "SELECT * FROM rfm ORDER BY monetary DESC, customer_id"

ORACLE["customer_churn_unrounded"] = with_(TX, CHURN) + f"""SELECT c.customer_id, c.first_purchase_date,
  c.last_purchase_date, c.total_transactions, CAST(s.su AS DOUBLE) / 100000000 AS total_spend,
  CAST(s.su AS DOUBLE) / CAST(s.nv * 100000000 AS DOUBLE) AS avg_order_value, c.quantity_total,
  CAST(s.sd AS DOUBLE) / CAST(s.nd * 100000000 AS DOUBLE) AS discount_usage_rate, c.active_months,
  c.customer_lifespan_days, c.days_since_last_purchase, c.churn_label,
  CAST({hud("s.su * s.n * s.months", "s.nv * 12000000")} AS DOUBLE) / 100 AS clv_proxy,
  c.transactions_last_90_days, c.spend_last_90_days
FROM churn c JOIN sums s ON c.customer_id = s.customer_id"""
ORACLE["dq_duplicate_preview"] = """SELECT l_orderkey AS order_id, l_linenumber AS line_number,
  COUNT(*) AS duplicate_count, COUNT(*) OVER () AS duplicate_ids
  FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
  ORDER BY duplicate_count DESC, order_id, line_number LIMIT 10"""

# --------------------------------------- round trips of sources and sinks (A)
ORACLE["csv_roundtrip"] = with_(TX) + """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
  CAST(customer_id AS VARCHAR) AS customer_id, transaction_date, order_value, quantity, channel, discount_used_pct FROM tx"""
ORACLE["table_roundtrip"] = with_(TX) + "SELECT *, strftime(transaction_date, '%Y-%m') AS order_month FROM tx"
ORACLE["result_roundtrip"] = with_(TX, RFM) + "SELECT * FROM rfm"
def _cells(columns: str, table: str) -> str:
    """Rows of a report as text, decimals for the columns marked with ``~``."""
    parts = ", ".join(f"COALESCE(CAST({f'CAST({c[1:]} AS DECIMAL(30,6))' if c.startswith('~') else c} AS VARCHAR), '-')" for c in columns.split())
    return f"SELECT '{{}}' AS report, concat_ws('|', {parts}) AS row FROM {table}"


ORACLE["report_batch"] = with_(TX, RFM, CHURN, COHORT) + "\nUNION ALL ".join([
    _cells("customer_id recency frequency ~monetary", "rfm").format("rfm_output"),
    _cells("cohort_month cohort_index customers cohort_size ~retention_rate", "ret").format("cohort_output"),
    _cells("customer_id first_purchase_date last_purchase_date total_transactions ~total_spend ~avg_order_value quantity_total "
           "~discount_usage_rate active_months customer_lifespan_days days_since_last_purchase churn_label ~clv_proxy "
           "transactions_last_90_days ~spend_last_90_days", "churn").format("churn_output")])
ORACLE["replaced_table"] = with_(TX) + """SELECT COUNT(*) AS rows, COUNT(*) AS written, COUNT(*) FILTER (quantity IS NULL) AS null_quantity,
  COUNT(*) FILTER (customer_id IS NULL) AS null_customer, COUNT(*) FILTER (order_value <= 0) AS low_value,
  CAST(CAST(MIN(transaction_date) AS DATE) AS VARCHAR) AS first, CAST(CAST(MAX(transaction_date) AS DATE) AS VARCHAR) AS last FROM tx"""
ORACLE["bucketed_rfm"] = with_(TX, RFM) + "SELECT * FROM rfm"
ORACLE["customers_by_range"] = with_(TX) + """SELECT r.i AS range, COUNT(DISTINCT customer_id) AS exact, COUNT(*) AS rows, true AS within_error
  FROM (VALUES (0, '0000-00', '9999-99'), (1, '1996-01', '1996-12'), (2, '1995-03', '1998-02'), (3, '2001-08', '2001-08')) AS r(i, lo, hi)
  JOIN tx ON strftime(transaction_date, '%Y-%m') BETWEEN r.lo AND r.hi GROUP BY r.i"""
ORACLE["view_export_roundtrip"] = ORACLE["filtered_customers"]

# --------------------------------------------- invariants of the churn model
_TEST = "FROM split WHERE split = 'test'"
_OK = "0::BIGINT AS bad_probability, 0::BIGINT AS bad_prediction"
ORACLE["churn_model_scores_check"] = with_(TX, CHURN, SPLIT) + f"""SELECT COUNT(*) AS rows, COUNT(*) AS customers,
  COUNT(*) FILTER (churn_label = 1) AS churned, {_OK} {_TEST}"""
ORACLE["churn_model_report_check"] = with_(TX, CHURN, SPLIT) + f"""SELECT class, support, true AS f1_in_range FROM (
  SELECT CAST(churn_label AS VARCHAR) AS class, COUNT(*) AS support {_TEST} GROUP BY churn_label
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT COUNT(*) {_TEST}))"""
ORACLE["churn_model_auc_check"] = with_(TX, CHURN, SPLIT) + f"""SELECT COUNT(*) FILTER (churn_label = 1) AS positives,
  COUNT(*) FILTER (churn_label = 0) AS negatives, true AS auc_in_range {_TEST}"""
ORACLE["churn_predictions_check"] = with_(TX, CHURN) + f"""SELECT COUNT(*) AS rows, COUNT(*) AS customers,
  CAST(SUM(total_transactions) AS BIGINT) AS transactions, {_OK} FROM churn"""
ORACLE["tree_attributions_check"] = with_(TX, CHURN) + \
    "SELECT COUNT(*) AS customers, 0::BIGINT AS bad_sum, 0::BIGINT AS bad_features FROM churn"
ORACLE["attribution_summary_check"] = "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + \
    "]) AS feature, true AS ordered, true AS same_mean"
ORACLE["churn_model_search_check"] = with_(TX, CHURN, SPLIT) + "SELECT candidate, params, (SELECT COUNT(*) FROM split WHERE split = 'train') AS rows, true AS same_auc FROM (VALUES " + \
    ", ".join(f"({i}, '{', '.join(f'{k}={v}' for k, v in sorted(p.items()))}')" for i, p in enumerate(sample_param_grid())) + ") AS c(candidate, params)"
ORACLE["boosted_model_roundtrip"] = with_(TX, CHURN) + \
    "SELECT COUNT(*) AS customers, 0::BIGINT AS other_score, 0::BIGINT AS bad_sum, 0::BIGINT AS bad_probability FROM churn"
ORACLE["churn_model_roundtrip"] = with_(TX, CHURN) + "SELECT COUNT(*) AS customers, 0::BIGINT AS other_score FROM churn"
