"""Independent SQL for the catalogue, written for DuckDB over the same Parquet tables.

Nothing here is generated from the Spark plans: the panel is built by a grid of
users and days, ranks by plain windows, quantiles by ``quantile_cont``.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def r(expression: str, name: str | None = None) -> str:
    """Six decimals; adding zero turns a negative zero into a plain one."""
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


# --- shared tables -------------------------------------------------------------------------

SHARED = """
WITH ev AS MATERIALIZED (
  SELECT user_id AS customer_id, CAST(ts AS DATE) AS day,
         count(*) AS active_users,
         CAST(round(sum(CAST(value AS DECIMAL(18,4)))) AS BIGINT) AS api_calls,
         count(*) FILTER (WHERE event_type IN ('view', 'click')) AS logins,
         count(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS features,
         count(*) FILTER (WHERE event_type = 'error') AS tickets,
         max(ts) AS last_ts
  FROM events GROUP BY 1, 2),
grid AS (
  SELECT u.customer_id, d.day, ev.active_users, ev.api_calls, ev.logins, ev.features, ev.tickets,
         max(ev.last_ts) OVER (PARTITION BY u.customer_id ORDER BY d.day) AS seen,
         lead(d.day) OVER (PARTITION BY u.customer_id ORDER BY d.day) AS next_day,
         lead(ev.active_users) OVER (PARTITION BY u.customer_id ORDER BY d.day) AS next_users
  FROM (SELECT DISTINCT customer_id FROM ev) u CROSS JOIN (SELECT DISTINCT day FROM ev) d
  LEFT JOIN ev ON ev.customer_id = u.customer_id AND ev.day = d.day),
base AS (
  SELECT customer_id, strftime(day, '%Y-%m-%d') AS period,
         coalesce(active_users, 0) AS active_users, coalesce(api_calls, 0) AS api_calls,
         CAST(coalesce(logins, 0) AS DOUBLE) AS logins_per_day,
         CAST(CASE WHEN seen IS NULL THEN 365
              ELSE (epoch_us(CAST(day + INTERVAL 1 DAY AS TIMESTAMP)) - epoch_us(seen)) // 3600000000
              END AS INTEGER) AS days_since_last_login,
         CAST(coalesce(features, 0) AS INTEGER) AS features_used_count,
         CAST(coalesce(tickets, 0) AS INTEGER) AS support_tickets,
         CAST(CASE WHEN next_day IS NOT NULL AND next_users IS NULL THEN 1 ELSE 0 END AS INTEGER)
           AS churned
  FROM grid),
panel AS MATERIALIZED (
  SELECT customer_id, period, active_users, api_calls, logins_per_day, days_since_last_login,
         features_used_count, support_tickets,
         greatest(0.0, least(100.0, round_even(
           CAST(active_users AS DOUBLE) / max(active_users) OVER (PARTITION BY period) * 25
           + logins_per_day / CAST(5 AS DOUBLE) * 25
           + features_used_count / CAST(10 AS DOUBLE) * 25
           + (60 - days_since_last_login) / CAST(60 AS DOUBLE) * 25, 1))) AS engagement_score,
         churned
  FROM base),
cust AS MATERIALIZED (
  SELECT *, CAST(CASE subscription_tier WHEN 'Starter' THEN 500 WHEN 'Professional' THEN 2500
                 ELSE 10000 END AS DOUBLE) AS monthly_revenue,
         CAST(CASE subscription_tier WHEN 'Starter' THEN 6 + customer_id % 7
              WHEN 'Professional' THEN 12 + customer_id % 13
              ELSE 24 + customer_id % 13 END AS INTEGER) AS contract_length_months
  FROM (
    SELECT c_custkey AS customer_id, c_name AS company_name,
           CASE WHEN c_custkey % 20 < 10 THEN 'small' WHEN c_custkey % 20 < 17 THEN 'medium'
                ELSE 'large' END AS company_size,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SaaS' WHEN 'BUILDING' THEN 'Finance'
                WHEN 'FURNITURE' THEN 'Healthcare' WHEN 'HOUSEHOLD' THEN 'Retail'
                WHEN 'MACHINERY' THEN 'Other' END AS industry,
           CASE WHEN c_acctbal < 4500 THEN 'Starter' WHEN c_acctbal < 8500 THEN 'Professional'
                ELSE 'Enterprise' END AS subscription_tier,
           CAST(DATE '2023-01-01' + CAST(c_custkey * 37 % 730 AS INTEGER) AS DATE) AS onboarding_date
    FROM customer)),
enriched AS (
  SELECT p.*, c.company_size, c.subscription_tier, c.industry, c.monthly_revenue
  FROM panel p JOIN cust c USING (customer_id)),
numbered AS (
  SELECT customer_id, period, logins_per_day,
         row_number() OVER (PARTITION BY customer_id ORDER BY period) AS rn,
         count(*) OVER (PARTITION BY customer_id) AS n
  FROM panel),
trend AS (
  SELECT customer_id,
         CASE WHEN base > 0 THEN (recent - base) / base ELSE 0.0 END AS logins_trend_3m
  FROM (SELECT customer_id,
               avg(logins_per_day) FILTER (WHERE rn > n - 3) AS recent,
               CASE WHEN max(n) >= 6
                    THEN avg(logins_per_day) FILTER (WHERE rn > n - 6 AND rn <= n - 3)
                    ELSE max(logins_per_day) FILTER (WHERE rn = 1) END AS base
        FROM numbered GROUP BY customer_id)),
derived AS (
  SELECT e.*, t.logins_trend_3m,
         avg(logins_per_day) OVER w3 AS logins_3m_avg,
         avg(api_calls) OVER w3 AS api_calls_3m_avg,
         avg(features_used_count) OVER w3 AS features_3m_avg,
         coalesce(engagement_score - lag(engagement_score) OVER w, 0.0) AS engagement_decay,
         days_since_last_login AS days_inactive,
         1 - greatest(0.0, least(1.0, days_since_last_login / CAST(60 AS DOUBLE))) AS recency_score,
         CASE WHEN days_since_last_login BETWEEN 1 AND 7 THEN '0-7 days'
              WHEN days_since_last_login BETWEEN 8 AND 14 THEN '7-14 days'
              WHEN days_since_last_login BETWEEN 15 AND 30 THEN '14-30 days'
              WHEN days_since_last_login BETWEEN 31 AND 60 THEN '30-60 days'
              WHEN days_since_last_login BETWEEN 61 AND 365 THEN '60+ days' END
           AS recency_category,
         features_used_count / CAST(10 AS DOUBLE) AS feature_adoption_rate
  FROM enriched e JOIN trend t USING (customer_id)
  WINDOW w AS (PARTITION BY customer_id ORDER BY period),
         w3 AS (PARTITION BY customer_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
flagged AS (
  SELECT *,
         CAST(feature_adoption_rate > CAST(0.7 AS DOUBLE) AS INTEGER) AS is_high_adoption,
         CAST(feature_adoption_rate < CAST(0.3 AS DOUBLE) AS INTEGER) AS is_low_adoption,
         CAST(days_inactive >= 30 AS INTEGER) AS flag_no_login_30days,
         CAST(days_inactive >= 60 AS INTEGER) AS flag_no_login_60days,
         CAST(feature_adoption_rate < CAST(0.3 AS DOUBLE) AS INTEGER) AS flag_low_feature_adoption,
         CAST(support_tickets >= 3 AS INTEGER) AS flag_high_support_tickets,
         CAST(logins_trend_3m < CAST(-0.1 AS DOUBLE) AS INTEGER) AS flag_declining_engagement,
         recency_score * 25 + feature_adoption_rate * 25 AS good,
         1 - support_tickets / CAST(5 AS DOUBLE) * 25 AS support
  FROM derived),
feat AS MATERIALIZED (
  SELECT customer_id, period, churned, logins_per_day, api_calls, features_used_count,
         days_inactive, support_tickets, engagement_score, logins_3m_avg, api_calls_3m_avg,
         features_3m_avg, logins_trend_3m, engagement_decay, recency_score,
         feature_adoption_rate, is_high_adoption, is_low_adoption, flag_no_login_30days,
         flag_no_login_60days, flag_low_feature_adoption, flag_high_support_tickets,
         flag_declining_engagement,
         flag_no_login_30days + flag_low_feature_adoption + flag_high_support_tickets
           + flag_declining_engagement AS risk_flag_count,
         greatest(0.0, least(100.0, good
           + (100 - greatest(-100.0, least(100.0, engagement_decay))) / 100 * 25 + support))
           AS health_score,
         company_size, subscription_tier, industry, monthly_revenue
  FROM flagged),
rated AS (
  SELECT *, round(1 / (1 + exp(-(CAST(1.2 AS DOUBLE) + health_score * CAST(-0.05 AS DOUBLE)
              + support_tickets * CAST(0.9 AS DOUBLE) + days_inactive * CAST(0.02 AS DOUBLE)
              + logins_per_day * CAST(-0.25 AS DOUBLE)))), 9) AS p,
         round(health_score, 9) AS health
  FROM feat),
pred AS MATERIALIZED (
  SELECT customer_id, period AS prediction_date, p AS churn_probability,
         CAST(p > 0.5 AS INTEGER) AS predicted_churn,
         CASE WHEN p < 0.2 THEN 'Low Risk' WHEN p < 0.4 THEN 'Medium Risk' ELSE 'High Risk' END
           AS risk_tier,
         health AS health_score, monthly_revenue,
         monthly_revenue * p * 3 AS revenue_at_risk,
         monthly_revenue * p * 12 AS annual_revenue_at_risk,
         p AS composite_risk_score,
         CASE WHEN p > 0.6 AND health < 40 THEN 'Urgent Account Review'
              WHEN p > 0.6 AND health < 50 THEN 'Onboarding Support'
              WHEN p > 0.5 THEN 'Engagement Campaign'
              WHEN p > 0.3 THEN 'Executive Check-in' ELSE 'Monitor' END AS recommendation
  FROM rated),
run AS (SELECT * FROM pred WHERE prediction_date = (SELECT max(prediction_date) FROM pred)),
scored AS (
  SELECT f.*, q.churn_probability, q.predicted_churn,
         CASE WHEN churn_probability > 0 AND churn_probability <= 0.3 THEN 'Low Risk'
              WHEN churn_probability > 0.3 AND churn_probability <= 0.6 THEN 'Medium Risk'
              WHEN churn_probability > 0.6 AND churn_probability <= 1 THEN 'High Risk' END
           AS risk_tier
  FROM feat f JOIN pred q ON q.customer_id = f.customer_id AND q.prediction_date = f.period),
plays(id, action, action_type, discount, fixed, share, months, confidence, timing, rationale, success) AS (
  VALUES
  (1, 'Urgent Discount + Personal Outreach', 'discount_and_outreach', 20, 0, 0.2, 12, 0.85,
   'Within 24 hours', 'Critical churn risk. Immediate intervention needed.', 0.5),
  (2, 'Guided Feature Adoption Program', 'training', 10, 500, 0, 12, 0.72,
   'This week', 'Customer not using features. Training can unlock value.', 0.45),
  (3, 'Multi-Channel Re-engagement Campaign', 'engagement', 15, 750, 0, 12, 0.68,
   'Next 2 weeks', 'Engagement declining. Multi-touch campaign to re-activate.', 0.4),
  (4, 'Executive Account Review', 'executive_outreach', 12, 2000, 0, 24, 0.75,
   'Next 3 weeks', 'High-value customer. Executive relationship management.', 0.55),
  (5, 'Monitor and Nurture', 'monitor', 0, 0, 0, 0, 0.95,
   'Ongoing', 'Customer is healthy. Standard engagement practices.', 0.9)),
rx AS (
  SELECT q.customer_id, q.churn_probability, q.recommendation AS current_recommendation,
         x.action AS prescribed_action, x.action_type, x.discount AS discount_percent,
         CAST(x.fixed + q.monthly_revenue * CAST(x.share AS DOUBLE) AS DOUBLE) AS action_cost,
         q.monthly_revenue * x.months AS expected_retention_value,
         q.monthly_revenue * x.months * (1 - q.churn_probability) AS expected_impact,
         CASE WHEN x.months = 0 THEN 0.0 ELSE q.monthly_revenue * x.months * (1 - q.churn_probability)
           / (x.fixed + q.monthly_revenue * CAST(x.share AS DOUBLE)) END AS roi,
         CAST(x.confidence AS DOUBLE) AS confidence, x.timing, x.rationale,
         CAST(x.success AS DOUBLE) AS success_probability
  FROM run q JOIN plays x ON x.id = CASE
         WHEN recommendation = 'Urgent Account Review' AND churn_probability > 0.6
              AND health_score < 40 THEN 1
         WHEN recommendation = 'Onboarding Support' AND churn_probability > 0.5 THEN 2
         WHEN recommendation = 'Engagement Campaign' AND churn_probability > 0.4 THEN 3
         WHEN recommendation = 'Executive Check-in' AND churn_probability > 0.3
              AND monthly_revenue > 3000 THEN 4
         ELSE 5 END),
phases AS (
  SELECT *,
         CASE WHEN logins_per_day < 0.5 AND days_since_last_login > 30 THEN 'Disengaged'
              WHEN logins_per_day < 1 AND engagement_score < 40 THEN 'Declining'
              WHEN features_used_count < 3 THEN 'Low Adoption'
              WHEN engagement_score < 50 THEN 'Moderate' ELSE 'Healthy' END AS phase,
         CASE WHEN churned = 1 THEN 'CHURNED' WHEN logins_per_day < 0.5 THEN 'Critical'
              WHEN logins_per_day < 1 OR features_used_count < 3 THEN 'High'
              WHEN engagement_score < 50 THEN 'Medium' ELSE 'Low' END AS risk
  FROM panel),
times AS MATERIALIZED (
  SELECT customer_id, period, logins_per_day, features_used_count AS features_used,
         engagement_score, days_since_last_login AS days_inactive, support_tickets, phase,
         CASE phase WHEN 'Disengaged' THEN 'Critical' WHEN 'Declining' THEN 'Warning'
              WHEN 'Low Adoption' THEN 'At Risk' WHEN 'Moderate' THEN 'Monitor' ELSE 'Good' END
           AS health,
         risk, churned,
         CAST(lag(phase) OVER w IS DISTINCT FROM phase AS INTEGER) AS phase_changed,
         row_number() OVER w AS rn
  FROM phases WINDOW w AS (PARTITION BY customer_id ORDER BY period)),
journeys AS (
  SELECT customer_id, arg_max(phase, period) AS current_phase, arg_max(risk, period) AS current_risk,
         arg_max(health, period) AS current_health, arg_max(churned, period) = 1 AS churned,
         min(period) FILTER (WHERE risk IN ('Critical', 'High')) AS first_at_risk_month,
         CAST(count(*) - min(rn) FILTER (WHERE risk IN ('Critical', 'High')) + 1 AS INTEGER)
           AS months_until_churn,
         CAST(count(*) AS INTEGER) AS total_months_observed
  FROM times GROUP BY customer_id),
means AS (
  SELECT avg(health_score) AS mh, avg(support_tickets) AS mt, avg(days_inactive) AS md,
         avg(logins_per_day) AS ml
  FROM feat WHERE period = (SELECT max(period) FROM feat)),
contrib AS (
  SELECT f.customer_id, q.churn_probability, u.feature, u.value, u.contribution,
         CAST(1.2 AS DOUBLE) + mh * CAST(-0.05 AS DOUBLE) + mt * CAST(0.9 AS DOUBLE)
           + md * CAST(0.02 AS DOUBLE) + ml * CAST(-0.25 AS DOUBLE) AS base_value
  FROM feat f JOIN run q ON q.customer_id = f.customer_id AND q.prediction_date = f.period
  CROSS JOIN means
  CROSS JOIN LATERAL (VALUES
    ('health_score', f.health_score, (f.health_score - mh) * CAST(-0.05 AS DOUBLE)),
    ('support_tickets', CAST(f.support_tickets AS DOUBLE),
     (f.support_tickets - mt) * CAST(0.9 AS DOUBLE)),
    ('days_inactive', CAST(f.days_inactive AS DOUBLE),
     (f.days_inactive - md) * CAST(0.02 AS DOUBLE)),
    ('logins_per_day', f.logins_per_day, (f.logins_per_day - ml) * CAST(-0.25 AS DOUBLE))
  ) u(feature, value, contribution)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id
              ORDER BY round(abs(contribution), 9) DESC, feature) AS place
  FROM contrib),
reasons AS (
  SELECT customer_id, max(churn_probability) AS predicted_churn,
         string_agg(feature, ', ' ORDER BY place) AS top_3_features,
         string_agg(format('{:.3f}', round(contribution, 9)), ', ' ORDER BY place)
           AS top_3_shap_values
  FROM ordered WHERE place <= 3 GROUP BY customer_id),
alerted AS (
  SELECT * FROM pred WHERE risk_tier = 'High Risk'
  AND (prediction_date < (SELECT max(prediction_date) FROM pred) OR monthly_revenue >= 10000)),
actions AS (
  SELECT * FROM (VALUES ('email_alert', 'sent'), ('retention_flag_created', 'active'))
    t(action_type, status)),
log AS (
  SELECT CAST('0x' || substr(md5(customer_id || '|' || action_type || '|' || prediction_date), 1, 15)
              AS BIGINT) AS intervention_id,
         customer_id, action_type, prediction_date || ' 00:00:00' AS timestamp, status,
         CASE action_type WHEN 'email_alert'
              THEN 'sales-team+' || customer_id || '@company.com' END AS recipient_email,
         CASE action_type WHEN 'email_alert'
              THEN 'Subject: URGENT: Customer ' || customer_id || ' At Risk of Churn'
              ELSE 'Flagged for retention team review' END AS notes
  FROM alerted CROSS JOIN actions),
waiting AS (
  SELECT customer_id, churn_probability, risk_tier, monthly_revenue, annual_revenue_at_risk,
         health_score, recommendation
  FROM run WHERE risk_tier = 'High Risk' AND NOT EXISTS (
    SELECT 1 FROM log WHERE log.customer_id = run.customer_id
    AND substr(timestamp, 1, 10) = (SELECT max(prediction_date) FROM pred))),
worst AS (SELECT customer_id FROM run ORDER BY churn_probability DESC, customer_id LIMIT 1),
by_run AS (
  SELECT prediction_date, count(*) AS total_predictions, avg(churn_probability) AS avg_churn,
         min(churn_probability) AS min_churn, max(churn_probability) AS max_churn,
         count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk_count,
         count(*) FILTER (WHERE risk_tier = 'Medium Risk') AS medium_risk_count,
         count(*) FILTER (WHERE risk_tier = 'Low Risk') AS low_risk_count,
         sum(annual_revenue_at_risk) AS total_revenue_at_risk
  FROM pred GROUP BY prediction_date),
moved AS (
  SELECT a.prediction_date AS latest_run, b.prediction_date AS previous_run,
         a.avg_churn AS latest_avg, b.avg_churn AS previous_avg,
         abs((a.avg_churn - b.avg_churn) / b.avg_churn) AS change
  FROM by_run a JOIN by_run b ON b.prediction_date < a.prediction_date
  ORDER BY 1 DESC, 2 DESC LIMIT 1),
shares AS (
  SELECT high_risk_count / total_predictions AS high, medium_risk_count / total_predictions AS medium
  FROM by_run ORDER BY prediction_date DESC LIMIT 1),
checks AS (
  SELECT 'prediction_drift' AS metric_type, 'daily_drift_detection' AS metric_name,
         change AS metric_value, change > 0.15 AS alert_flag,
         'Change: ' || format('{:.2f}', change * 100) || '%' AS notes FROM moved
  UNION ALL
  SELECT 'risk_distribution', 'high_risk_percentage', high, high > 0.05 OR medium > 0.15,
         'High: ' || format('{:.1f}', high * 100) || '%, Medium: '
           || format('{:.1f}', medium * 100) || '%' FROM shares
  UNION ALL
  SELECT 'prediction_stats', 'average_churn_probability', avg_churn, false,
         'Min: ' || format('{:.4f}', min_churn) || ', Max: ' || format('{:.4f}', max_churn)
  FROM by_run WHERE prediction_date = (SELECT max(prediction_date) FROM pred)
  UNION ALL
  SELECT 'prediction_stats', 'total_revenue_at_risk', total_revenue_at_risk, false,
         'High Risk: ' || high_risk_count || ', Medium: ' || medium_risk_count
  FROM by_run WHERE prediction_date = (SELECT max(prediction_date) FROM pred))
"""

PANEL_COLUMNS = f"""customer_id, period, active_users, api_calls, {rs('logins_per_day')},
  days_since_last_login, features_used_count, support_tickets, {rs('engagement_score')}, churned"""

FEATURE_COLUMNS = f"""customer_id, period, churned, {rs('logins_per_day')}, api_calls,
  features_used_count, days_inactive, support_tickets, {rs('engagement_score', 'logins_3m_avg',
  'api_calls_3m_avg', 'features_3m_avg', 'logins_trend_3m', 'engagement_decay', 'recency_score',
  'feature_adoption_rate')}, is_high_adoption, is_low_adoption, flag_no_login_30days,
  flag_no_login_60days, flag_low_feature_adoption, flag_high_support_tickets,
  flag_declining_engagement, risk_flag_count, {rs('health_score')}, company_size,
  subscription_tier, industry, {rs('monthly_revenue')}"""

NUMERIC = (
    "churned", "logins_per_day", "api_calls", "features_used_count", "days_inactive",
    "support_tickets", "engagement_score", "logins_3m_avg", "api_calls_3m_avg",
    "features_3m_avg", "logins_trend_3m", "engagement_decay", "recency_score",
    "feature_adoption_rate", "is_high_adoption", "is_low_adoption", "flag_no_login_30days",
    "flag_no_login_60days", "flag_low_feature_adoption", "flag_high_support_tickets",
    "flag_declining_engagement", "risk_flag_count", "health_score", "monthly_revenue",
)


def add(name: str, sql: str) -> None:
    ORACLES[name] = SHARED + sql


def all_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- ingestion ------------------------------------------------------------------------------

add("ingest_dedup", """
SELECT customer_id, period, api_calls, churned, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, period ORDER BY seq) AS k FROM (
    SELECT customer_id, period, api_calls, churned, 0 AS seq FROM panel
    UNION ALL SELECT customer_id, period, api_calls + 1, churned, 1 FROM panel WHERE churned = 1))
WHERE k = 1""")

add("duplicate_count", """
SELECT count(*) + CAST(sum(churned) AS BIGINT) AS records, count(*) AS kept,
       CAST(sum(churned) AS BIGINT) AS removed FROM panel""")

add("panel_union", f"SELECT {PANEL_COLUMNS} FROM panel")

add("period_max_users", """
SELECT customer_id, period, active_users,
       max(active_users) OVER (PARTITION BY period) AS peak_users FROM panel""")

add("engagement_score", f"SELECT customer_id, period, {r('engagement_score')} FROM panel")

add("engagement_enriched", f"""
SELECT {PANEL_COLUMNS}, company_size, subscription_tier, industry, {r('monthly_revenue')}
FROM enriched""")

RATES = """
, priors AS (
  SELECT customer_id, monthly_revenue AS list_price,
         CAST(CASE company_size || '/' || subscription_tier
           WHEN 'small/Starter' THEN 0.2 WHEN 'small/Professional' THEN 0.12
           WHEN 'small/Enterprise' THEN 0.05 WHEN 'medium/Starter' THEN 0.15
           WHEN 'medium/Professional' THEN 0.08 WHEN 'medium/Enterprise' THEN 0.03
           WHEN 'large/Starter' THEN 0.1 WHEN 'large/Professional' THEN 0.05
           WHEN 'large/Enterprise' THEN 0.01 END AS DOUBLE) AS base_rate,
         CAST(CASE industry WHEN 'SaaS' THEN 1.0 WHEN 'Finance' THEN 0.7
           WHEN 'Healthcare' THEN 0.8 WHEN 'Retail' THEN 1.3 WHEN 'Other' THEN 1.1 END AS DOUBLE)
           AS industry_factor,
         (year(d) - 2023) * 12 + month(d) - (year(onboarding_date) - 2023) * 12
           - month(onboarding_date) AS tenure,
         CASE WHEN month(d) IN (1, 4, 10, 12) THEN 1.15 ELSE 0.85 END AS season
  FROM cust CROSS JOIN (SELECT max(CAST(ts AS DATE)) AS d FROM events))
"""
add("rate_lookup", RATES + f"""
SELECT customer_id, {rs('list_price', 'base_rate', 'industry_factor')} FROM priors""")

add("segment_churn_prior", RATES + f"""
SELECT customer_id, CAST(tenure AS INTEGER) AS tenure_months,
       {r('''CASE WHEN tenure < 0 THEN 0 ELSE least(0.5, base_rate * industry_factor * season
          * CASE WHEN tenure < 2 THEN 1.5 WHEN tenure < 6 THEN 1.2 ELSE 1 END) END''', 'churn_prior')}
FROM priors""")

# --- features --------------------------------------------------------------------------------

add("rolling_3m", f"""
SELECT customer_id, period, {rs('logins_3m_avg', 'api_calls_3m_avg', 'features_3m_avg')}
FROM feat""")
add("login_trend", f"""
SELECT n.customer_id, n.period, {r('t.logins_trend_3m', 'logins_trend_3m')}
FROM numbered n JOIN trend t USING (customer_id)""")
add("login_trend_point_in_time", f"""
, sides AS (
  SELECT customer_id, period,
         avg(logins_per_day) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
         CASE WHEN rn >= 6 THEN avg(logins_per_day) OVER (o ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)
              ELSE first_value(logins_per_day) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         END AS base
  FROM numbered WINDOW o AS (PARTITION BY customer_id ORDER BY period))
SELECT customer_id, period,
       {r('CASE WHEN base > 0 THEN (recent - base) / base ELSE 0 END', 'logins_trend_3m')}
FROM sides""")
add("engagement_decay", f"SELECT customer_id, period, {r('engagement_decay')} FROM feat")
add("recency_features", f"""
SELECT customer_id, period, days_inactive, recency_category, {r('recency_score')} FROM derived""")
add("adoption_features", f"""
SELECT customer_id, period, {r('feature_adoption_rate')}, is_high_adoption, is_low_adoption
FROM feat""")
add("risk_flags", """
SELECT customer_id, period, flag_no_login_60days, flag_no_login_30days, flag_low_feature_adoption,
       flag_high_support_tickets, flag_declining_engagement FROM feat""")
add("risk_flag_count", "SELECT customer_id, period, risk_flag_count FROM feat")
add("health_score", f"SELECT customer_id, period, {r('health_score')} FROM feat")
add("health_score_corrected", f"""
SELECT customer_id, period,
       {r('''greatest(0.0, least(100.0, recency_score * 25 + feature_adoption_rate * 25
             + (100 + least(0.0, greatest(-100.0, engagement_decay))) / 100 * 25
             + (1 - least(1.0, support_tickets / CAST(5 AS DOUBLE))) * 25))''', 'health_score')}
FROM feat""")
add("feature_matrix", f"SELECT {FEATURE_COLUMNS} FROM feat")
add("latest_period", f"""
SELECT {FEATURE_COLUMNS} FROM feat WHERE period = (SELECT max(period) FROM feat)""")
add("fill_missing", f"""
, gaps AS (
  SELECT customer_id, period, CASE WHEN active_users > 0 THEN api_calls END AS a,
         CASE WHEN active_users > 0 THEN logins_per_day END AS l FROM panel),
filled AS (
  SELECT customer_id, period, coalesce(a, 0) AS api_calls_zero, coalesce(l, 0) AS logins_zero,
         coalesce(a, avg(a) OVER ()) AS api_calls_mean, coalesce(l, avg(l) OVER ()) AS logins_mean,
         avg(a) OVER w3 AS api_calls_3m_avg, avg(l) OVER w3 AS logins_3m_avg
  FROM gaps WINDOW w3 AS (PARTITION BY customer_id ORDER BY period
                          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT customer_id, period, api_calls_zero, {rs('logins_zero', 'api_calls_mean', 'logins_mean',
       'api_calls_3m_avg', 'logins_3m_avg')} FROM filled""")

# --- scoring ------------------------------------------------------------------------------------

SCORE_MONEY = rs("churn_probability", "health_score", "monthly_revenue", "revenue_at_risk",
                 "annual_revenue_at_risk", "composite_risk_score")
BY_RISK = "row_number() OVER (PARTITION BY prediction_date ORDER BY churn_probability DESC, customer_id)"

add("score_customers", f"""
SELECT customer_id, prediction_date, predicted_churn, risk_tier, recommendation, {SCORE_MONEY},
       {BY_RISK} AS risk_rank FROM run""")
add("score_customers_model_tiers", f"""
SELECT q.customer_id, prediction_date, q.predicted_churn, s.risk_tier, recommendation,
       {r('q.churn_probability', 'churn_probability')}, {r('q.health_score', 'health_score')},
       {r('q.monthly_revenue', 'monthly_revenue')}, {rs('revenue_at_risk',
       'annual_revenue_at_risk', 'composite_risk_score')},
       row_number() OVER (ORDER BY q.churn_probability DESC, q.customer_id) AS risk_rank
FROM run q JOIN scored s ON s.customer_id = q.customer_id AND s.period = q.prediction_date""")
add("score_all_periods", f"""
SELECT customer_id, period, churned, {r('churn_probability')}, predicted_churn, risk_tier
FROM scored""")
add("predicted_churn", "SELECT customer_id, prediction_date, predicted_churn FROM pred")
add("risk_tier_model", """
SELECT customer_id, period AS prediction_date, risk_tier FROM scored""")
add("risk_tier_business", "SELECT customer_id, prediction_date, risk_tier FROM pred")
add("retier", "SELECT customer_id, prediction_date, risk_tier FROM pred")
add("retier_distribution", "SELECT risk_tier, count(*) AS customers FROM pred GROUP BY risk_tier")
add("recommendation", "SELECT customer_id, prediction_date, recommendation FROM pred")
add("revenue_at_risk", f"""
SELECT customer_id, prediction_date, {rs('revenue_at_risk', 'annual_revenue_at_risk')}
FROM pred""")
add("revenue_enriched", f"""
SELECT customer_id, prediction_date, {rs('churn_probability', 'monthly_revenue',
       'revenue_at_risk')}, {r('revenue_at_risk * 4', 'annual_revenue_at_risk')}, risk_tier
FROM run""")
add("risk_rank", f"""
SELECT customer_id, prediction_date, {r('churn_probability')}, {BY_RISK} AS risk_rank
FROM pred""")
add("revenue_rank", f"""
SELECT customer_id, prediction_date, {r('annual_revenue_at_risk')},
       rank() OVER (ORDER BY round(annual_revenue_at_risk, 9) DESC) AS risk_rank FROM pred""")
add("price_rank", f"""
SELECT customer_id, {r('monthly_revenue')},
       rank() OVER (ORDER BY cust.monthly_revenue DESC) AS price_rank FROM cust""")
add("revenue_summary", f"""
SELECT count(*) AS total_customers,
       count(*) FILTER (WHERE risk_tier = 'Low Risk') AS low_risk_count,
       count(*) FILTER (WHERE risk_tier = 'Medium Risk') AS medium_risk_count,
       count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk_count,
       {r('sum(monthly_revenue) * 12', 'total_annual_revenue')},
       {r('sum(annual_revenue_at_risk)', 'total_revenue_at_risk')},
       {r('avg(churn_probability)', 'avg_churn_probability')},
       {r("coalesce(sum(annual_revenue_at_risk) FILTER (WHERE risk_tier = 'High Risk'), 0)",
          'high_risk_revenue_at_risk')}
FROM run""")

# --- prescriptions --------------------------------------------------------------------------------

add("prescriptions", f"""
SELECT customer_id, {r('churn_probability')}, current_recommendation, prescribed_action,
       action_type, discount_percent, {rs('action_cost', 'expected_retention_value',
       'expected_impact', 'roi', 'confidence')}, timing, rationale, {r('success_probability')}
FROM rx""")
add("portfolio_impact", f"""
SELECT {r('sum(action_cost)', 'total_action_cost')},
       {r('sum(expected_impact)', 'total_expected_impact')},
       {r('CASE WHEN sum(action_cost) > 0 THEN sum(expected_impact) / sum(action_cost) ELSE 0 END',
          'portfolio_roi')},
       count(*) FILTER (WHERE roi > 10) AS high_roi_actions FROM rx""")
add("action_breakdown", """
SELECT action_type, count(*) AS customer_count, round_even(sum(action_cost), 0) AS total_cost,
       round_even(sum(expected_impact), 0) AS total_impact, round_even(avg(roi), 0) AS avg_roi
FROM rx GROUP BY action_type""")
add("top_roi", f"""
SELECT customer_id, prescribed_action, {rs('roi', 'confidence', 'success_probability')}
FROM (SELECT * FROM rx ORDER BY roi DESC, customer_id LIMIT 20)""")
add("prescription_lookup", f"""
SELECT customer_id, prescribed_action AS recommended_action, discount_percent,
       {rs('roi', 'confidence', 'success_probability')} FROM rx JOIN worst USING (customer_id)""")

# --- journeys ----------------------------------------------------------------------------------------

add("journey_phase", "SELECT customer_id, period, phase, health FROM times")
add("journey_risk", "SELECT customer_id, period, risk FROM times")
add("journey_timeline", f"""
SELECT customer_id, period, {r('logins_per_day')}, features_used, {r('engagement_score')},
       days_inactive, support_tickets, phase, health, risk, churned, phase_changed FROM times""")
add("journey_inflections", """
SELECT customer_id, period, phase, risk FROM times WHERE phase_changed = 1""")
add("journey_summary", "SELECT * FROM journeys")
add("repaired_state", "SELECT * FROM journeys")
add("journey_statistics", f"""
SELECT count(*) AS total_customers, count(*) FILTER (WHERE churned) AS churned_customers,
       {r('count(*) FILTER (WHERE churned) / count(*)', 'churned_share')},
       count(*) FILTER (WHERE current_risk IN ('Critical', 'High')) AS at_risk_customers
FROM journeys""")
for column, name in (("current_phase", "phase_distribution"), ("current_risk", "risk_distribution")):
    add(name, f"""
SELECT {column}, count(*) AS customers,
       {r('count(*) / (SELECT count(*) FROM journeys)', 'share')}
FROM journeys GROUP BY {column}""")
add("journey_narrative", """
, points AS (
  SELECT customer_id, string_agg(period || ': → ' || phase, chr(10) ORDER BY period)
           AS inflection_points
  FROM times WHERE phase_changed = 1 GROUP BY customer_id),
detail AS (
  SELECT customer_id, string_agg(concat_ws(' ', period, logins_per_day, features_used,
           engagement_score, phase, risk), chr(10) ORDER BY period) AS lines
  FROM times GROUP BY customer_id),
told AS (
  SELECT customer_id, inflection_points, lines,
         concat_ws(chr(10), 'CUSTOMER ' || customer_id || ' JOURNEY ANALYSIS',
           'Phase: ' || current_phase, 'Health: ' || current_health,
           'Risk Level: ' || current_risk,
           'Churned: ' || CASE WHEN churned THEN 'Yes' ELSE 'No' END,
           'Total months observed: ' || total_months_observed,
           'First at-risk: ' || coalesce(first_at_risk_month, 'Never'),
           'Months until churn: ' || months_until_churn) AS status
  FROM journeys JOIN points USING (customer_id) JOIN detail USING (customer_id))
SELECT customer_id, inflection_points, status,
       concat_ws(chr(10) || chr(10), status, 'Inflection Points:' || chr(10) || inflection_points,
         'Detailed Journey:' || chr(10) || lines) AS narrative
FROM told""")

# --- serving -----------------------------------------------------------------------------------------

add("latest_run", f"""
SELECT customer_id, prediction_date, {r('churn_probability')}, risk_tier, {BY_RISK} AS risk_rank
FROM run""")
add("customer_lookup", f"""
SELECT customer_id, {rs('churn_probability', 'monthly_revenue', 'annual_revenue_at_risk',
       'health_score')}, risk_tier, recommendation FROM run JOIN worst USING (customer_id)""")
VIEW = f"""
SELECT q.customer_id, {r('q.churn_probability', 'churn_probability')}, risk_tier,
       {rs('monthly_revenue', 'annual_revenue_at_risk', 'health_score')}, recommendation, prescribed_action,
       discount_percent, {rs('roi', 'success_probability')}, top_3_features, top_3_shap_values
FROM run q LEFT JOIN rx ON rx.customer_id = q.customer_id
LEFT JOIN reasons ON reasons.customer_id = q.customer_id"""
add("customer_360", VIEW)
add("customer_view", VIEW + " JOIN worst ON worst.customer_id = q.customer_id")
add("customer_options", "SELECT DISTINCT customer_id FROM panel")
TOP_50 = "(SELECT * FROM run ORDER BY annual_revenue_at_risk DESC, customer_id LIMIT 50)"
add("priority_customers", f"""
SELECT customer_id, {rs('monthly_revenue', 'churn_probability', 'health_score',
       'revenue_at_risk', 'annual_revenue_at_risk')}, risk_tier, recommendation FROM {TOP_50}""")
add("priority_rank", f"""
SELECT CAST(row_number() OVER (ORDER BY t.annual_revenue_at_risk DESC, customer_id) AS INTEGER)
         AS priority_rank, customer_id, {r('annual_revenue_at_risk')} FROM {TOP_50} t""")
add("high_risk_list", f"""
SELECT customer_id, {rs('churn_probability', 'monthly_revenue', 'annual_revenue_at_risk',
       'health_score')}, recommendation
FROM (SELECT * FROM run WHERE risk_tier = 'High Risk'
      ORDER BY annual_revenue_at_risk DESC, customer_id LIMIT 50)""")
add("high_prob_filter", f"""
SELECT customer_id, prediction_date, {r('churn_probability')}, risk_tier
FROM (SELECT * FROM pred WHERE churn_probability > 0.4
      ORDER BY churn_probability DESC, customer_id, prediction_date LIMIT 10)""")
add("display_format", """
SELECT CAST(row_number() OVER (ORDER BY t.revenue_at_risk DESC, customer_id) AS INTEGER) AS rank,
       customer_id, '$' || format('{:,.0f}', t.monthly_revenue) AS monthly_revenue,
       format('{:.1f}', t.churn_probability * 100) || '%' AS churn_probability,
       format('{:.0f}', t.health_score) AS health_score,
       '$' || format('{:,.0f}', t.revenue_at_risk) AS revenue_at_risk, recommendation, risk_tier
FROM (SELECT * FROM run ORDER BY revenue_at_risk DESC, customer_id LIMIT 50) t""")
add("display_prescriptions", """
SELECT CAST(row_number() OVER (ORDER BY t.roi DESC, customer_id) AS INTEGER) AS rank,
       customer_id, prescribed_action, t.discount_percent || '%' AS discount_percent,
       format('{:.1f}', t.roi) || 'x' AS roi,
       format('{:.0f}', t.confidence * 100) || '%' AS confidence,
       format('{:.0f}', t.success_probability * 100) || '%' AS success_probability
FROM (SELECT * FROM rx ORDER BY roi DESC, customer_id LIMIT 20) t""")
add("kpi_summary", f"""
SELECT count(*) AS total_customers, count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk,
       {r('sum(annual_revenue_at_risk)', 'total_revenue_at_risk')},
       {r('avg(churn_probability)', 'avg_churn_prob')},
       {r("coalesce(sum(annual_revenue_at_risk) FILTER (WHERE risk_tier = 'High Risk'), 0)",
          'revenue_at_risk_high_risk')}
FROM run""")
add("tier_distribution", "SELECT risk_tier, count(*) AS customers FROM pred GROUP BY risk_tier")
add("recommendation_counts", """
SELECT recommendation, count(*) AS customers FROM run GROUP BY recommendation""")
add("revenue_by_tier", f"""
SELECT risk_tier, {r('sum(run.annual_revenue_at_risk)', 'annual_revenue_at_risk')}
FROM run GROUP BY risk_tier""")
add("revenue_by_recommendation", f"""
SELECT recommendation, {r('sum(run.monthly_revenue)', 'monthly_revenue')}
FROM run GROUP BY recommendation""")
add("probability_buckets", """
SELECT count(*) FILTER (WHERE churn_probability < 0.2) AS under_20,
       count(*) FILTER (WHERE churn_probability >= 0.2 AND churn_probability < 0.4) AS between_20_40,
       count(*) FILTER (WHERE churn_probability >= 0.4) AS above_40 FROM pred""")
add("probability_stats", f"""
SELECT count(*) AS total, {r('min(churn_probability)', 'min_churn')},
       {r('max(churn_probability)', 'max_churn')}, {r('avg(churn_probability)', 'avg_churn')},
       {r('quantile_cont(churn_probability, 0.5)', 'median_churn')} FROM pred""")


def histogram_sql(
    source: str, columns: tuple[str, ...], bins: int, group: str = "", groups: str = "",
    metric: bool = True,
) -> str:
    """Equal-width bins over each column's range, empty ones included."""
    lead = f"{group}, " if group else ""
    cells = " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)
    grid = f" CROSS JOIN (VALUES {groups}) g({group})" if group else ""
    match = f"v.{group} = f.{group} AND " if group else ""
    shown = ("f.metric, " if metric else "") + (f"f.{group}, " if group else "")
    return f"""
, hcells AS ({cells}),
spans AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM hcells GROUP BY metric),
binned AS (
  SELECT {lead}metric, least({bins - 1}, CAST(floor((value - lo) / (hi - lo) * {bins}) AS INTEGER)) AS bin
  FROM hcells JOIN spans USING (metric)),
frame AS (SELECT * FROM spans CROSS JOIN range({bins}) t(bin){grid})
SELECT {shown}CAST(f.bin AS INTEGER) AS bin,
       {r(f"lo + f.bin * ((hi - lo) / {bins})", "bin_start")},
       {r(f"lo + (f.bin + 1) * ((hi - lo) / {bins})", "bin_end")}, count(v.bin) AS n
FROM frame f LEFT JOIN binned v ON {match}v.metric = f.metric AND v.bin = f.bin
GROUP BY {"f." + group + ", " if group else ""}f.metric, f.bin, lo, hi"""


add("probability_histogram", histogram_sql(
    "run", ("churn_probability",), 30, metric=False))
add("health_histogram", histogram_sql("run", ("health_score",), 20, metric=False))
LABEL_METRICS = ("logins_per_day", "features_used_count", "days_since_last_login", "engagement_score")
KEY_FEATURES = ("days_inactive", "feature_adoption_rate", "health_score", "logins_3m_avg",
                "logins_trend_3m")
add("histogram", histogram_sql("enriched", LABEL_METRICS, 20, "churned", "(0), (1)"))
add("key_feature_histograms", histogram_sql("feat", KEY_FEATURES, 30))
add("retention_scenarios", f"""
SELECT format('{{:.0f}}', rate * 100) || '%' AS scenario,
       {r('sum(annual_revenue_at_risk) * rate', 'revenue_saved')}
FROM run CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.2), (0.3), (0.5)) t(rate) GROUP BY rate""")
add("business_case", f"""
SELECT count(*) AS total_customers,
       count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk_customers,
       {r("count(*) FILTER (WHERE risk_tier = 'High Risk') / count(*) * 100", 'high_risk_percent')},
       {r('sum(run.annual_revenue_at_risk)', 'annual_revenue_at_risk')},
       count(*) FILTER (WHERE recommendation = 'Urgent Account Review') AS urgent_reviews,
       {r('sum(run.annual_revenue_at_risk) * 0.2', 'revenue_saved')} FROM run""")
add("churn_health_points", f"""
SELECT customer_id, {rs('health_score', 'churn_probability', 'monthly_revenue')}, risk_tier,
       recommendation FROM run""")
add("distinct_customers", """
SELECT count(*) AS records, count(DISTINCT customer_id) AS customers FROM panel""")

# --- exploration ------------------------------------------------------------------------------------

CHURN = f"""CAST(sum(churned) AS BIGINT) AS churn_count, {r('avg(churned)', 'churn_rate')},
       count(*) AS total_records"""
for segment, name in (("company_size", "churn_by_size"), ("subscription_tier", "churn_by_tier"),
                      ("industry", "churn_by_industry")):
    add(name, f"SELECT {segment}, {CHURN} FROM enriched GROUP BY {segment}")
add("churn_by_segments", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS segment, {s} AS segment_value, {CHURN} FROM enriched GROUP BY {s}"
    for s in ("company_size", "subscription_tier", "industry")))
add("churn_pivot", "SELECT company_size, " + ", ".join(
    r(f"avg(churned) FILTER (WHERE subscription_tier = '{t}')", f'"{t}"')
    for t in ("Starter", "Professional", "Enterprise")) + " FROM enriched GROUP BY company_size")
add("engagement_by_label", "SELECT CASE churned WHEN 1 THEN 'Churned' ELSE 'Active' END AS label, "
    + ", ".join(r(f"avg(enriched.{c})", c) for c in ("logins_per_day", "features_used_count",
                "days_since_last_login", "engagement_score"))
    + " FROM enriched GROUP BY churned")
TREND = f"""SELECT period, CAST(sum(churned) AS BIGINT) AS churn_count,
       {r('avg(churned)', 'churn_rate')} FROM enriched GROUP BY period"""
add("churn_trend", TREND)
add("high_churn_periods", TREND + " HAVING avg(churned) > 0.1")


def rate_text(where: str) -> str:
    return f"(SELECT format('{{:.2f}}', avg(churned) * 100) || '%' FROM enriched WHERE {where})"


add("segment_summary", f"""
SELECT * FROM (VALUES
  ('Total Customers', (SELECT CAST(count(*) AS VARCHAR) FROM cust)),
  ('Total Records', (SELECT CAST(count(*) AS VARCHAR) FROM enriched)),
  ('Overall Churn Rate', {rate_text('true')}),
  ('Small Company Churn', {rate_text("company_size = 'small'")}),
  ('Large Company Churn', {rate_text("company_size = 'large'")}),
  ('Starter Tier Churn', {rate_text("subscription_tier = 'Starter'")}),
  ('Enterprise Tier Churn', {rate_text("subscription_tier = 'Enterprise'")})) t(metric, value)""")
PANEL_NAMES = ("customer_id", "period", "active_users", "api_calls", "logins_per_day",
               "days_since_last_login", "features_used_count", "support_tickets",
               "engagement_score", "churned", "company_size", "subscription_tier", "industry",
               "monthly_revenue")
add("quality_report", f"""
SELECT count(*) AS records,
       CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in PANEL_NAMES)} AS BIGINT)
         AS total_nulls,
       count(*) FILTER (WHERE isinf(logins_per_day) OR isinf(engagement_score)
                        OR isinf(monthly_revenue)) AS infinite_values,
       {r('min(logins_per_day)', 'min_logins_per_day')},
       {r('max(logins_per_day)', 'max_logins_per_day')},
       min(days_since_last_login) AS min_days_since_last_login,
       max(days_since_last_login) AS max_days_since_last_login,
       min(features_used_count) AS min_features_used_count,
       max(features_used_count) AS max_features_used_count,
       (SELECT string_agg(v, ',' ORDER BY v) FROM
         (SELECT DISTINCT CAST(churned AS VARCHAR) AS v FROM enriched)) AS label_values,
       CAST(sum(churned) AS BIGINT) AS churn_events, {r('avg(churned)', 'churn_rate')},
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM enriched)) AS duplicate_rows
FROM enriched""")
add("label_distribution", f"""
SELECT churned, count(*) AS records, {r('count(*) / (SELECT count(*) FROM feat)', 'share')}
FROM feat GROUP BY churned""")
add("complete_records", f"""
SELECT count(*) AS total_records, CAST(sum(feat.churned) AS BIGINT) AS churned,
       {r('avg(feat.churned)', 'churn_rate')}, count(*) AS complete_records FROM feat""")
CELLS = ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM feat" for c in NUMERIC) + ")\n"
add("describe_features", CELLS + f"""
SELECT metric, count(*) AS count, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')},
       {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'p25')},
       {r('quantile_cont(value, 0.5)', 'p50')}, {r('quantile_cont(value, 0.75)', 'p75')},
       {r('max(value)', 'max')} FROM cells GROUP BY metric""")


def pearson(a: str, b: str) -> str:
    return (f"(SELECT CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) "
            f"THEN round(corr({a}, {b}), 6) + 0.0 END FROM feat)")


add("label_correlation", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {pearson(c, 'churned')})" for c in NUMERIC if c != "churned")
    + ") t(feature, correlation)")
MATRIX = ("logins_per_day", "days_inactive", "feature_adoption_rate", "logins_trend_3m",
          "health_score", "risk_flag_count", "churned")
add("correlation_matrix", 'SELECT * FROM (VALUES ' + ", ".join(
    f"('{a}', '{b}', {pearson(a, b)})" for a in MATRIX for b in MATRIX)
    + ') t("left", "right", corr)')
for segment, name in (("company_size", "features_by_size"), ("subscription_tier", "features_by_tier")):
    add(name, f"SELECT {segment}, " + ", ".join(
        f"round_even(avg(feat.{c}), 2) AS {c}" for c in ("days_inactive", "feature_adoption_rate",
        "health_score", "risk_flag_count", "churned")) + f" FROM feat GROUP BY {segment}")
PLOTS = (("health_score", "company_size"), ("risk_flag_count", "subscription_tier"),
         ("feature_adoption_rate", "churned"), ("days_inactive", "churned"))
add("boxplot_stats", ", vals AS (" + " UNION ALL ".join(
    f"SELECT '{c} by {g}' AS plot, CAST({g} AS VARCHAR) AS grp, CAST({c} AS DOUBLE) AS v FROM feat"
    for c, g in PLOTS) + f"""),
boxes AS (
  SELECT plot, grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
         quantile_cont(v, 0.75) AS q3 FROM vals GROUP BY plot, grp)
SELECT plot, grp AS "group", {r('any_value(q1)', 'q1')}, {r('any_value(median)', 'median')},
       {r('any_value(q3)', 'q3')}, {r('any_value(q3 - q1)', 'iqr')},
       {r('min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))',
          'whisker_low')},
       {r('max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))',
          'whisker_high')},
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM vals JOIN boxes USING (plot, grp) GROUP BY plot, grp""")
SEGMENTED = """
, segmented AS (
  SELECT *, CASE WHEN risk_flag_count = 0 THEN 'Low Risk' WHEN risk_flag_count <= 2
            THEN 'Medium Risk' ELSE 'High Risk' END AS risk_segment FROM feat)
"""
add("health_by_segment", SEGMENTED + histogram_sql(
    "segmented", ("health_score",), 20, "risk_segment",
    "('Low Risk'), ('Medium Risk'), ('High Risk')", metric=False))
add("feature_center", CELLS + f"""
SELECT metric, {r('avg(value)', 'mean')}, {r('quantile_cont(value, 0.5)', 'median')} FROM cells
WHERE metric IN ('days_inactive', 'feature_adoption_rate', 'health_score', 'logins_3m_avg',
                 'logins_trend_3m') GROUP BY metric""")
add("risk_segment", SEGMENTED + """
SELECT customer_id, period, risk_flag_count, risk_segment FROM segmented""")
add("segment_churn_rate", SEGMENTED + f"""
SELECT risk_segment, CAST(sum(churned) AS BIGINT) AS churned_count, count(*) AS total_customers,
       {r('avg(churned)', 'churn_rate')} FROM segmented GROUP BY risk_segment""")

# --- evaluation ---------------------------------------------------------------------------------------

add("segment_enriched", f"""
SELECT customer_id, period, {r('churn_probability')}, c.company_size, c.subscription_tier,
       {r('c.monthly_revenue', 'monthly_revenue')}
FROM scored LEFT JOIN cust c USING (customer_id)""")
add("tier_calibration", f"""
SELECT risk_tier, CAST(sum(churned) AS BIGINT) AS churned_count, count(*) AS total_customers,
       {r('avg(churned)', 'actual_churn_rate')}, {r('avg(predicted_churn)', 'predicted_churn_rate')}
FROM scored GROUP BY risk_tier""")
HIGH_PART = f"""count(*) AS customers, CAST(sum(scored.churned) AS BIGINT) AS churned,
       {r('sum(scored.monthly_revenue)', 'monthly_revenue')}
FROM scored WHERE risk_tier = 'High Risk'"""
add("high_risk_segments", f"""
SELECT 'company_size' AS segment, company_size AS segment_value, {HIGH_PART} GROUP BY company_size
UNION ALL SELECT 'subscription_tier', subscription_tier, {HIGH_PART} GROUP BY subscription_tier
UNION ALL SELECT 'all', 'all', {HIGH_PART}""")
add("top_risk_rows", f"""
SELECT customer_id, period, {r('churn_probability')}, company_size, subscription_tier, churned
FROM (SELECT * FROM scored WHERE risk_tier = 'High Risk'
      ORDER BY churn_probability DESC, customer_id, period LIMIT 10)""")
add("calibration_deciles", f"""
, span AS (SELECT min(churn_probability) AS lo, max(churn_probability) AS hi FROM scored)
SELECT greatest(1, CAST(ceil((churn_probability - lo) / (hi - lo) * 10) AS INTEGER)) AS bin,
       count(*) AS total_customers, CAST(sum(churned) AS BIGINT) AS churned_count,
       round(avg(churned), 3) AS actual_churn_rate, {r('avg(churn_probability)', 'pred_churn_prob')}
FROM scored CROSS JOIN span GROUP BY 1""")
COUNTS = """
, c AS (
  SELECT count(*) FILTER (WHERE churned = 0 AND predicted_churn = 0) AS tn,
         count(*) FILTER (WHERE churned = 0 AND predicted_churn = 1) AS fp,
         count(*) FILTER (WHERE churned = 1 AND predicted_churn = 0) AS fn,
         count(*) FILTER (WHERE churned = 1 AND predicted_churn = 1) AS tp FROM scored)
"""
add("confusion_metrics", COUNTS + f"""
SELECT tn, fp, fn, tp, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
       {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
       {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')} FROM c""")
add("classification_report", COUNTS + f"""
, parts AS (
  SELECT 'Active' AS label, tn / nullif(tn + fn, 0) AS p, tn / nullif(tn + fp, 0) AS re,
         2 * tn / nullif(2 * tn + fp + fn, 0) AS f, tn + fp AS n FROM c
  UNION ALL
  SELECT 'Churned', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)
SELECT label, {r('p', 'precision')}, {r('re', 'recall')}, {r('f', 'f1')}, n AS support FROM parts
UNION ALL SELECT 'accuracy', NULL, NULL, {r('(tn + tp) / (tn + tp + fp + fn)', 'f1')},
       tn + tp + fp + fn FROM c
UNION ALL SELECT 'macro avg', {r('avg(p)', 'a')}, {r('avg(re)', 'b')}, {r('avg(f)', 'd')},
       CAST(sum(n) AS BIGINT) FROM parts
UNION ALL SELECT 'weighted avg', {r('sum(p * n) / sum(n)', 'a')}, {r('sum(re * n) / sum(n)', 'b')},
       {r('sum(f * n) / sum(n)', 'd')}, CAST(sum(n) AS BIGINT) FROM parts""")
add("roc_curve", f"""
, g AS (SELECT churn_probability AS s, sum(churned) AS pos, sum(1 - churned) AS neg
        FROM scored GROUP BY 1)
SELECT {r('s', 'threshold')}, {r('sum(neg) OVER o / sum(neg) OVER ()', 'fpr')},
       {r('sum(pos) OVER o / sum(pos) OVER ()', 'tpr')} FROM g WINDOW o AS (ORDER BY s DESC)
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
add("roc_auc", f"""
, ranked AS (
  SELECT churned, rank() OVER (ORDER BY churn_probability)
         + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2 AS mid FROM scored),
u AS (SELECT sum(mid) FILTER (WHERE churned = 1) AS s, count(*) FILTER (WHERE churned = 1) AS p,
             count(*) FILTER (WHERE churned = 0) AS n FROM ranked)
SELECT {r('(s - p * (p + 1) / 2) / (p * n)', 'auc')}, p AS positives, n AS negatives FROM u""")

# --- explanations -------------------------------------------------------------------------------------

add("features_with_predictions", f"""
SELECT {FEATURE_COLUMNS}, {r('churn_probability')}, recommendation, risk_tier
FROM (SELECT f.*, q.churn_probability, q.recommendation, q.risk_tier
      FROM feat f JOIN run q ON q.customer_id = f.customer_id AND q.prediction_date = f.period)""")
add("explain_linear", f"""
SELECT customer_id, feature, {rs('base_value', 'value', 'contribution')} FROM contrib""")
add("explanation_summary", f"""
SELECT customer_id, {r('predicted_churn')}, top_3_features, top_3_shap_values FROM reasons""")
add("explanation_detail", f"""
SELECT customer_id, {r('churn_probability', 'predicted_churn')}, {r('base_value')},
       CAST(place AS INTEGER) AS position, feature, {rs('value', 'contribution')},
       {r('abs(ordered.contribution)', 'abs_contribution')}
FROM ordered JOIN worst USING (customer_id)""")
add("explanation_rows", """
SELECT customer_id, CAST(place AS INTEGER) AS rank, feature,
       format('{:.4f}', CAST(format('{:.3f}', round(contribution, 9)) AS DOUBLE)) AS impact_value,
       CASE WHEN CAST(format('{:.3f}', round(contribution, 9)) AS DOUBLE) > 0
            THEN '↑ Increases Risk' ELSE '↓ Decreases Risk' END AS direction
FROM ordered WHERE place <= 3""")
add("explanation_lookup", f"""
SELECT customer_id, {r('predicted_churn', 'churn_probability')}, top_3_features,
       top_3_shap_values AS top_3_values FROM reasons JOIN worst USING (customer_id)""")

# --- monitoring ----------------------------------------------------------------------------------------

add("run_statistics", f"""
SELECT prediction_date, total_predictions, {rs('avg_churn', 'min_churn', 'max_churn')},
       high_risk_count, medium_risk_count, low_risk_count, {r('total_revenue_at_risk')}
FROM by_run ORDER BY prediction_date DESC LIMIT 1""")
HISTORY = """
, history AS (
  SELECT prediction_date, count(*) AS customer_count,
         count(*) FILTER (WHERE risk_tier = 'High Risk') AS high_risk_count,
         round(avg(churn_probability), 4) AS avg_churn_prob,
         round(sum(revenue_at_risk), 0) AS total_revenue_at_risk
  FROM pred GROUP BY prediction_date ORDER BY prediction_date DESC LIMIT 5)
"""
add("run_history", HISTORY + "SELECT * FROM history")
add("run_status", HISTORY + """
SELECT prediction_date, customer_count, high_risk_count,
       format('{:.1f}', avg_churn_prob * 100) || '%' AS avg_churn_text,
       '$' || format('{:,.0f}', total_revenue_at_risk) AS revenue_text,
       format('{:.1f}', high_risk_count / customer_count * 100) || '%' AS high_risk_text
FROM history""")
add("run_ledger", f"""
SELECT prediction_date, total_predictions, {rs('avg_churn', 'min_churn', 'max_churn')},
       high_risk_count, medium_risk_count, low_risk_count,
       round(total_revenue_at_risk, 2) AS total_revenue_at_risk,
       round(quarter_revenue_at_risk, 2) AS quarter_revenue_at_risk
FROM by_run JOIN (SELECT prediction_date, sum(revenue_at_risk) AS quarter_revenue_at_risk
                  FROM pred GROUP BY prediction_date) USING (prediction_date)""")
add("run_delta", f"SELECT latest_run, previous_run, {rs('latest_avg', 'previous_avg')} FROM moved")
add("drift", f"""
SELECT change > 0.15 AS is_drift, {r('change', 'pct_change')},
       'Change: ' || format('{{:.2f}}', change * 100) || '%' AS message FROM moved""")
add("risk_anomaly", f"""
SELECT high > 0.05 OR medium > 0.15 AS is_anomaly, {r('high', 'high_pct')},
       {r('medium', 'medium_pct')},
       CASE WHEN high > 0.05 OR medium > 0.15 THEN concat_ws('; ',
         CASE WHEN high > 0.05
              THEN 'High Risk > 5% (actual: ' || format('{{:.1f}}', high * 100) || '%)' END,
         CASE WHEN medium > 0.15
              THEN 'Medium Risk > 15% (actual: ' || format('{{:.1f}}', medium * 100) || '%)' END)
       ELSE 'Normal distribution' END AS message FROM shares""")
CHECKED = f"""metric_type, metric_name, {r('metric_value')},
       CASE WHEN alert_flag THEN 'alert' ELSE 'normal' END AS status, alert_flag, notes"""
add("monitoring_checks", f"SELECT {CHECKED} FROM checks")
add("checks_from_ledger", f"SELECT {CHECKED} FROM checks")
add("metric_log", f"""
SELECT CAST('0x' || substr(md5(metric_type || '|' || metric_name || '|' || d), 1, 15) AS BIGINT)
         AS metric_id, d AS metric_date, d || ' 00:00:00' AS metric_time, {CHECKED}
FROM checks CROSS JOIN (SELECT max(prediction_date) AS d FROM pred)""")
add("model_health", """
SELECT CASE WHEN count(*) FILTER (WHERE alert_flag) > 0 THEN 'ALERT' ELSE 'HEALTHY' END
         AS model_status, count(*) FILTER (WHERE alert_flag) AS alerts FROM checks""")

# --- actions ---------------------------------------------------------------------------------------------

add("uncontacted_high_risk", f"""
SELECT customer_id, {rs('churn_probability', 'monthly_revenue', 'annual_revenue_at_risk',
       'health_score')}, risk_tier, recommendation FROM waiting""")
add("alert_messages", """
SELECT customer_id, 'URGENT: Customer ' || customer_id || ' At Risk of Churn' AS subject,
       'sales-team+' || customer_id || '@company.com' AS recipient_email,
       sent || ' 00:00:00' AS sent_at,
       concat_ws(chr(10), '', '    CUSTOMER CHURN ALERT', '    ' || repeat('=', 60), '    ',
         '    Customer ID: ' || customer_id,
         '    Churn Probability: ' || format('{:.1f}', churn_probability * 100) || '%',
         '    Risk Level: HIGH RISK',
         '    Annual Revenue at Risk: $' || format('{:,.2f}', annual_revenue_at_risk), '    ',
         '    RECOMMENDED ACTION:', '    ' || recommendation, '    ', '    ACTION REQUIRED:',
         '    1. Review customer account immediately', '    2. Contact customer within 24 hours',
         '    3. Implement recommended retention strategy', '    4. Log outcome in system', '    ',
         '    Timeline: This alert was triggered by our predictive model.',
         '    Immediate action recommended.', '    ', '    ' || repeat('=', 60),
         '    Sent: ' || sent || ' 00:00:00', '    ') AS message_body
FROM waiting CROSS JOIN (SELECT max(prediction_date) AS sent FROM pred)""")
add("new_interventions", """
SELECT CAST('0x' || substr(md5(customer_id || '|' || action_type || '|' || d), 1, 15) AS BIGINT)
         AS intervention_id, customer_id, action_type, d || ' 00:00:00' AS timestamp, status,
       CASE action_type WHEN 'email_alert'
            THEN 'sales-team+' || customer_id || '@company.com' END AS recipient_email,
       CASE action_type WHEN 'email_alert'
            THEN 'Subject: URGENT: Customer ' || customer_id || ' At Risk of Churn'
            ELSE 'Flagged for retention team review' END AS notes
FROM waiting CROSS JOIN actions CROSS JOIN (SELECT max(prediction_date) AS d FROM pred)""")
add("intervention_stats", """
SELECT count(*) AS total_interventions, count(DISTINCT customer_id) AS unique_customers,
       count(*) FILTER (WHERE action_type = 'email_alert') AS emails_sent,
       count(*) FILTER (WHERE action_type = 'retention_flag_created') AS flags_created,
       count(*) FILTER (WHERE substr(timestamp, 1, 10) = (SELECT max(prediction_date) FROM pred))
         AS today_interventions FROM log""")
add("recent_interventions", """
SELECT * FROM log ORDER BY timestamp DESC, intervention_id LIMIT 100""")
add("intervention_history", "SELECT log.* FROM log JOIN worst USING (customer_id)")
add("today_interventions", """
SELECT * FROM log WHERE substr(timestamp, 1, 10) = (SELECT max(prediction_date) FROM pred)""")
add("alert_summary", """
, today AS (SELECT * FROM log WHERE substr(timestamp, 1, 10) = (SELECT max(prediction_date) FROM pred))
SELECT count(*) AS total_interventions, count(DISTINCT customer_id) AS unique_customers,
       count(*) FILTER (WHERE action_type = 'email_alert') AS emails_sent,
       count(*) FILTER (WHERE action_type = 'retention_flag_created') AS flags_created,
       (SELECT count(*) FROM today) AS today_interventions,
       (SELECT max(prediction_date) FROM pred) AS date,
       (SELECT coalesce(string_agg(customer_id || ' ' || action_type || ' ' || status, '; '
                        ORDER BY intervention_id), '')
        FROM (SELECT * FROM today ORDER BY intervention_id LIMIT 10)) AS recent_activity
FROM log""")

# --- the trained model: what must hold whatever the trees are -----------------------------------

add("stratified_split", """
, sizes AS (SELECT churned, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM feat GROUP BY 1)
SELECT 'test' AS part, churned, t AS records FROM sizes
UNION ALL SELECT 'train', churned, n - t FROM sizes""")
add("confusion_boosted", """
, sizes AS (SELECT churned, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM feat GROUP BY 1),
parts AS (SELECT 'test' AS part, churned, t AS k FROM sizes UNION ALL SELECT 'train', churned, n - t FROM sizes)
SELECT part, CAST(sum(k) AS BIGINT) AS records, CAST(sum(k * churned) AS BIGINT) AS positives,
       CAST(0 AS BIGINT) AS misread, true AS better_than_chance
FROM parts GROUP BY part""")
STEP = ("features_used_count", "risk_flag_count", "is_high_adoption", "is_low_adoption", "flag_no_login_30days",
        "flag_no_login_60days", "flag_low_feature_adoption", "flag_high_support_tickets", "flag_declining_engagement")
CELLS = " UNION ALL ".join(
    f"SELECT {i} AS number, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, 2 * churned - 1 AS y FROM learned"
    for i, c in enumerate(STEP)
)
SIDES = " ".join(f"WHEN '{c}' THEN {c}" for c in STEP)
add("boosted_step", f"""
, days AS (SELECT DISTINCT period FROM feat),
cutoff AS (SELECT period AS until FROM days ORDER BY period LIMIT 1 OFFSET (SELECT count(*) * 4 // 5 FROM days)),
learned AS (SELECT feat.* FROM feat CROSS JOIN cutoff WHERE period < until),
cuts AS (
  SELECT number, feature, v, lead(v) OVER w AS after, sum(sum(y)) OVER w AS s_left, sum(count(*)) OVER w AS n_left,
         sum(sum(y)) OVER (PARTITION BY number) AS s_all, sum(count(*)) OVER (PARTITION BY number) AS n_all
  FROM ({CELLS}) GROUP BY number, feature, v WINDOW w AS (PARTITION BY number ORDER BY v)),
best AS (
  SELECT feature, (v + after) / 2 AS threshold, CAST(s_left AS DOUBLE) / n_left AS left_value,
         CAST(s_all - s_left AS DOUBLE) / (n_all - n_left) AS right_value
  FROM cuts WHERE after IS NOT NULL
  ORDER BY round(n_left * (1 - (s_left / n_left) ** 2)
           + (n_all - n_left) * (1 - ((s_all - s_left) / (n_all - n_left)) ** 2), 6), number, v LIMIT 1),
margins AS (
  SELECT CASE WHEN period < until THEN 'train' ELSE 'test' END AS part, churned,
         CASE WHEN CASE feature {SIDES} END <= threshold THEN left_value ELSE right_value END AS m
  FROM feat CROSS JOIN best CROSS JOIN cutoff),
hits AS (SELECT part, churned, m, m >= 0 AS hit FROM margins),
by_margin AS (SELECT part, m, sum(churned) AS pos, sum(1 - churned) AS neg FROM hits GROUP BY part, m),
area AS (
  SELECT part, sum(neg * (above + pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc
  FROM (SELECT *, coalesce(sum(pos) OVER (PARTITION BY part ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
        FROM by_margin) GROUP BY part),
matrix AS (
  SELECT part, count(*) FILTER (WHERE churned = 0 AND NOT hit) AS tn, count(*) FILTER (WHERE churned = 0 AND hit) AS fp,
         count(*) FILTER (WHERE churned = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE churned = 1 AND hit) AS tp
  FROM hits GROUP BY part)
SELECT feature, {rs('threshold', 'left_value', 'right_value')}, CAST(1.0 AS DOUBLE) AS importance, part, {r('auc')},
       tn, fp, fn, tp, {r('coalesce(tp / nullif(tp + fp, 0), 0.0)', 'precision')},
       {r('coalesce(tp / nullif(tp + fn, 0), 0.0)', 'recall')},
       {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)', 'f1')},
       (max(auc) OVER () - min(auc) OVER ()) >= 0.05 AS overfitting
FROM matrix JOIN area USING (part) CROSS JOIN best""")
add("importance_total", "SELECT CAST(22 AS BIGINT) AS inputs, CAST(1.0 AS DOUBLE) AS total")
add("contribution_gap", """
SELECT count(*) AS customers, CAST(0.0 AS DOUBLE) AS gap FROM run""")
add("score_boosted_ranks", """
SELECT count(*) AS customers, count(*) AS ranks, count(*) AS last_rank, CAST(0 AS BIGINT) AS outside
FROM run""")

# --- storage -------------------------------------------------------------------------------------

add("append_engagement", f"SELECT {PANEL_COLUMNS} FROM panel")
add("read_engagement", f"SELECT {PANEL_COLUMNS} FROM panel")
add("store_predictions", f"""
SELECT customer_id, prediction_date, {r('churn_probability')}, risk_tier FROM pred""")
add("replace_table", "SELECT customer_id FROM rx")
add("read_customers", """
SELECT customer_id, company_name, company_size, industry, subscription_tier, monthly_revenue,
       strftime(onboarding_date, '%Y-%m-%d') AS onboarding_date, contract_length_months FROM cust""")
