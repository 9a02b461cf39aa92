"""Table schemas, enforced on read and used to create empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("company_name", T.StringType()),
    T.StructField("company_size", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("subscription_tier", T.StringType()),
    T.StructField("monthly_revenue", T.DoubleType()),
    T.StructField("onboarding_date", T.DateType()),
    T.StructField("contract_length_months", T.IntegerType()),
])

ENGAGEMENT = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("period", T.StringType(), False),
    T.StructField("active_users", T.LongType()),
    T.StructField("api_calls", T.LongType()),
    T.StructField("logins_per_day", T.DoubleType()),
    T.StructField("days_since_last_login", T.IntegerType()),
    T.StructField("features_used_count", T.IntegerType()),
    T.StructField("support_tickets", T.IntegerType()),
    T.StructField("engagement_score", T.DoubleType()),
    T.StructField("churned", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("prediction_id", T.LongType()),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("prediction_date", T.StringType(), False),
    T.StructField("churn_probability", T.DoubleType()),
    T.StructField("predicted_churn", T.IntegerType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("health_score", T.DoubleType()),
    T.StructField("monthly_revenue", T.DoubleType()),
    T.StructField("revenue_at_risk", T.DoubleType()),
    T.StructField("annual_revenue_at_risk", T.DoubleType()),
    T.StructField("composite_risk_score", T.DoubleType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("risk_rank", T.LongType()),
    T.StructField("predicted_at", T.TimestampType()),
])

INTERVENTIONS = T.StructType([
    T.StructField("intervention_id", T.LongType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("recipient_email", T.StringType()),
    T.StructField("message_body", T.StringType()),
    T.StructField("notes", T.StringType()),
])

#: As stored: partitioned by the day of the action.
INTERVENTION_LOG = T.StructType([*INTERVENTIONS.fields, T.StructField("log_day", T.StringType())])

MODEL_METRICS = T.StructType([
    T.StructField("metric_id", T.LongType(), False),
    T.StructField("metric_date", T.DateType()),
    T.StructField("metric_time", T.TimestampType()),
    T.StructField("metric_type", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("alert_flag", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])



_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
}


def _of(text: str) -> T.StructType:
    """Columns as "name type", separated by commas; needs no session."""
    named = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


CURRENT_FEATURES = _of("""
    customer_id string, period string, churned int, logins_per_day double, api_calls bigint,
    features_used_count int, days_inactive int, support_tickets int, engagement_score double,
    logins_3m_avg double, api_calls_3m_avg double, features_3m_avg double, logins_trend_3m double,
    engagement_decay double, recency_score double, feature_adoption_rate double,
    is_high_adoption int, is_low_adoption int, flag_no_login_30days int, flag_no_login_60days int,
    flag_low_feature_adoption int, flag_high_support_tickets int, flag_declining_engagement int,
    risk_flag_count int, health_score double, company_size string, subscription_tier string,
    industry string, monthly_revenue double
""")

PRESCRIPTIONS = _of("""
    customer_id string, churn_probability double, current_recommendation string,
    prescribed_action string, action_type string, discount_percent int, action_cost double,
    expected_retention_value double, expected_impact double, roi double, confidence double,
    timing string, rationale string, success_probability double
""")

CUSTOMER_JOURNEYS = _of("""
    customer_id string, current_phase string, current_risk string, current_health string,
    churned boolean, first_at_risk_month string, months_until_churn int, total_months_observed int
""")

EXPLANATIONS = _of("""
    customer_id string, predicted_churn double, top_3_features string, top_3_shap_values string
""")

#: Tables that the daily job derives, by name.
DERIVED = {
    "current_features": CURRENT_FEATURES,
    "prescriptions": PRESCRIPTIONS,
    "customer_journeys": CUSTOMER_JOURNEYS,
    "explanations": EXPLANATIONS,
}

# Columns whose absence must stop an ingestion.
REQUIRED_ENGAGEMENT = tuple(ENGAGEMENT.fieldNames())


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
