"""Alerts and retention flags for high-risk customers, and queries on their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import ALERT_BODY, ALERT_RECIPIENT, ALERT_SUBJECT, FLAG_NOTE
from holdfast.functions.columns import decimals, fill_template
from holdfast.operators.monitoring import HIGH, latest_run, stable_id

ALERT_COLUMNS = (
    "customer_id", "churn_probability", "risk_tier", "monthly_revenue",
    "annual_revenue_at_risk", "health_score", "recommendation",
)
LOG_COLUMNS = (
    "intervention_id", "customer_id", "action_type", "timestamp", "status",
    "recipient_email", "notes",
)

#: What makes a row of the log, with its day; ids are for display.
LOG_KEY = ("customer_id", "action_type")


def day_of_log(log: DataFrame, as_of: Column) -> DataFrame:
    """The folder of one day of the stored log."""
    return log.where(F.col("log_day") == F.date_format(as_of.cast("date"), "yyyy-MM-dd"))


def dated(interventions: DataFrame, as_of: Column) -> DataFrame:
    return interventions.where(F.to_date("timestamp") == as_of.cast("date"))


def uncontacted_high_risk(
    run: DataFrame, interventions: DataFrame, as_of: Column
) -> DataFrame:
    """High-risk customers of a run without any action on the given day."""
    contacted = dated(interventions, as_of).select("customer_id").distinct()
    high = run.where(F.col("risk_tier") == HIGH).select(*ALERT_COLUMNS).distinct()
    return high.join(contacted, "customer_id", "left_anti")


def by_revenue(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc_nulls_last("annual_revenue_at_risk"), "customer_id")


def alert_messages(high_risk: DataFrame, as_of: Column) -> DataFrame:
    """Subject, recipient and body of the alert for each customer."""
    customer = F.col("customer_id").cast("string")
    body = fill_template(
        ALERT_BODY,
        customer,
        decimals(F.col("churn_probability") * 100, 1),
        F.format_number("annual_revenue_at_risk", 2),
        F.col("recommendation"),
        F.date_format(as_of.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
    )
    return high_risk.select(
        "customer_id",
        fill_template(ALERT_SUBJECT, customer).alias("subject"),
        fill_template(ALERT_RECIPIENT, customer).alias("recipient_email"),
        body.alias("message_body"),
        as_of.cast("timestamp").alias("sent_at"),
    )


def new_interventions(high_risk: DataFrame, as_of: Column) -> DataFrame:
    """An e-mail row and a flag row per customer, with ids that a repeated run repeats."""
    nothing = F.lit(None).cast("string")
    email = F.struct(
        F.lit("email_alert").alias("action_type"),
        F.lit("sent").alias("status"),
        F.col("recipient_email"),
        F.col("message_body"),
        F.concat(F.lit("Subject: "), F.col("subject")).alias("notes"),
    )
    flagged = F.struct(
        F.lit("retention_flag_created").alias("action_type"),
        F.lit("active").alias("status"),
        nothing.alias("recipient_email"),
        nothing.alias("message_body"),
        F.lit(FLAG_NOTE).alias("notes"),
    )
    rows = alert_messages(high_risk, as_of).select(
        "customer_id", "sent_at", F.explode(F.array(email, flagged)).alias("a")
    )
    day = F.date_format("sent_at", "yyyy-MM-dd")
    key = F.concat_ws("|", F.col("customer_id").cast("string"), "a.action_type", day)
    return rows.select(
        stable_id(key).alias("intervention_id"),
        "customer_id",
        "a.action_type",
        F.col("sent_at").alias("timestamp"),
        "a.status",
        "a.recipient_email",
        "a.message_body",
        "a.notes",
    )


def trigger(predictions: DataFrame, interventions: DataFrame, as_of: Column) -> DataFrame:
    """The rows to append to the log for the last run; none when all were contacted."""
    waiting = uncontacted_high_risk(latest_run(predictions), interventions, as_of)
    return new_interventions(waiting, as_of)


# --- the log -------------------------------------------------------------------------------


def intervention_stats(interventions: DataFrame, as_of: Column) -> DataFrame:
    kind = F.col("action_type")
    return interventions.agg(
        F.count("*").alias("total_interventions"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.count_if(kind == "email_alert").alias("emails_sent"),
        F.count_if(kind == "retention_flag_created").alias("flags_created"),
        F.count_if(F.to_date("timestamp") == as_of.cast("date")).alias("today_interventions"),
    )


def newest_first(interventions: DataFrame) -> DataFrame:
    return interventions.select(*LOG_COLUMNS).orderBy(F.desc("timestamp"), "intervention_id")


def recent_interventions(interventions: DataFrame, limit: int = 100) -> DataFrame:
    return newest_first(interventions).limit(limit)


def intervention_history(interventions: DataFrame, customer_id) -> DataFrame:
    return newest_first(interventions.where(F.col("customer_id") == customer_id))


def today_interventions(interventions: DataFrame, as_of: Column) -> DataFrame:
    return newest_first(dated(interventions, as_of))


def alert_summary(interventions: DataFrame, as_of: Column, recent: int = 10) -> DataFrame:
    """Totals of the log with the last actions of the day as an ordered list."""
    latest = today_interventions(interventions, as_of).limit(recent)
    entry = F.struct(
        F.col("timestamp"), (-F.col("intervention_id")).alias("order"),
        *[c for c in LOG_COLUMNS if c != "timestamp"],
    )
    listed = latest.agg(F.sort_array(F.collect_list(entry), asc=False).alias("recent_activity"))
    return intervention_stats(interventions, as_of).select(
        "*", as_of.cast("date").alias("date"), listed.scalar().alias("recent_activity")
    )
