"""Customer journeys: phase of every period, turning points, one summary per customer.

Windows and the summary share the partitioning by customer, so a journey job has
one shuffle. A group is one customer's periods, bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.columns import journey_phase, journey_risk
from holdfast.operators.features import in_time

AT_RISK = ("Critical", "High")


def with_phases(panel: DataFrame) -> DataFrame:
    logins, features = F.col("logins_per_day"), F.col("features_used_count")
    engagement = F.col("engagement_score")
    state = journey_phase(logins, F.col("days_since_last_login"), engagement, features)
    return panel.withColumns({
        "_state": state,
        "risk": journey_risk(F.col("churned"), logins, features, engagement),
    }).withColumns({"phase": F.col("_state.phase"), "health": F.col("_state.health")}).drop("_state")


def timeline(panel: DataFrame) -> DataFrame:
    """One row per customer and period; ``phase_changed`` is 1 on the first row too."""
    changed = F.col("phase") != F.lag("phase").over(in_time())
    return with_phases(panel).select(
        "customer_id",
        "period",
        "logins_per_day",
        F.col("features_used_count").alias("features_used"),
        "engagement_score",
        F.col("days_since_last_login").alias("days_inactive"),
        "support_tickets",
        "phase",
        "health",
        "risk",
        "churned",
        F.coalesce(changed, F.lit(True)).cast("int").alias("phase_changed"),
    )


def inflections(panel: DataFrame) -> DataFrame:
    return timeline(panel).where(F.col("phase_changed") == 1)


def summary(panel: DataFrame) -> DataFrame:
    """Current state, first period at risk and length of each customer's journey.

    ``months_until_churn`` counts the rows from the first one at risk to the end
    of the history, whether or not the customer churns.
    """
    numbered = with_phases(panel).withColumn("_row", F.row_number().over(in_time()))
    at_risk = F.col("risk").isin(*AT_RISK)
    first_row = F.min(F.when(at_risk, F.col("_row")))
    last = F.max_by(F.struct("phase", "risk", "health", "churned"), "_row")
    return numbered.groupBy("customer_id").agg(
        last.alias("_last"),
        F.min(F.when(at_risk, F.col("period"))).alias("first_at_risk_month"),
        (F.count("*") - first_row + 1).cast("int").alias("months_until_churn"),
        F.count("*").cast("int").alias("total_months_observed"),
    ).select(
        "customer_id",
        F.col("_last.phase").alias("current_phase"),
        F.col("_last.risk").alias("current_risk"),
        F.col("_last.health").alias("current_health"),
        F.coalesce(F.col("_last.churned") == 1, F.lit(False)).alias("churned"),
        "first_at_risk_month",
        "months_until_churn",
        "total_months_observed",
    )


def statistics(journeys: DataFrame) -> DataFrame:
    return journeys.agg(
        F.count("*").alias("total_customers"),
        F.count_if("churned").alias("churned_customers"),
        F.avg(F.col("churned").cast("int")).alias("churned_share"),
        F.count_if(F.col("current_risk").isin(*AT_RISK)).alias("at_risk_customers"),
    )


def narrative(panel: DataFrame) -> DataFrame:
    """Readable history of each customer: status, turning points, table of periods.

    The list collected per customer has one entry per period, so it is bounded by
    the calendar; everything else is read off that list without another shuffle.
    """
    row = F.struct("period", "phase", "health", "risk", "churned", "phase_changed",
                   "logins_per_day", "features_used", "engagement_score")
    told = timeline(panel).groupBy("customer_id").agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    told = told.withColumns({
        "last": F.element_at("rows", -1),
        "first_risk": F.array_position(F.transform("rows", lambda r: r["risk"].isin(*AT_RISK)), True),
    })
    at_risk = F.col("first_risk") > 0
    first = F.get("rows", (F.col("first_risk") - 1).cast("int"))["period"]
    remaining = F.size("rows") - F.col("first_risk") + 1
    status = F.concat_ws(
        "\n",
        F.concat(F.lit("CUSTOMER "), F.col("customer_id").cast("string"), F.lit(" JOURNEY ANALYSIS")),
        F.concat(F.lit("Phase: "), F.col("last.phase")),
        F.concat(F.lit("Health: "), F.col("last.health")),
        F.concat(F.lit("Risk Level: "), F.col("last.risk")),
        F.concat(F.lit("Churned: "), F.when(F.col("last.churned") == 1, "Yes").otherwise("No")),
        F.concat(F.lit("Total months observed: "), F.size("rows").cast("string")),
        F.concat(F.lit("First at-risk: "), F.when(at_risk, first).otherwise("Never")),
        F.when(at_risk, F.concat(F.lit("Months until churn: "), remaining.cast("string"))),
    )
    turns = F.transform(
        F.filter("rows", lambda r: r["phase_changed"] == 1),
        lambda r: F.concat(r["period"], F.lit(": → "), r["phase"]),
    )
    lines = F.transform(
        "rows",
        lambda r: F.concat_ws(
            " ", r["period"], r["logins_per_day"].cast("string"), r["features_used"].cast("string"),
            r["engagement_score"].cast("string"), r["phase"], r["risk"],
        ),
    )
    told = told.select(
        "customer_id",
        status.alias("status"),
        F.concat_ws("\n", turns).alias("inflection_points"),
        F.concat_ws("\n", lines).alias("detail"),
    )
    whole = F.concat_ws(
        "\n\n",
        "status",
        F.concat(F.lit("Inflection Points:\n"), "inflection_points"),
        F.concat(F.lit("Detailed Journey:\n"), "detail"),
    )
    return told.withColumn("narrative", whole).drop("detail")
