"""What the daily job must remember of each customer, updated from new periods only.

Features of the latest period look back over a few rows, the number of rows and the first
one; a journey needs the first period at risk besides. One row per customer holds that, so a
day costs one new period and one join, whatever the length of the history. A late row, of a
period that the state has passed, makes the state of its customer wrong, and of no other: that
customer's state is built anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.config import DEFAULT, Settings
from holdfast.operators import features, journeys

ROW = ("period", *[c for c in schemas.ENGAGEMENT.fieldNames() if c not in ("customer_id", "period")])


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)


def build(panel: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """State of every customer in these rows. A list has one entry per period: the calendar bounds it."""
    rows = F.sort_array(F.collect_list(F.struct(*ROW, "risk")))
    told = journeys.with_phases(panel).groupBy("customer_id").agg(rows.alias("rows"))
    at_risk = F.transform("rows", lambda r: F.coalesce(r["risk"].isin(*journeys.AT_RISK), F.lit(False)))
    first = F.nullif(F.array_position(at_risk, True), F.lit(0).cast("long"))
    bare = F.transform("rows", lambda r: r.dropFields("risk"))
    return told.withColumn("first_risk_row", first).select(
        "customer_id",
        _last(bare, 2 * cfg.window_rows).alias("recent"),
        F.size("rows").cast("long").alias("history"),
        F.get("rows", F.lit(0))["logins_per_day"].alias("oldest_logins"),
        "first_risk_row",
        F.get("rows", (F.col("first_risk_row") - 1).cast("int"))["period"].alias("first_risk_period"),
    )


def extend(state: DataFrame, newer: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The state with rows added whose periods all follow those it has."""
    old, new = state.alias("o"), build(newer, cfg).alias("n")
    known = F.col("o.history").isNotNull()
    before = F.coalesce("o.history", F.lit(0))
    nothing = F.array().cast(state.schema["recent"].dataType)
    both = old.join(new, F.col("o.customer_id").eqNullSafe(F.col("n.customer_id")), "full")
    return both.select(
        F.coalesce("o.customer_id", "n.customer_id").alias("customer_id"),
        _last(F.concat(F.coalesce("o.recent", nothing), F.coalesce("n.recent", nothing)), 2 * cfg.window_rows)
        .alias("recent"),
        (before + F.coalesce("n.history", F.lit(0))).alias("history"),
        F.when(known, F.col("o.oldest_logins")).otherwise(F.col("n.oldest_logins")).alias("oldest_logins"),
        F.coalesce("o.first_risk_row", before + F.col("n.first_risk_row")).alias("first_risk_row"),
        F.coalesce("o.first_risk_period", "n.first_risk_period").alias("first_risk_period"),
    )


def continued(state: DataFrame, newer: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """As ``extend``, in two frames: customers of the state, and those who are new.

    Customers without an id are refused at ingestion, so the joins are plain. They keep the layout of the
    state: when both sides are bucketed by customer there is no shuffle.
    """
    arrived = build(newer, cfg)
    renamed = arrived.select(*[F.col(c).alias(f"new_{c}") for c in arrived.columns])
    both = state.join(renamed, state["customer_id"] == F.col("new_customer_id"), "left")
    nothing = F.array().cast(state.schema["recent"].dataType)
    known = both.select(
        "customer_id",
        _last(F.concat("recent", F.coalesce("new_recent", nothing)), 2 * cfg.window_rows).alias("recent"),
        (F.col("history") + F.coalesce("new_history", F.lit(0))).alias("history"),
        "oldest_logins",
        F.coalesce("first_risk_row", F.col("history") + F.col("new_first_risk_row")).alias("first_risk_row"),
        F.coalesce("first_risk_period", "new_first_risk_period").alias("first_risk_period"),
    )
    return known, arrived.join(state.select("customer_id"), "customer_id", "left_anti")


def repaired(state: DataFrame, late: DataFrame, history: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """State of the customers without late rows, as it is, and of those with some, from their history."""
    touched = late.select("customer_id").distinct()
    again = build(history.join(touched, "customer_id", "left_semi"), cfg)
    return state.join(touched, "customer_id", "left_anti"), again


def latest_features(
    state: DataFrame, customers: DataFrame, latest: str, cfg: Settings = DEFAULT
) -> DataFrame:
    """The feature matrix of the latest period, from the remembered rows."""
    here = state.where(F.element_at("recent", -1)["period"] == latest)
    first = F.col("history") - F.size("recent") + 1
    rows = here.select(
        "customer_id", "history", "oldest_logins", first.alias("first"), F.posexplode("recent").alias("at", "r")
    ).select(
        "customer_id", "r.*", (F.col("first") + F.col("at")).alias("_number"),
        F.col("history").alias("_history"), F.col("oldest_logins").alias("_oldest"),
    )
    told = features.features_of_last_rows(features.enrich(rows, customers), cfg)
    return told.where(F.col("period") == latest).select(*features.FEATURE_COLUMNS)


def journey_summary(state: DataFrame) -> DataFrame:
    """As ``journeys.summary`` of all rows, from the state."""
    last = state.select("*", F.element_at("recent", -1).alias("r")).select(
        "customer_id", "history", "first_risk_row", "first_risk_period", "r.*"
    )
    return journeys.with_phases(last).select(
        "customer_id",
        F.col("phase").alias("current_phase"),
        F.col("risk").alias("current_risk"),
        F.col("health").alias("current_health"),
        F.coalesce(F.col("churned") == 1, F.lit(False)).alias("churned"),
        F.col("first_risk_period").alias("first_at_risk_month"),
        (F.col("history") - F.col("first_risk_row") + 1).cast("int").alias("months_until_churn"),
        F.col("history").cast("int").alias("total_months_observed"),
    )
