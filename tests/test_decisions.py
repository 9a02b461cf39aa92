"""Scoring, prescriptions, journeys, monitoring, explanations and actions."""

from __future__ import annotations

import pytest
from conftest import panel_row, rows
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import (
    actions,
    evaluation,
    explain,
    journeys,
    monitoring,
    scoring,
    serving,
)
from holdfast.operators import prescriptions as rx

def day(text="2024-01-02"):
    return F.lit(text)


# --- prescriptions -------------------------------------------------------------------


@pytest.mark.parametrize("recommendation, p, health, revenue, action, cost, roi", [
    ("Urgent Account Review", 0.8, 30.0, 1000.0, "discount_and_outreach", 200.0, 12.0),
    ("Onboarding Support", 0.75, 45.0, 1000.0, "training", 500.0, 6.0),
    ("Engagement Campaign", 0.5, 45.0, 1000.0, "engagement", 750.0, 8.0),
    ("Executive Check-in", 0.5, 45.0, 5000.0, "executive_outreach", 2000.0, 30.0),
    ("Executive Check-in", 0.5, 45.0, 3000.0, "monitor", 0.0, 0.0),
    ("Urgent Account Review", 0.6, 30.0, 1000.0, "monitor", 0.0, 0.0),
    ("Urgent Account Review", 0.8, 30.0, 0.0, "discount_and_outreach", 0.0, 0.0),
    ("Monitor", 0.1, 90.0, 1000.0, "monitor", 0.0, 0.0),
])
def test_playbooks(make_predictions, recommendation, p, health, revenue, action, cost, roi):
    given = make_predictions(("A", "2024-01", p, "High Risk", revenue, health, recommendation))
    plan = rx.prescribe(given).first()
    assert (plan["action_type"], plan["action_cost"]) == (action, pytest.approx(cost))
    assert plan["roi"] == pytest.approx(roi)
    assert len(plan) == 14


def test_portfolio_of_free_actions_has_no_roi(make_predictions):
    plans = rx.prescribe(make_predictions(("A", "2024-01", 0.1, "Low Risk")))
    assert rx.portfolio_impact(plans).first().asDict() == {
        "total_action_cost": 0.0, "total_expected_impact": 0.0, "portfolio_roi": 0.0,
        "high_roi_actions": 0,
    }


# --- journeys ------------------------------------------------------------------------


def test_journey_summary(make_panel):
    healthy, risky = {"logins_per_day": 2.0}, {"logins_per_day": 0.9, "engagement_score": 30.0}
    panel = make_panel(
        panel_row("A", "2024-01", **healthy), panel_row("A", "2024-02", **risky),
        panel_row("A", "2024-03", **healthy), panel_row("A", "2024-04", churned=1),
        panel_row("B", "2024-01", **healthy), panel_row("C", "2024-01", **risky),
        panel_row("C", "2024-02", **risky),
    )
    found = {r["customer_id"]: r for r in rows(journeys.summary(panel))}
    a, b, c = found["A"], found["B"], found["C"]
    assert (a["current_risk"], a["churned"], a["first_at_risk_month"]) == ("CHURNED", True, "2024-02")
    assert (a["months_until_churn"], a["total_months_observed"]) == (3, 4)
    assert (b["first_at_risk_month"], b["months_until_churn"]) == (None, None)
    assert (c["months_until_churn"], c["current_phase"]) == (2, "Declining")
    turns = rows(journeys.inflections(panel), "customer_id", "period")
    assert [(r["customer_id"], r["period"]) for r in turns] == [
        ("A", "2024-01"), ("A", "2024-02"), ("A", "2024-03"), ("B", "2024-01"), ("C", "2024-01")]


def test_narrative_lists_every_turn(make_panel):
    panel = make_panel(
        panel_row("A", "2024-01"),
        panel_row("A", "2024-02", logins_per_day=0.9, engagement_score=30.0),
    )
    told = journeys.narrative(panel).first()
    assert told["inflection_points"] == "2024-01: → Healthy\n2024-02: → Declining"
    assert "Churned: No" in told["narrative"] and "2024-02 0.9 5 30.0 Declining High" in told["narrative"]


# --- monitoring ------------------------------------------------------------------------


@pytest.mark.parametrize("means, wanted", [
    ((0.2, 0.25), (True, 0.25, "Change: 25.00%")),
    ((0.2, 0.23), (False, 0.15, "Change: 15.00%")),
    ((0.2,), (False, 0.0, "Insufficient historical data (need 2+ runs)")),
    ((0.0, 0.5), (False, 0.0, "Insufficient data for comparison")),
    ((None, 0.5), (False, 0.0, "Insufficient data for comparison")),
    ((), (False, 0.0, "Insufficient historical data (need 2+ runs)")),
])
def test_drift(make_predictions, make_empty_predictions, means, wanted):
    given = [("A", f"2024-0{i + 1}", m, "Low Risk") for i, m in enumerate(means)]
    predictions = make_predictions(*given) if given else make_empty_predictions
    found = monitoring.drift(predictions).first()
    assert (found["is_drift"], found["message"]) == (wanted[0], wanted[2])
    assert found["pct_change"] == pytest.approx(wanted[1])


@pytest.fixture
def make_empty_predictions(spark):
    return schemas.empty(spark, schemas.PREDICTIONS)


def test_anomaly_messages(make_predictions):
    tiers = ["High Risk"] + ["Medium Risk"] * 4 + ["Low Risk"] * 5
    run = [(str(i), "2024-01", 0.5, t) for i, t in enumerate(tiers)]
    found = monitoring.risk_anomaly(make_predictions(*run)).first()
    assert found["is_anomaly"]
    assert found["message"] == (
        "High Risk > 5% (actual: 10.0%); Medium Risk > 15% (actual: 40.0%)")
    calm = make_predictions(("1", "2024-01", 0.1, "Low Risk"))
    assert monitoring.risk_anomaly(calm).first()["message"] == "Normal distribution"


def test_empty_tables_give_zeros(make_empty_predictions, spark):
    kpis = serving.kpi_summary(make_empty_predictions).first().asDict()
    assert set(kpis.values()) == {0}
    checks = rows(monitoring.monitoring_checks(make_empty_predictions), "metric_name")
    assert [c["metric_name"] for c in checks] == ["daily_drift_detection", "high_risk_percentage"]
    assert monitoring.model_health(monitoring.monitoring_checks(make_empty_predictions)).first()[0] == "HEALTHY"
    log = schemas.empty(spark, schemas.INTERVENTIONS)
    assert set(actions.intervention_stats(log, day()).first().asDict().values()) == {0}


# --- actions ----------------------------------------------------------------------------


@pytest.fixture
def run(make_predictions):
    return make_predictions(
        ("A", "2024-01-02", 0.9, "High Risk", 500.0, 20.0, "Urgent Account Review"),
        ("B", "2024-01-02", 0.8, "High Risk", 2500.0, 20.0, "Urgent Account Review"),
        ("C", "2024-01-02", 0.1, "Low Risk"),
        ("A", "2024-01-01", 0.9, "High Risk"),
    )


def test_only_uncontacted_customers_are_alerted(spark, run):
    log = schemas.empty(spark, schemas.INTERVENTIONS)
    first = actions.trigger(run, log, day())
    assert sorted((r["customer_id"], r["action_type"]) for r in first.collect()) == [
        ("A", "email_alert"), ("A", "retention_flag_created"),
        ("B", "email_alert"), ("B", "retention_flag_created")]
    of_a = first.where("customer_id = 'A'")
    second = actions.trigger(run, of_a, day())
    assert {r["customer_id"] for r in second.collect()} == {"B"}
    assert actions.trigger(run, first, day()).isEmpty()
    assert actions.trigger(run, first, F.lit("2024-01-03")).count() == 4


def test_alert_text(run):
    high = run.where("customer_id = 'B'").select(*actions.ALERT_COLUMNS)
    mail = actions.alert_messages(high, day()).first()
    assert mail["subject"] == "URGENT: Customer B At Risk of Churn"
    assert mail["recipient_email"] == "sales-team+B@company.com"
    for part in ("Churn Probability: 80.0%", "Annual Revenue at Risk: $24,000.00",
                 "Urgent Account Review", "Sent: 2024-01-02 00:00:00"):
        assert part in mail["message_body"]


def test_log_queries(spark, run):
    log = actions.trigger(run, schemas.empty(spark, schemas.INTERVENTIONS), day()).persist()
    stats = actions.intervention_stats(log, day()).first()
    assert stats.asDict() == {"total_interventions": 4, "unique_customers": 2, "emails_sent": 2,
                              "flags_created": 2, "today_interventions": 4}
    assert actions.intervention_history(log, "A").count() == 2
    assert actions.today_interventions(log, F.lit("2024-01-03")).isEmpty()
    assert actions.recent_interventions(log, 3).count() == 3
    assert len(actions.alert_summary(log, day(), 3).first()["recent_activity"]) == 3


# --- serving --------------------------------------------------------------------------------


def test_lookup_of_unknown_customer_is_empty(run):
    assert serving.customer_lookup(run, "nobody").isEmpty()
    assert serving.customer_lookup(run, "A").count() == 1


def test_customer_360_without_parts(run):
    plans = rx.prescribe(run.where("customer_id = 'A'"))
    nothing = run.sparkSession.createDataFrame(
        [], "customer_id string, top_3_features string, top_3_shap_values string")
    found = {r["customer_id"]: r for r in serving.customer_360(run, plans, nothing).collect()}
    assert found["C"]["recommendation"] is None and found["C"]["explanation"] is None
    assert found["A"]["prediction"]["churn_probability"] == 0.9


def test_revenue_join_keeps_unknown_customers(spark):
    bare = spark.createDataFrame([("A", 0.5), ("X", 0.1)], "customer_id string, churn_probability double")
    customers = spark.createDataFrame([("A", 100.0)], "customer_id string, monthly_revenue double")
    found = {r["customer_id"]: r for r in scoring.with_revenue(bare, customers).collect()}
    assert found["A"]["annual_revenue_at_risk"] == 600.0
    assert found["X"]["annual_revenue_at_risk"] is None and found["X"]["risk_tier"] == "Low Risk"


# --- invariants on the data ------------------------------------------------------------------


def test_ranks_are_a_permutation_of_each_run(workspace):
    ranked = scoring.with_risk_rank(workspace.predictions)
    per_run = ranked.groupBy("prediction_date").agg(
        F.count("*").alias("n"), F.countDistinct("risk_rank").alias("d"),
        F.min("risk_rank").alias("lo"), F.max("risk_rank").alias("hi"))
    assert all((r["n"], r["lo"]) == (r["d"], 1) and r["hi"] == r["n"] for r in per_run.collect())


def test_contributions_add_up_to_log_odds(workspace):
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    p = F.col("churn_probability")
    gap = F.max(F.abs(F.col("base_value") + total - F.log(p / (1 - p))))
    # Probabilities are kept to nine decimals, so log-odds agree to about 1e-7.
    assert workspace.explained.agg(gap).first()[0] < 1e-6


def test_summary_orders_by_strength(spark):
    parts = [("a", 1.0, 0.5), ("b", 1.0, -2.0), ("c", 1.0, 0.5), ("d", 1.0, 0.1)]
    df = spark.createDataFrame(
        [("A", 0.5, parts)],
        "customer_id string, churn_probability double, "
        "contributions array<struct<feature:string,value:double,contribution:double>>")
    found = explain.summary(df).first()
    assert found["top_3_features"] == "b, a, c"
    assert found["top_3_shap_values"] == "-2.000, 0.500, 0.500"
    taken = rows(explain.rows_of_summary(explain.summary(df)), "rank")
    assert [r["direction"] for r in taken] == [
        "↓ Decreases Risk", "↑ Increases Risk", "↑ Increases Risk"]


# --- evaluation -------------------------------------------------------------------------------


@pytest.fixture
def scored(spark):
    data = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1)]
    df = spark.createDataFrame(data, "churn_probability double, churned int")
    return df.withColumn("predicted_churn", (F.col("churn_probability") > 0.5).cast("int"))


def test_auc_counts_ties_half(scored):
    # Pairs in order: .9 beats 3, .7 beats .2 and half of .7, .1 beats none: 4.5 of 9.
    assert evaluation.roc_auc(scored).first()["auc"] == pytest.approx(4.5 / 9)


def test_roc_curve_points(scored):
    points = rows(evaluation.roc_curve(scored), F.desc("threshold"))
    assert [(round(p["fpr"], 3), round(p["tpr"], 3)) for p in points] == [
        (0.0, 0.0), (0.0, 0.333), (0.333, 0.333), (0.667, 0.667), (1.0, 0.667), (1.0, 1.0)]


def test_confusion(scored):
    found = evaluation.confusion_metrics(scored).first()
    assert (found["tn"], found["fp"], found["fn"], found["tp"]) == (1, 2, 1, 2)
    assert found["precision"] == 0.5


def test_constant_score_falls_in_the_middle_bin(spark):
    same = spark.createDataFrame([(0.4, 0), (0.4, 1)], "churn_probability double, churned int")
    assert [r["bin"] for r in evaluation.calibration_deciles(same).collect()] == [5]
