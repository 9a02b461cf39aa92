"""Windows over a customer's history, with hand-computed values."""

from __future__ import annotations

import pytest
from conftest import panel_row, rows
from pyspark.sql import functions as F

from holdfast.config import MODEL_FEATURES
from holdfast.operators import features


def months(*logins, customer="A", **other):
    return [
        panel_row(customer, f"2024-{i + 1:02d}", logins_per_day=v, **other)
        for i, v in enumerate(logins)
    ]


@pytest.mark.parametrize("logins, wanted", [
    ((2.0,), 0.0),
    ((2.0, 4.0), 0.5),
    ((2.0, 4.0, 6.0), 1.0),
    ((4.0, 1.0, 1.0, 1.0, 1.0), -0.75),
    ((2.0, 2.0, 2.0, 1.0, 1.0, 1.0), -0.5),
    ((9.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0), -0.5),
    ((0.0, 4.0), 0.0),
    ((None, 4.0), 0.0),
])
def test_login_trend(make_panel, logins, wanted):
    found = features.with_login_trend(make_panel(*months(*logins)))
    assert {r["logins_trend_3m"] for r in found.collect()} == {wanted}


def test_point_in_time_trend_ignores_later_rows(make_panel):
    early = make_panel(*months(2.0, 4.0))
    later = make_panel(*months(2.0, 4.0, 100.0, 100.0))
    first = rows(features.with_login_trend(early, point_in_time=True), "period")
    both = rows(features.with_login_trend(later, point_in_time=True), "period")
    assert [r["logins_trend_3m"] for r in first] == [r["logins_trend_3m"] for r in both[:2]]


def test_rolling_means_and_decay(make_panel):
    given = months(1.0, 2.0, None, 6.0)
    for r, score in zip(given, (50.0, 40.0, None, 45.0)):
        r["engagement_score"] = score
    found = rows(make_panel(*given).withColumns(features.rolling() | features.decay()), "period")
    assert [r["logins_3m_avg"] for r in found] == [1.0, 1.5, 1.5, 4.0]
    assert [r["engagement_decay"] for r in found] == [0.0, -10.0, 0.0, 0.0]


def test_rolling_falls_back_to_raw_value(make_panel):
    found = make_panel(*months(None)).withColumns(features.rolling()).first()
    assert found["logins_3m_avg"] is None


def test_customers_do_not_mix(make_panel):
    panel = make_panel(*months(1.0, 1.0), *months(9.0, 9.0, customer="B"))
    found = panel.withColumns(features.rolling()).groupBy("customer_id").agg(F.max("logins_3m_avg").alias("m"))
    assert {r["customer_id"]: r["m"] for r in found.collect()} == {"A": 1.0, "B": 9.0}


def test_flags_at_their_limits(make_panel):
    panel = make_panel(
        panel_row("A", days_since_last_login=30, features_used_count=3, support_tickets=3),
        panel_row("B", days_since_last_login=60, features_used_count=2, support_tickets=2),
        panel_row("C", days_since_last_login=None, features_used_count=8, support_tickets=None),
    )
    found = {r["customer_id"]: r for r in features.panel_features(panel).collect()}
    names = ("flag_no_login_30days", "flag_no_login_60days", "flag_low_feature_adoption",
             "flag_high_support_tickets", "is_high_adoption", "risk_flag_count")
    assert [found["A"][n] for n in names] == [1, 0, 0, 1, 0, 2]
    assert [found["B"][n] for n in names] == [1, 1, 1, 0, 0, 2]
    assert [found["C"][n] for n in names] == [0, 0, 0, 0, 1, 0]
    assert found["C"]["health_score"] is None


def test_shuffled_input_gives_equal_features(workspace):
    shuffled = workspace.panel.repartition(5, "period")
    again = features.feature_matrix(shuffled, workspace.customers)
    assert again.exceptAll(workspace.features).isEmpty()
    assert workspace.features.exceptAll(again).isEmpty()


def test_29_columns_and_22_inputs(workspace):
    assert len(workspace.features.columns) == 29
    assert features.model_columns(workspace.features) == list(MODEL_FEATURES)
    assert len(MODEL_FEATURES) == 22


def test_missing_inputs_are_named(workspace):
    part = workspace.features.drop("health_score", "api_calls")
    with pytest.raises(ValueError, match="api_calls"):
        features.model_columns(part)
    assert len(features.model_columns(part, existing_only=True)) == 20


def test_one_shuffle_for_all_windows(spark):
    """Rolling, trend and decay share one exchange on the customer."""
    panel = spark.createDataFrame([], "customer_id string, period string, logins_per_day double, "
                                  "api_calls long, features_used_count int, engagement_score double, "
                                  "days_since_last_login int, support_tickets int, churned int")
    plan = features.panel_features(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
