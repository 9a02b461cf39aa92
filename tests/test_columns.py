"""Column rules at their edges."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from holdfast.functions import columns as C


@pytest.fixture
def apply(spark):
    def run(values, kind, build):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        coalesced = df.coalesce(1)
        return [r["out"] for r in coalesced.select(build(F.col("v")).alias("out")).collect()]

    return run


def test_clip_keeps_null(apply):
    assert apply([None, -1.0, 0.5, 9.0], "double", lambda v: C.clip(v, 0.0, 1.0)) == [None, 0, .5, 1]


def test_recency_bins_are_right_closed(apply):
    found = apply([0, 1, 7, 8, 14, 30, 60, 61, 365, 366, None], "int", C.recency_category)
    assert found == [
        None, "0-7 days", "0-7 days", "7-14 days", "7-14 days", "14-30 days", "30-60 days",
        "60+ days", "60+ days", None, None,
    ]


def test_recency_score(apply):
    assert apply([0, 30, 60, 90, None], "int", C.recency_score) == [1.0, 0.5, 0.0, 0.0, None]


def test_model_tiers(apply):
    found = apply([0.0, 0.3, 0.31, 0.6, 0.61, 1.0, 1.1, None], "double", C.risk_tier_model)
    assert found == [
        None, "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk", None, None,
    ]


def test_business_tiers(apply):
    found = apply([0.0, 0.2, 0.4, None, float("nan")], "double", C.risk_tier_business)
    assert found == ["Low Risk", "Medium Risk", "High Risk", "High Risk", "High Risk"]


@pytest.mark.parametrize("p, health, wanted", [
    (0.61, 39.9, "Urgent Account Review"),
    (0.61, 40.0, "Onboarding Support"),
    (0.61, 50.0, "Engagement Campaign"),
    (0.6, 10.0, "Engagement Campaign"),
    (0.5, 10.0, "Executive Check-in"),
    (0.3, 10.0, "Monitor"),
    (None, 10.0, "Monitor"),
    (0.7, None, "Engagement Campaign"),
])
def test_recommendation(spark, p, health, wanted):
    df = spark.createDataFrame([(p, health)], "p double, h double")
    assert df.select(C.recommendation(F.col("p"), F.col("h"))).first()[0] == wanted


def test_predicted_churn_is_strict(apply):
    assert apply([0.5, 0.51, None], "double", C.predicted_churn) == [0, 1, 0]


def test_risk_segment(apply):
    found = apply([0, 1, 2, 3, 4], "int", C.risk_segment)
    assert found == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk"]


def test_health_score_literal_and_corrected(spark):
    df = spark.createDataFrame([(1.0, 0.5, -20.0, 2), (0.0, 0.0, 0.0, 5)],
                               "r double, a double, d double, t int").coalesce(1)
    args = (F.col("r"), F.col("a"), F.col("d"), F.col("t"))
    literal = [r[0] for r in df.select(C.health_score(*args)).collect()]
    # 25 + 12.5 + 30 + (1 - 10) and 0 + 0 + 25 + (1 - 25)
    assert literal == [58.5, 1.0]
    corrected = [r[0] for r in df.select(C.health_score(*args, corrected=True)).collect()]
    assert corrected == [72.5, 25.0]


def test_text_formats(apply):
    assert apply([0.125, 1234.5, -0.0001], "double", lambda v: C.decimals(v, 2)) == [
        "0.12", "1234.50", "-0.00"]
    assert apply([0.1234], "double", C.percent) == ["12.3%"]
    assert apply([1234567.0], "double", C.money) == ["$1,234,567"]


def test_template_slots_must_match(spark):
    with pytest.raises(ValueError, match="1 slots"):
        C.fill_template("a {} b", F.lit(1), F.lit(2))


def test_journey_rules(spark):
    cases = [
        (0.4, 31, 80.0, 9, 0, "Disengaged", "Critical", "Critical"),
        (0.4, 30, 39.0, 9, 0, "Declining", "Warning", "Critical"),
        (0.9, 31, 39.0, 9, 0, "Declining", "Warning", "High"),
        (1.0, 31, 39.0, 2, 0, "Low Adoption", "At Risk", "High"),
        (1.0, 31, 49.0, 3, 0, "Moderate", "Monitor", "Medium"),
        (1.0, 31, 50.0, 3, 0, "Healthy", "Good", "Low"),
        (1.0, 31, 50.0, 3, 1, "Healthy", "Good", "CHURNED"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)],
        "i int, l double, d int, e double, f int, c int",
    )
    l, d, e, f, c = (F.col(x) for x in "ldefc")
    out = df.select("i", C.journey_phase(l, d, e, f).alias("s"), C.journey_risk(c, l, f, e).alias("r"))
    found = [(r["s"]["phase"], r["s"]["health"], r["r"]) for r in rows(out, "i")]
    assert found == [case[5:] for case in cases]
