"""The tables of a retention analysis, derived lazily from one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import TIER_PRICES
from holdfast.operators import actions, explain, features, journeys, monitoring, scoring
from holdfast.operators import prescriptions as rx
from holdfast.sources import activity, tables


class Workspace:
    """Each property is an unexecuted plan; only the ``stored_`` ones run a job,
    for queries that scan their input several times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return activity.read(self.spark, self.sf_dir, "events")

    @cached_property
    def panel(self) -> DataFrame:
        return activity.engagement_panel(self.events)

    @cached_property
    def customers(self) -> DataFrame:
        return activity.customers(self.spark, self.sf_dir)

    @cached_property
    def enriched(self) -> DataFrame:
        return features.enrich(self.panel, self.customers)

    @cached_property
    def features(self) -> DataFrame:
        return features.feature_matrix(self.panel, self.customers)

    @cached_property
    def as_of(self) -> Column:
        """Day of the last run: the greatest day seen in the events."""
        day = F.date_format(F.to_date(F.max("ts")), "yyyy-MM-dd")
        return self.events.agg(day.alias("as_of")).scalar()

    @cached_property
    def predictions(self) -> DataFrame:
        """Scorecard predictions of every period: one run per period."""
        return scoring.predict(self.features, scoring.scorecard())

    @cached_property
    def run(self) -> DataFrame:
        return self.predictions.where(F.col("prediction_date") == self.as_of)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score_all_periods(self.features, scoring.scorecard())

    @cached_property
    def stored_features(self) -> DataFrame:
        return tables.stored(self.features, "features")

    @cached_property
    def stored_predictions(self) -> DataFrame:
        return tables.stored(self.predictions, "predictions")

    @cached_property
    def stored_run(self) -> DataFrame:
        return monitoring.latest_run(self.stored_predictions)

    @cached_property
    def stored_scores(self) -> DataFrame:
        return tables.stored(self.scored.select("churned", "churn_probability"), "scores")

    @cached_property
    def current_features(self) -> DataFrame:
        """Stored features of the last period: the daily job works on these."""
        return tables.stored(features.latest_period(self.features), "current-features")

    @cached_property
    def current_run(self) -> DataFrame:
        return scoring.predict(self.current_features, scoring.scorecard())

    @cached_property
    def prescriptions(self) -> DataFrame:
        return rx.prescribe(self.run)

    @cached_property
    def journeys(self) -> DataFrame:
        return journeys.summary(self.panel)

    @cached_property
    def explained(self) -> DataFrame:
        rows = explain.features_with_predictions(self.current_features, self.current_run)
        return explain.explain_linear(rows, keep=("customer_id", "churn_probability"))

    @cached_property
    def explanations(self) -> DataFrame:
        return explain.summary(self.explained)

    @cached_property
    def interventions(self) -> DataFrame:
        """A log in mid-day: every earlier run is dealt with, and of the last run
        the accounts on the most expensive plan."""
        high = self.stored_predictions.where(F.col("risk_tier") == monitoring.HIGH)
        earlier = F.col("prediction_date") < self.as_of
        first = F.col("monthly_revenue") >= max(TIER_PRICES.values())
        return actions.new_interventions(high.where(earlier | first), F.col("prediction_date"))
