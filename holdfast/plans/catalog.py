"""Every operator as a named query over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import columns as C
from holdfast.operators import (
    actions,
    eda,
    evaluation,
    explain,
    features,
    journeys,
    monitoring,
    rank,
    scores,
    scoring,
    serving,
    stats,
)
from holdfast.operators import prescriptions as rx
from holdfast.plans import training
from holdfast.plans.pipeline import RetentionJob
from holdfast.plans.workspace import Workspace
from holdfast.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}
BUILDERS: dict[str, Callable[[Workspace], DataFrame]] = {}
KEY = ("customer_id", "period")


def query(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Register a query under its function name; doubles are shown with six decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(build(Workspace(spark, sf_dir)))

    CATALOG[build.__name__] = run
    BUILDERS[build.__name__] = build
    return build


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded, timestamps and dates as text, for comparison across engines."""
    shown = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            shown[f.name] = F.round(F.col(f.name) * 1e6) / 1e6
        elif isinstance(f.dataType, T.TimestampType):
            shown[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            shown[f.name] = F.date_format(f.name, "yyyy-MM-dd")
    return df.withColumns(shown)


# --- ingestion -----------------------------------------------------------------------


@query
def ingest_dedup(w: Workspace) -> DataFrame:
    """Rows of churned periods arrive twice, the second time corrected; the first wins."""
    resent = w.panel.where(F.col("churned") == 1).withColumn("api_calls", F.col("api_calls") + 1)
    arrived = w.panel.withColumn("seq", F.lit(0)).unionByName(resent.withColumn("seq", F.lit(1)))
    kept = tables.dedup_first(arrived, KEY, F.col("seq"))
    return kept.select(*KEY, "api_calls", "churned", "seq")


@query
def duplicate_count(w: Workspace) -> DataFrame:
    resent = w.panel.where(F.col("churned") == 1)
    return tables.duplicate_count(w.panel.unionByName(resent), KEY)


@query
def panel_union(w: Workspace) -> DataFrame:
    """The last period, exported as CSV and read back by name, appended to the stored earlier ones."""
    latest, path = tables.latest_value(w.panel, "period"), _folder(w, "union")
    tables.export_csv(w.panel.where(F.col("period") == latest), f"{path}/arrived")
    tables.replace_table(w.panel.where(F.col("period") < latest), f"{path}/stored")
    arrived = tables.read_engagement(w.spark, f"{path}/arrived")
    stored = w.spark.read.schema(w.panel.schema).parquet(f"{path}/stored")
    return stored.unionByName(arrived.withColumn("customer_id", F.col("customer_id").cast("bigint")))


# --- storage: every write is made twice and read back ------------------------------------


def _folder(w: Workspace, name: str) -> str:
    return tables.temporary_folder(w.spark, name)


@query
def append_engagement(w: Workspace) -> DataFrame:
    """The panel appended twice, the second time after its last period is already there."""
    path = _folder(w, "append")
    latest = tables.latest_value(w.panel, "period")
    tables.append_engagement(w.spark, w.panel.where(F.col("period") == latest), path)
    for _ in range(2):
        tables.append_engagement(w.spark, w.panel, path)
    return w.spark.read.schema(w.panel.schema).parquet(path)


@query
def repaired_state(w: Workspace) -> DataFrame:
    """Journeys from the daily state, after a third of the customers' rows of one period arrived late."""
    job = RetentionJob(w.spark, _folder(w, "repaired"))
    job.load_customers(w.customers)
    days = [r["period"] for r in w.panel.select("period").distinct().orderBy("period").collect()]
    late = (F.col("period") == days[len(days) // 2]) & (F.col("customer_id") % 3 == 0)
    job.add_engagement(w.panel.where(~late & (F.col("period") < days[-1])))
    job.update_state()
    job.add_engagement(w.panel)
    job.update_state()
    job.journeys()
    return job.read("customer_journeys")


@query
def store_predictions(w: Workspace) -> DataFrame:
    """All runs stored, then the last one again."""
    path = _folder(w, "store")
    tables.store_predictions(w.spark, w.predictions, path)
    tables.store_predictions(w.spark, w.run, path)
    return w.spark.read.schema(w.predictions.schema).parquet(path).select(
        "customer_id", "prediction_date", "churn_probability", "risk_tier"
    )


@query
def read_customers(w: Workspace) -> DataFrame:
    """Customers exported twice as CSV with reversed columns and read back by name."""
    path = _folder(w, "customers")
    for _ in range(2):
        tables.export_csv(w.customers.select(*reversed(w.customers.columns)), path)
    found = tables.read_customers(w.spark, path)
    return found.withColumn("customer_id", F.col("customer_id").cast("bigint"))


@query
def read_engagement(w: Workspace) -> DataFrame:
    """The panel from two CSV folders of different column orders and names, duplicates dropped."""
    path = _folder(w, "engagement")
    arrived = w.panel.withColumnRenamed("period", "year_month").withColumn("note", F.lit("a, b"))
    tables.export_csv(arrived, f"{path}/1")
    tables.export_csv(w.panel.select(*reversed(w.panel.columns)), f"{path}/2")
    found = tables.read_new_engagement(w.spark, [f"{path}/1", f"{path}/2"])
    return found.select(*[F.col(f.name).cast(f.dataType) for f in w.panel.schema])


@query
def replace_table(w: Workspace) -> DataFrame:
    path = _folder(w, "replace")
    for part in (w.run, w.prescriptions, w.prescriptions):
        tables.replace_table(part.select("customer_id"), path)
    return w.spark.read.parquet(path)


@query
def period_max_users(w: Workspace) -> DataFrame:
    return scores.with_period_max(w.panel).select(*KEY, "active_users", "peak_users")


@query
def engagement_score(w: Workspace) -> DataFrame:
    return scores.with_engagement_score(w.panel.drop("engagement_score")).select(
        *KEY, "engagement_score"
    )


@query
def engagement_enriched(w: Workspace) -> DataFrame:
    return w.enriched


@query
def rate_lookup(w: Workspace) -> DataFrame:
    return scores.with_rates(w.customers).select(
        "customer_id", "list_price", "base_rate", "industry_factor"
    )


@query
def segment_churn_prior(w: Workspace) -> DataFrame:
    return scores.segment_churn_prior(w.customers, w.as_of.cast("date")).select(
        "customer_id", "tenure_months", "churn_prior"
    )


# --- features ---------------------------------------------------------------------------


@query
def rolling_3m(w: Workspace) -> DataFrame:
    return w.panel.withColumns(features.rolling()).select(*KEY, *features.ROLLING)


@query
def login_trend(w: Workspace) -> DataFrame:
    return features.with_login_trend(w.panel).select(*KEY, "logins_trend_3m")


@query
def login_trend_point_in_time(w: Workspace) -> DataFrame:
    return features.with_login_trend(w.panel, point_in_time=True).select(*KEY, "logins_trend_3m")


@query
def engagement_decay(w: Workspace) -> DataFrame:
    return w.panel.withColumns(features.decay()).select(*KEY, "engagement_decay")


@query
def recency_features(w: Workspace) -> DataFrame:
    return w.panel.withColumns(features.recency()).select(
        *KEY, "days_inactive", "recency_category", "recency_score"
    )


@query
def adoption_features(w: Workspace) -> DataFrame:
    return w.panel.withColumns(features.adoption()).select(
        *KEY, "feature_adoption_rate", "is_high_adoption", "is_low_adoption"
    )


@query
def risk_flags(w: Workspace) -> DataFrame:
    return w.features.select(*KEY, "flag_no_login_60days", *features.RISK_FLAGS)


@query
def risk_flag_count(w: Workspace) -> DataFrame:
    return w.features.select(*KEY, "risk_flag_count")


@query
def health_score(w: Workspace) -> DataFrame:
    return w.features.select(*KEY, "health_score")


@query
def health_score_corrected(w: Workspace) -> DataFrame:
    fixed = features.panel_features(w.panel, corrected_health=True)
    return fixed.select(*KEY, "health_score")


@query
def feature_matrix(w: Workspace) -> DataFrame:
    return w.features


@query
def latest_period(w: Workspace) -> DataFrame:
    return features.latest_period(w.features)


@query
def fill_missing(w: Workspace) -> DataFrame:
    """Three policies side by side on inputs that are unknown for silent periods."""
    known = F.col("active_users") > 0
    calls, logins = F.when(known, F.col("api_calls")), F.when(known, F.col("logins_per_day"))
    gaps = w.panel.select(
        *KEY, "features_used_count", calls.alias("api_calls"), logins.alias("logins_per_day"),
        calls.alias("api_calls_zero"), logins.alias("logins_zero"),
        calls.alias("api_calls_mean"), logins.alias("logins_mean"),
    )
    filled = features.fill_with_zero(gaps, ["api_calls_zero", "logins_zero"])
    filled = features.fill_with_mean(filled, ["api_calls_mean", "logins_mean"])
    return filled.withColumns(features.rolling()).drop(
        "api_calls", "logins_per_day", "features_used_count", "features_3m_avg"
    )


# --- scoring --------------------------------------------------------------------------------


@query
def score_customers(w: Workspace) -> DataFrame:
    return scoring.score_customers(w.current_features, scoring.scorecard())


@query
def score_customers_model_tiers(w: Workspace) -> DataFrame:
    return scoring.score_customers(w.current_features, scoring.scorecard(), tiers="model")


@query
def score_all_periods(w: Workspace) -> DataFrame:
    return w.scored.select(*KEY, "churned", "churn_probability", "predicted_churn", "risk_tier")


@query
def predicted_churn(w: Workspace) -> DataFrame:
    return w.predictions.select("customer_id", "prediction_date", "predicted_churn")


@query
def risk_tier_model(w: Workspace) -> DataFrame:
    tier = C.risk_tier_model(F.col("churn_probability"))
    return w.predictions.select("customer_id", "prediction_date", tier.alias("risk_tier"))


@query
def risk_tier_business(w: Workspace) -> DataFrame:
    tier = C.risk_tier_business(F.col("churn_probability"))
    return w.predictions.select("customer_id", "prediction_date", tier.alias("risk_tier"))


@query
def retier(w: Workspace) -> DataFrame:
    """Stored rows carry model tiers and get business tiers."""
    stored = scoring.predict(w.features, scoring.scorecard(), tiers="model")
    return scoring.retier(stored).select("customer_id", "prediction_date", "risk_tier")


@query
def retier_distribution(w: Workspace) -> DataFrame:
    return serving.value_counts(retier(w), "risk_tier")


@query
def recommendation(w: Workspace) -> DataFrame:
    return w.predictions.select("customer_id", "prediction_date", "recommendation")


@query
def revenue_at_risk(w: Workspace) -> DataFrame:
    return w.predictions.select(
        "customer_id", "prediction_date", "revenue_at_risk", "annual_revenue_at_risk"
    )


@query
def revenue_enriched(w: Workspace) -> DataFrame:
    bare = w.run.select("customer_id", "prediction_date", "churn_probability")
    return scoring.with_revenue(bare, w.customers)


@query
def risk_rank(w: Workspace) -> DataFrame:
    return scoring.with_risk_rank(w.stored_predictions).select(
        "customer_id", "prediction_date", "churn_probability", "risk_rank"
    )


@query
def revenue_rank(w: Workspace) -> DataFrame:
    return scoring.with_revenue_rank(w.stored_predictions).select(
        "customer_id", "prediction_date", "annual_revenue_at_risk", "risk_rank"
    )


@query
def price_rank(w: Workspace) -> DataFrame:
    """Rank of customers by price: three values shared by all rows, ties keep the best place."""
    by = [rank.descending(F.col("monthly_revenue"))]
    ranked = rank.global_rank(w.customers, "price_rank", by, ["customer_id"], ties="min")
    return ranked.select("customer_id", "monthly_revenue", "price_rank")


@query
def revenue_summary(w: Workspace) -> DataFrame:
    return scoring.revenue_summary(w.run)


# --- prescriptions ----------------------------------------------------------------------------


@query
def prescriptions(w: Workspace) -> DataFrame:
    return rx.by_roi(w.prescriptions)


@query
def portfolio_impact(w: Workspace) -> DataFrame:
    return rx.portfolio_impact(w.prescriptions)


@query
def action_breakdown(w: Workspace) -> DataFrame:
    return rx.action_breakdown(w.prescriptions)


@query
def top_roi(w: Workspace) -> DataFrame:
    return serving.top_by(w.prescriptions, "roi", 20).select(
        "customer_id", "prescribed_action", "roi", "confidence", "success_probability"
    )


@query
def prescription_lookup(w: Workspace) -> DataFrame:
    plans = rx.prescribe(w.stored_run)
    return serving.prescription_lookup(plans, serving.top_customer(w.stored_predictions))


# --- journeys ------------------------------------------------------------------------------------


@query
def journey_phase(w: Workspace) -> DataFrame:
    return journeys.with_phases(w.panel).select(*KEY, "phase", "health")


@query
def journey_risk(w: Workspace) -> DataFrame:
    return journeys.with_phases(w.panel).select(*KEY, "risk")


@query
def journey_timeline(w: Workspace) -> DataFrame:
    return journeys.timeline(w.panel)


@query
def journey_inflections(w: Workspace) -> DataFrame:
    return journeys.inflections(w.panel).select(*KEY, "phase", "risk")


@query
def journey_summary(w: Workspace) -> DataFrame:
    return w.journeys


@query
def journey_statistics(w: Workspace) -> DataFrame:
    return journeys.statistics(w.journeys)


@query
def phase_distribution(w: Workspace) -> DataFrame:
    return stats.shares(w.journeys, "current_phase", "customers")


@query
def risk_distribution(w: Workspace) -> DataFrame:
    return stats.shares(w.journeys, "current_risk", "customers")


@query
def journey_narrative(w: Workspace) -> DataFrame:
    return journeys.narrative(w.panel)


# --- serving ---------------------------------------------------------------------------------------


@query
def latest_run(w: Workspace) -> DataFrame:
    return serving.ranked_run(scoring.with_risk_rank(w.stored_predictions)).select(
        "customer_id", "prediction_date", "churn_probability", "risk_tier", "risk_rank"
    )


@query
def customer_lookup(w: Workspace) -> DataFrame:
    runs = w.stored_predictions
    return serving.customer_lookup(runs, serving.top_customer(runs))


@query
def customer_360(w: Workspace) -> DataFrame:
    plans = rx.prescribe(w.current_run)
    return _flat(serving.customer_360(w.current_run, plans, w.explanations))


def _flat(view: DataFrame) -> DataFrame:
    """All thirteen fields of the customers' view, side by side."""
    parts = ("prediction", "recommendation", "explanation")
    fields = [f"{p}.{f.name}" for p in parts for f in view.schema[p].dataType if f.name != "customer_id"]
    return view.select("customer_id", *fields)


@query
def customer_view(w: Workspace) -> DataFrame:
    """The view of the customer most likely to churn, looked up by key in the job's tables."""
    job = RetentionJob(w.spark, _folder(w, "view"))
    job.load_customers(w.customers)
    job.store_runs(w.current_run)
    job.table("prescriptions").replace(rx.prescribe(job.predictions(last=1)))
    job.table("explanations").replace(w.explanations)
    worst = w.spark.range(1).select(serving.top_customer(job.predictions(last=1))).first()[0]
    return _flat(job.customer_view(worst))


@query
def customer_options(w: Workspace) -> DataFrame:
    return serving.customer_options(w.journeys)


@query
def priority_customers(w: Workspace) -> DataFrame:
    return serving.priority_customers(w.run)


@query
def priority_rank(w: Workspace) -> DataFrame:
    top = serving.priority_customers(w.run)
    return serving.priority_rank(top, "annual_revenue_at_risk").select(
        "priority_rank", "customer_id", "annual_revenue_at_risk"
    )


@query
def high_risk_list(w: Workspace) -> DataFrame:
    return serving.high_risk_list(w.stored_predictions)


@query
def high_prob_filter(w: Workspace) -> DataFrame:
    return serving.likely_to_churn(w.predictions)


@query
def display_format(w: Workspace) -> DataFrame:
    return serving.display_table(w.run)


@query
def display_prescriptions(w: Workspace) -> DataFrame:
    return serving.display_prescriptions(w.prescriptions)


@query
def kpi_summary(w: Workspace) -> DataFrame:
    return serving.kpi_summary(w.stored_predictions)


@query
def tier_distribution(w: Workspace) -> DataFrame:
    return serving.value_counts(w.predictions, "risk_tier")


@query
def recommendation_counts(w: Workspace) -> DataFrame:
    return serving.value_counts(w.run, "recommendation")


@query
def revenue_by_tier(w: Workspace) -> DataFrame:
    return serving.total_by(w.run, "risk_tier", "annual_revenue_at_risk", "annual_revenue_at_risk")


@query
def revenue_by_recommendation(w: Workspace) -> DataFrame:
    return serving.total_by(w.run, "recommendation", "monthly_revenue", "monthly_revenue")


@query
def probability_buckets(w: Workspace) -> DataFrame:
    return serving.probability_buckets(w.predictions)


@query
def probability_stats(w: Workspace) -> DataFrame:
    p = F.col("churn_probability")
    runs = w.stored_predictions
    median = stats.bracketed_quantiles(runs, "churn_probability", {"median": 0.5}).scalar()
    return runs.agg(
        F.count("*").alias("total"), F.min(p).alias("min_churn"), F.max(p).alias("max_churn"),
        F.avg(p).alias("avg_churn"),
    ).withColumn("median_churn", median)


@query
def probability_histogram(w: Workspace) -> DataFrame:
    return stats.histogram(w.current_run, "churn_probability", 30)


@query
def health_histogram(w: Workspace) -> DataFrame:
    return stats.histogram(w.current_run, "health_score", 20)


@query
def retention_scenarios(w: Workspace) -> DataFrame:
    return serving.retention_scenarios(w.run)


@query
def business_case(w: Workspace) -> DataFrame:
    return serving.business_case(w.run)


@query
def churn_health_points(w: Workspace) -> DataFrame:
    return serving.churn_health_points(w.run)


@query
def distinct_customers(w: Workspace) -> DataFrame:
    return serving.distinct_customers(w.panel)


# --- exploration ----------------------------------------------------------------------------------


@query
def churn_by_size(w: Workspace) -> DataFrame:
    return eda.churn_by(w.enriched, "company_size")


@query
def churn_by_tier(w: Workspace) -> DataFrame:
    return eda.churn_by(w.enriched, "subscription_tier")


@query
def churn_by_industry(w: Workspace) -> DataFrame:
    return eda.churn_by(w.enriched, "industry")


@query
def churn_by_segments(w: Workspace) -> DataFrame:
    return eda.churn_by_segments(w.enriched)


@query
def churn_pivot(w: Workspace) -> DataFrame:
    return eda.churn_pivot(w.enriched)


@query
def engagement_by_label(w: Workspace) -> DataFrame:
    return eda.engagement_by_label(w.enriched)


@query
def churn_trend(w: Workspace) -> DataFrame:
    return eda.churn_trend(w.enriched)


@query
def high_churn_periods(w: Workspace) -> DataFrame:
    return eda.high_churn_periods(w.enriched)


@query
def segment_summary(w: Workspace) -> DataFrame:
    return eda.segment_summary(w.enriched, w.customers)


@query
def quality_report(w: Workspace) -> DataFrame:
    return eda.quality_report(tables.stored(w.enriched, "enriched"))


@query
def label_distribution(w: Workspace) -> DataFrame:
    return eda.label_distribution(w.features)


@query
def complete_records(w: Workspace) -> DataFrame:
    return eda.complete_records(w.features)


def _stored_counts(counts: DataFrame) -> DataFrame:
    return tables.stored(counts, "value-counts")


@query
def describe_features(w: Workspace) -> DataFrame:
    return eda.describe_features(w.features, _stored_counts)


@query
def label_correlation(w: Workspace) -> DataFrame:
    return eda.label_correlation(w.features)


@query
def correlation_matrix(w: Workspace) -> DataFrame:
    return eda.correlation_matrix(w.features)


@query
def features_by_size(w: Workspace) -> DataFrame:
    return eda.features_by(w.features, "company_size")


@query
def features_by_tier(w: Workspace) -> DataFrame:
    return eda.features_by(w.features, "subscription_tier")


@query
def boxplot_stats(w: Workspace) -> DataFrame:
    return eda.boxplot_stats(w.features, _stored_counts)


@query
def histogram(w: Workspace) -> DataFrame:
    """Four engagement metrics of active and churned rows, over common bins per metric."""
    rows = tables.stored(w.enriched.select("churned", *eda.LABEL_METRICS), "label-metrics")
    return stats.histograms(rows, eda.LABEL_METRICS, 20, "churned", (0, 1))


@query
def key_feature_histograms(w: Workspace) -> DataFrame:
    return stats.histograms(w.stored_features, eda.KEY_FEATURES, 30)


@query
def health_by_segment(w: Workspace) -> DataFrame:
    return eda.health_by_segment(w.stored_features)


@query
def feature_center(w: Workspace) -> DataFrame:
    return eda.feature_center(w.features, _stored_counts)


@query
def risk_segment(w: Workspace) -> DataFrame:
    return eda.with_risk_segment(w.features).select(*KEY, "risk_flag_count", "risk_segment")


@query
def segment_churn_rate(w: Workspace) -> DataFrame:
    return eda.segment_churn_rate(w.features)


# --- evaluation ------------------------------------------------------------------------------------


@query
def segment_enriched(w: Workspace) -> DataFrame:
    return evaluation.with_segments(w.scored, w.customers).select(
        *KEY, "churn_probability", "company_size", "subscription_tier", "monthly_revenue"
    )


@query
def tier_calibration(w: Workspace) -> DataFrame:
    return evaluation.tier_calibration(w.scored)


@query
def high_risk_segments(w: Workspace) -> DataFrame:
    return evaluation.high_risk_segments(w.scored, w.customers)


@query
def top_risk_rows(w: Workspace) -> DataFrame:
    return evaluation.top_risk_rows(w.scored, w.customers)


@query
def calibration_deciles(w: Workspace) -> DataFrame:
    return evaluation.calibration_deciles(w.stored_scores)


@query
def confusion_metrics(w: Workspace) -> DataFrame:
    return evaluation.confusion_metrics(w.scored)


@query
def classification_report(w: Workspace) -> DataFrame:
    return evaluation.classification_report(w.scored)


@query
def roc_curve(w: Workspace) -> DataFrame:
    return evaluation.roc_curve(w.stored_scores)


@query
def roc_auc(w: Workspace) -> DataFrame:
    return evaluation.roc_auc(w.stored_scores)


# --- explanations -----------------------------------------------------------------------------------


@query
def features_with_predictions(w: Workspace) -> DataFrame:
    return explain.features_with_predictions(w.current_features, w.current_run)


@query
def explain_linear(w: Workspace) -> DataFrame:
    return w.explained.select(
        "customer_id", "base_value", F.inline("contributions")
    )


@query
def explanation_summary(w: Workspace) -> DataFrame:
    return w.explanations


@query
def explanation_detail(w: Workspace) -> DataFrame:
    return explain.detail(w.explained, serving.top_customer(w.stored_predictions))


@query
def explanation_rows(w: Workspace) -> DataFrame:
    return explain.rows_of_summary(w.explanations)


@query
def explanation_lookup(w: Workspace) -> DataFrame:
    return serving.explanation_lookup(w.explanations, serving.top_customer(w.stored_predictions))


# --- monitoring ---------------------------------------------------------------------------------------


@query
def run_statistics(w: Workspace) -> DataFrame:
    return monitoring.run_statistics(w.stored_predictions)


@query
def run_history(w: Workspace) -> DataFrame:
    return monitoring.run_history(w.predictions)


@query
def run_status(w: Workspace) -> DataFrame:
    return monitoring.run_status(w.predictions)


@query
def run_ledger(w: Workspace) -> DataFrame:
    """The ledger of all runs, stored with model tiers, then given business tiers, the last run again."""
    job, scorecard = RetentionJob(w.spark, _folder(w, "ledger")), scoring.scorecard()
    job.store_runs(scoring.predict(w.stored_features, scorecard, tiers="model"))
    job.retier()
    job.store_runs(scoring.predict(w.stored_features, scorecard).where(F.col("prediction_date") == w.as_of))
    cents = {c: F.round(c, 2) for c in ("total_revenue_at_risk", "quarter_revenue_at_risk")}
    return job.ledger().withColumns(cents)


@query
def checks_from_ledger(w: Workspace) -> DataFrame:
    """The monitoring pass of the daily job: it opens no predictions."""
    job = RetentionJob(w.spark, _folder(w, "checks"))
    job.store_runs(w.predictions)
    return monitoring.checks_of(job.ledger())


@query
def run_delta(w: Workspace) -> DataFrame:
    return monitoring.run_delta(w.predictions)


@query
def drift(w: Workspace) -> DataFrame:
    return monitoring.drift(w.predictions)


@query
def risk_anomaly(w: Workspace) -> DataFrame:
    return monitoring.risk_anomaly(w.stored_predictions)


@query
def monitoring_checks(w: Workspace) -> DataFrame:
    return monitoring.monitoring_checks(w.stored_predictions)


@query
def metric_log(w: Workspace) -> DataFrame:
    return monitoring.log_metrics(monitoring.monitoring_checks(w.stored_predictions), w.as_of)


@query
def model_health(w: Workspace) -> DataFrame:
    return monitoring.model_health(monitoring.monitoring_checks(w.stored_predictions))


# --- actions --------------------------------------------------------------------------------------------


@query
def uncontacted_high_risk(w: Workspace) -> DataFrame:
    waiting = actions.uncontacted_high_risk(w.stored_run, w.interventions, w.as_of)
    return actions.by_revenue(waiting)


@query
def alert_messages(w: Workspace) -> DataFrame:
    waiting = actions.uncontacted_high_risk(w.stored_run, w.interventions, w.as_of)
    return actions.alert_messages(waiting, w.as_of)


@query
def new_interventions(w: Workspace) -> DataFrame:
    return actions.trigger(w.stored_predictions, w.interventions, w.as_of).select(*actions.LOG_COLUMNS)


@query
def intervention_stats(w: Workspace) -> DataFrame:
    return actions.intervention_stats(w.interventions, w.as_of)


@query
def recent_interventions(w: Workspace) -> DataFrame:
    return actions.recent_interventions(w.interventions)


@query
def intervention_history(w: Workspace) -> DataFrame:
    return actions.intervention_history(w.interventions, serving.top_customer(w.stored_predictions))


@query
def today_interventions(w: Workspace) -> DataFrame:
    return actions.today_interventions(w.interventions, w.as_of)


# --- trained model: no SQL equivalent -------------------------------------------------------------------

for _build in (
    training.train_evaluate,
    training.feature_importance_top,
    training.score_boosted,
    training.score_boosted_ranks,
    training.stratified_split,
    training.confusion_boosted,
    training.boosted_step,
    training.importance_total,
    training.contribution_gap,
    training.explain_boosted,
):
    query(_build)


@query
def alert_summary(w: Workspace) -> DataFrame:
    """Totals with the day's last actions as one text."""
    summary = actions.alert_summary(w.interventions, w.as_of)
    lines = F.transform(
        "recent_activity",
        lambda a: F.concat_ws(" ", a["customer_id"].cast("string"), a["action_type"], a["status"]),
    )
    return summary.withColumn("recent_activity", F.array_join(lines, "; "))
