"""Reading, storing, the daily job and the streams. Repeating a step adds nothing."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import panel_row, rows
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import actions, features, journeys, monitoring, state
from holdfast.plans.pipeline import RetentionJob, load_inputs
from holdfast.session import job_session
from holdfast.sources import tables
from holdfast.streaming.alerts import alert_stream
from holdfast.streaming.ingest import ingest_stream

HEADER = ",".join(schemas.ENGAGEMENT.fieldNames())


def write_lines(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_csv_engagement(spark, tmp_path):
    path = write_lines(tmp_path / "e.csv", "A,2024-01,5,100,2.5,3,4,0,61.5,0", "B,2024-01,,,NaN,,,,,")
    found = {r["customer_id"]: r for r in tables.read_engagement(spark, path).collect()}
    assert found["A"]["logins_per_day"] == 2.5 and found["A"]["period"] == "2024-01"
    assert found["B"]["logins_per_day"] is None


def test_columns_are_matched_by_name(spark, tmp_path):
    names = schemas.ENGAGEMENT.fieldNames()
    turned = list(reversed(names)) + ["extra"]
    values = dict(zip(names, "A,2024-01,5,100,2.5,3,4,0,61.5,0".split(","))) | {"extra": "x"}
    path = tmp_path / "turned.csv"
    path.write_text(",".join(turned) + "\n" + ",".join(values[n] for n in turned) + "\n")
    found = tables.read_engagement(spark, str(path))
    assert found.columns == names
    assert found.first()["engagement_score"] == 61.5


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("customer_id,period\nA,2024-01\n")
    with pytest.raises(ValueError, match="churned"):
        tables.read_engagement(spark, str(path))


def test_customers_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",".join(schemas.CUSTOMERS.fieldNames())
                    + "\nA,Acme,small,SaaS,Starter,500,2023-05-01,12\n")
    assert tables.read_customers(spark, str(path)).first()["monthly_revenue"] == 500.0


def test_files_with_different_column_orders_are_matched_by_name(spark, tmp_path):
    source = tmp_path / "mixed"
    source.mkdir()
    write_lines(source / "1.csv", "A,2024-01,5,100,2.5,3,4,0,61.5,0")
    turned = HEADER.replace("active_users,api_calls", "api_calls,active_users")
    (source / "2.csv").write_text(turned + "\nB,2024-01,100,5,2.5,3,4,0,61.5,0\n")
    found = tables.read_engagement(spark, str(source)).collect()
    assert {(r["active_users"], r["api_calls"]) for r in found} == {(5, 100)} and len(found) == 2
    target, mark = str(tmp_path / "stored"), str(tmp_path / "mark")
    ingest_stream(spark, str(source), target, mark).awaitTermination()
    stored = spark.read.schema(schemas.ENGAGEMENT).parquet(target)
    assert {(r["active_users"], r["api_calls"]) for r in stored.collect()} == {(5, 100)}


def test_year_month_is_the_period(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(HEADER.replace("period", "year_month") + "\nA,2024-01,5,100,2.5,3,4,0,61.5,0\n")
    assert tables.read_engagement(spark, str(path)).first()["period"] == "2024-01"


def test_the_file_without_a_column_is_named(spark, tmp_path):
    source = tmp_path / "some"
    source.mkdir()
    write_lines(source / "1.csv", "A,2024-01,5,100,2.5,3,4,0,61.5,0")
    (source / "2.csv").write_text("customer_id,period\nB,2024-01\n")
    with pytest.raises(ValueError, match=r"churned.*2\.csv"):
        tables.read_engagement(spark, str(source))
    mark, target = str(tmp_path / "mark"), tmp_path / "stored"
    with pytest.raises(Exception, match="Missing required columns"):
        ingest_stream(spark, str(source), str(target), mark).awaitTermination()
    assert not target.exists()


def test_customers_of_any_column_order(spark, tmp_path):
    names = ["customer_id", "company_name", "company_size", "subscription_tier", "industry",
             "monthly_revenue", "contract_length_months", "onboarding_date"]
    path = tmp_path / "c.csv"
    path.write_text(",".join(names) + "\nA,Acme,small,Starter,SaaS,500,12,2023-05-01\n")
    found = tables.read_customers(spark, str(path)).first()
    assert (found["industry"], found["subscription_tier"], found["contract_length_months"]) == ("SaaS", "Starter", 12)


def test_rows_without_a_key_are_refused(spark, tmp_path):
    path = write_lines(tmp_path / "e.csv", "A,2024-01,5,100,2.5,3,4,0,61.5,0", ",2024-01,,,,,,,,", "B,,,,,,,,,")
    for _ in range(2):
        with pytest.raises(ValueError, match="2 rows without"):
            tables.append_engagement(spark, tables.read_engagement(spark, path), str(tmp_path / "stored"))
    assert not (tmp_path / "stored").exists()


def test_equal_ids_of_different_rows_are_both_logged(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "intervention_id long, customer_id string, action_type string, timestamp timestamp"
    day = datetime(2024, 1, 2, 8)
    one = spark.createDataFrame([(1, "A", "email_alert", day), (1, None, "email_alert", day)], schema)
    two = spark.createDataFrame([(1, "B", "email_alert", day), (9, "A", "email_alert", day)], schema)
    for rows_ in (one, two, one, two):
        tables.append_log(spark, rows_, path, actions.LOG_KEY, "timestamp")
    assert sorted(str(r["customer_id"]) for r in spark.read.parquet(path).collect()) == ["A", "B", "None"]


def test_a_day_given_as_text_or_as_time_is_one_day(spark):
    row = monitoring.metric_row(spark, "custom", "rows", 3)
    ids = {monitoring.log_metrics(row, d).first()["metric_id"]
           for d in (F.lit("2024-01-02"), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-02").cast("date"))}
    assert len(ids) == 1


def test_monitors_read_the_last_runs_only(spark, make_predictions, tmp_path):
    path = str(tmp_path / "runs")
    runs = [("A", f"2024-01-0{d}", 0.1 * d, "Low Risk") for d in range(1, 8)]
    tables.store_predictions(spark, make_predictions(*runs), path)
    stored = spark.read.parquet(path)
    for found in (monitoring.run_history(stored), monitoring.drift(stored), monitoring.run_delta(stored)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert any("prediction_date" in p.split("]")[0] and "ubquery" in p.split("]")[0]
                   for p in plan.split("PartitionFilters: [")[1:])
    assert monitoring.run_history(stored, 3).count() == 3


def test_retier_rewrites_only_runs_with_changes(spark, make_predictions, tmp_path):
    job = RetentionJob(spark, str(tmp_path))
    runs = [("A", "2024-01-01", 0.01, "Low Risk"), ("B", "2024-01-02", 0.99, "Low Risk")]
    stored = job.table("predictions")
    stored.replace_parts(make_predictions(*runs))
    before = stored.pieces()
    job.retier()
    after = stored.pieces()
    assert [p for p in after if p.part == "2024-01-01"] == [p for p in before if p.part == "2024-01-01"]
    assert [p for p in after if p.part == "2024-01-02"] != [p for p in before if p.part == "2024-01-02"]
    assert job.predictions().where("customer_id = 'B'").first()["risk_tier"] == "High Risk"


def test_first_row_wins(spark, make_panel):
    panel = make_panel(panel_row(api_calls=1), panel_row(api_calls=2), panel_row("B", api_calls=3))
    marked = panel.coalesce(1).withColumn("n", F.monotonically_increasing_id()).repartition(4)
    kept = tables.dedup_first(marked, tables.PANEL_KEY, F.col("n"))
    assert {r["customer_id"]: r["api_calls"] for r in kept.collect()} == {"A": 1, "B": 3}
    assert tables.duplicate_count(marked, tables.PANEL_KEY).first()["removed"] == 1


def test_first_row_of_the_files_wins(spark, tmp_path):
    source = tmp_path / "many"
    source.mkdir()
    for name, calls in (("1.csv", 11), ("2.csv", 22)):
        write_lines(source / name, f"A,2024-01,5,{calls},2.5,3,4,0,61.5,0",
                    f"A,2024-01,5,{calls + 1},2.5,3,4,0,61.5,0")
    found = tables.read_new_engagement(spark, str(source)).collect()
    assert [r["api_calls"] for r in found] == [11]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    hot = spark.range(10).select(F.lit("A").alias("k"), "id", F.lit("x").alias("v"))
    plan = tables.dedup_first(hot, ["k"], F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_append_skips_stored_keys(spark, make_panel, tmp_path):
    path = str(tmp_path / "engagement")
    tables.append_engagement(spark, make_panel(panel_row(), panel_row("B")), path)
    again = make_panel(panel_row(api_calls=7), panel_row("A", "2024-02"))
    tables.append_engagement(spark, again, path)
    tables.append_engagement(spark, again, path)
    stored = spark.read.schema(schemas.ENGAGEMENT).parquet(path)
    assert stored.count() == 3
    assert stored.where("customer_id = 'A' and period = '2024-01'").first()["api_calls"] == 100


def test_a_repeated_run_replaces_only_itself(spark, make_predictions, tmp_path):
    path = str(tmp_path / "predictions")
    tables.store_predictions(spark, make_predictions(("A", "2024-01", 0.1, "Low Risk")), path)
    tables.store_predictions(spark, make_predictions(("A", "2024-02", 0.2, "Low Risk")), path)
    tables.store_predictions(spark, make_predictions(("A", "2024-02", 0.3, "Low Risk")), path)
    found = spark.read.option("recursiveFileLookup", False).parquet(path)
    assert sorted(r["churn_probability"] for r in found.collect()) == [0.1, 0.3]


def test_export_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.export_csv(spark.createDataFrame([("a", 1.5)], "feature string, importance double"), path)
    assert spark.read.csv(path, header=True).first()["feature"] == "a"


def test_empty_tables_have_their_schema(spark, tmp_path):
    assert tables.load(spark, str(tmp_path / "none"), schemas.INTERVENTIONS).schema == schemas.INTERVENTIONS


def test_the_latest_run_reads_one_folder(spark, make_predictions, tmp_path):
    path = str(tmp_path / "runs")
    runs = [("A", f"2024-01-0{d}", 0.1 * d, "Low Risk") for d in range(1, 6)]
    tables.store_predictions(spark, make_predictions(*runs), path)
    latest = monitoring.latest_run(spark.read.parquet(path))
    assert latest.first()["churn_probability"] == pytest.approx(0.5)
    scans = latest._jdf.queryExecution().executedPlan().toString()
    filters = scans.split("PartitionFilters: [")[1].split("]")[0]
    assert "prediction_date" in filters and "ubquery" in filters


def test_append_reads_only_arriving_periods(spark, make_panel, tmp_path):
    """The period range of the arriving rows is a partition filter of the stored table."""
    path = str(tmp_path / "engagement")
    months = [panel_row("A", f"2024-0{m}") for m in range(1, 7)]
    tables.append_engagement(spark, make_panel(*months), path)
    tables.append_engagement(spark, make_panel(panel_row("B", "2024-03"), months[2]), path)
    stored = spark.read.schema(schemas.ENGAGEMENT).parquet(path)
    assert stored.count() == 7
    arriving = make_panel(panel_row("B", "2024-03"))
    first = arriving.agg(F.min("period").alias("p")).scalar()
    plan = stored.where(F.col("period").between(first, first))._jdf.queryExecution()
    filters = plan.executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "ubquery" in filters


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark) == folder
    kept = tables.stored(spark.range(3), "three")
    assert all(f.startswith(f"file://{folder}") for f in kept.inputFiles())
    assert kept.count() == 3


# --- the daily job -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored_job(spark, workspace, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("retention"))
    load_inputs(spark, root, workspace.panel, workspace.customers)
    job = RetentionJob(spark, root)
    job.run(F.lit("2024-01-30"))
    return job


def counts(job):
    names = ("engagement", "predictions", "prescriptions", "customer_journeys", "explanations",
             "interventions", "model_metrics")
    return {n: job.read(n).count() for n in names}


def test_daily_job_fills_every_table(stored_job, workspace):
    found = counts(stored_job)
    customers = workspace.journeys.count()
    assert found["engagement"] == workspace.panel.count()
    for name in ("predictions", "prescriptions", "customer_journeys", "explanations"):
        assert found[name] == customers
    high = stored_job.predictions().where("risk_tier = 'High Risk'").count()
    assert found["interventions"] == 2 * high
    assert found["model_metrics"] == 4


def test_derived_tables_have_their_declared_schema(stored_job, spark):
    for name, declared in schemas.DERIVED.items():
        written = stored_job.table(name).schema()
        assert [(f.name, f.dataType) for f in written if f.name != "customer_id"] == [
            (f.name, f.dataType) for f in declared if f.name != "customer_id"]
        assert stored_job.read(name).columns == declared.fieldNames()


def test_daily_job_can_be_repeated(stored_job, spark, workspace):
    before = counts(stored_job)
    load_inputs(spark, stored_job.store.root, workspace.panel, workspace.customers)
    stored_job.run(F.lit("2024-01-30"))
    assert counts(stored_job) == before


def test_state_of_some_days_equals_all_history(spark, workspace, tmp_path):
    """Three days at a time: features and journeys equal those of the whole panel."""
    root = str(tmp_path / "days")
    days = [r["period"] for r in workspace.panel.select("period").distinct().orderBy("period").collect()]
    job = RetentionJob(spark, root)
    cuts = (days[2], days[5], days[5], days[8])
    for until in cuts:
        load_inputs(spark, root, workspace.panel.where(F.col("period") <= until), workspace.customers)
        job.update_state()
        job.features()
        job.journeys()
        stored = job.engagement()
        wanted = features.latest_period(features.feature_matrix(stored, workspace.customers))
        found = job.read("current_features")
        assert found.schema.simpleString() == wanted.schema.simpleString()
        assert rounded(found) == rounded(wanted)
        assert rounded(job.read("customer_journeys")) == rounded(journeys.summary(stored))
    assert job.table("customer_state").note()["until"] == days[8]


def test_late_rows_rebuild_the_state(spark, make_panel, tmp_path):
    root = str(tmp_path / "late")
    customers = spark.createDataFrame([("A", "x", "small", "SaaS", "Starter", 1.0, None, 12)], schemas.CUSTOMERS)
    job = RetentionJob(spark, root)
    for months in (("2024-01", "2024-04"), ("2024-02",), ("2024-05",)):
        load_inputs(spark, root, make_panel(*[panel_row("A", m) for m in months]), customers)
        job.update_state()
    assert job.state().first()["history"] == 4
    assert [r["period"] for r in job.state().first()["recent"]] == ["2024-01", "2024-02", "2024-04", "2024-05"]


def test_a_new_day_reads_only_its_folder(spark, workspace, stored_job):
    panel = stored_job.engagement()
    new = state.extend(stored_job.state(), panel.where(F.col("period") > "2024-01-29"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    filters = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert any("period" in f and "2024-01-29" in f for f in filters)


def rounded(df):
    return sorted(
        [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect()], key=str
    )


def test_stored_predictions_equal_the_query(stored_job, workspace):
    stored = stored_job.predictions().select("customer_id", "churn_probability", "recommendation")
    wanted = workspace.run.select("customer_id", "churn_probability", "recommendation")
    assert stored.exceptAll(wanted).isEmpty() and wanted.exceptAll(stored).isEmpty()


def test_retier_rewrites_every_stored_run(spark, make_predictions, tmp_path):
    job = RetentionJob(spark, str(tmp_path))
    runs = [("A", "2024-01-01", 0.25, "Low Risk"), ("B", "2024-01-02", 0.5, "Medium Risk"),
            ("C", "2024-01-02", 0.1, "Low Risk")]
    job.table("predictions").replace_parts(make_predictions(*runs))
    found = {r["risk_tier"]: r["customers"] for r in job.retier().collect()}
    assert found == {"Low Risk": 1, "Medium Risk": 1, "High Risk": 1}
    assert job.predictions().count() == 3


def test_jobs_refuse_another_time_zone(spark):
    assert job_session("x").conf.get("spark.sql.session.timeZone") == "UTC"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="Asia/Tokyo"):
            job_session("x")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_single_metric_is_logged(spark, tmp_path):
    row = monitoring.metric_row(spark, "custom", "rows", 3)
    logged = monitoring.log_metrics(row, F.lit("2024-01-02"))
    assert logged.schema.fieldNames() == schemas.MODEL_METRICS.fieldNames()
    path = str(tmp_path / "metrics")
    for _ in range(2):
        tables.append_log(spark, logged, path, monitoring.METRIC_KEY, "metric_time")
    assert spark.read.parquet(path).first()["metric_value"] == 3.0
    assert spark.read.parquet(path).count() == 1


def test_daily_job_with_a_trained_model(spark, workspace, tmp_path):
    from holdfast.__main__ import model_choice
    from holdfast.operators import ml
    from holdfast.plans.training import fit_and_store

    root, folder = str(tmp_path / "tables"), str(tmp_path / "boosted")
    load_inputs(spark, root, workspace.panel, workspace.customers)
    fit_and_store(workspace.features, folder, ml.BoostingSettings(trees=3, max_depth=3))
    job = RetentionJob(spark, root, **model_choice(folder))
    job.run(F.lit("2024-01-30"))
    explained = job.read("explanations")
    assert explained.count() == job.read("predictions").count()
    assert explained.where(F.size(F.split("top_3_features", ", ")) != 3).isEmpty()


# --- streams --------------------------------------------------------------------------------


def test_micro_batches_equal_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_lines(source / "1.csv", "A,2024-01,5,100,2.5,3,4,0,61.5,0", "A,2024-01,5,999,2.5,3,4,0,61.5,0")
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest_stream(spark, str(source), target, mark, 1).awaitTermination()
    write_lines(source / "2.csv", "A,2024-01,5,888,2.5,3,4,0,61.5,0", "B,2024-02,5,7,2.5,3,4,0,61.5,0")
    ingest_stream(spark, str(source), target, mark, 1).awaitTermination()
    replay = str(tmp_path / "second-mark")
    ingest_stream(spark, str(source), target, replay, 1).awaitTermination()
    found = rows(spark.read.schema(schemas.ENGAGEMENT).parquet(target), "customer_id")
    assert [(r["customer_id"], r["period"], r["api_calls"]) for r in found] == [
        ("A", "2024-01", 100), ("B", "2024-02", 7)]


def test_replayed_alert_batch_adds_nothing(spark, make_predictions, tmp_path):
    predictions, log = str(tmp_path / "p"), str(tmp_path / "log")
    tables.store_predictions(spark, make_predictions(
        ("A", "2024-01-01", 0.9, "High Risk"), ("B", "2024-01-01", 0.1, "Low Risk")), predictions)
    alert_stream(spark, predictions, log, str(tmp_path / "m1")).awaitTermination()
    assert spark.read.parquet(log).count() == 2
    alert_stream(spark, predictions, log, str(tmp_path / "m2")).awaitTermination()
    assert spark.read.parquet(log).count() == 2
    tables.store_predictions(
        spark, make_predictions(("A", "2024-01-02", 0.9, "High Risk")), predictions)
    alert_stream(spark, predictions, log, str(tmp_path / "m1")).awaitTermination()
    assert spark.read.parquet(log).count() == 4


def test_stream_and_batch_write_equal_ids(spark, make_predictions, tmp_path):
    run = make_predictions(("A", "2024-01-01", 0.9, "High Risk"))
    batch = actions.trigger(run, schemas.empty(spark, schemas.INTERVENTIONS), F.lit("2024-01-01"))
    predictions, log = str(tmp_path / "p"), str(tmp_path / "log")
    tables.store_predictions(spark, run, predictions)
    alert_stream(spark, predictions, log, str(tmp_path / "m")).awaitTermination()
    ours = {r["intervention_id"] for r in batch.collect()}
    assert ours == {r["intervention_id"] for r in spark.read.parquet(log).collect()}
