"""Published tables, look-ups that read little, the run ledger and the repair of late rows."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import panel_row
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import features, journeys, monitoring, serving, state
from holdfast.plans.pipeline import RetentionJob, load_inputs
from holdfast.sources.versions import VersionedTable


def panel_of(spark, *given):
    names = schemas.ENGAGEMENT.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in given], schemas.ENGAGEMENT)


def panel_and_customers(spark, months=range(1, 6), names="ABCDEFGH"):
    given = [
        panel_row(n, f"2024-{m:02d}", logins_per_day=float(i % 4), days_since_last_login=9 * i,
                  engagement_score=80.0 - 9 * i - m, features_used_count=i % 5, support_tickets=m % 3)
        for i, n in enumerate(names) for m in months
    ]
    customers = [(n, n, "small", "SaaS", "Starter", 100.0 * i, None, 12) for i, n in enumerate(names)]
    return panel_of(spark, *given), spark.createDataFrame(customers, schemas.CUSTOMERS)


def scans(df):
    """Runs a plan and returns, per file scan, how many rows came out of it."""
    df.collect()
    found = []

    def walk(node):
        metrics = node.metrics()
        if "numFiles" in str(metrics.keys()):
            found.append(metrics.apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- versions ------------------------------------------------------------------------------


def test_a_write_that_stops_is_not_seen(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), "p", "k", 2)
    frame = lambda *r: spark.createDataFrame(r, "k string, p string, v int")
    assert not table.exists() and table.parts() == []
    table.append(frame(("a", "1", 1), ("b", "2", 2)))
    with monkeypatch.context() as stopped:
        stopped.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            table.replace_parts(frame(("a", "1", 9)))
    assert {tuple(r) for r in table.read().collect()} == {("a", "1", 1), ("b", "2", 2)}
    assert table.replace_parts(frame(("a", "1", 9))) == ["1"]
    assert {tuple(r) for r in table.read().collect()} == {("a", "1", 9), ("b", "2", 2)}
    assert [(p.part, p.rows) for p in sorted(table.pieces(), key=lambda p: p.part)] == [("1", 1), ("2", 1)]
    table.replace(frame(("c", "3", 3)))
    table.replace(frame(("d", "x/y=z", 4)))
    assert table.parts() == ["x/y=z"] and table.read(["x/y=z"]).first()["v"] == 4
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("holdfast_version=")]) == 2


def test_a_reader_of_the_last_version_can_finish(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    reading = table.read()
    table.replace(spark.range(5))
    assert reading.count() == 3 and table.read().count() == 5


def test_frames_of_one_version_and_empty_frames(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), key="id", buckets=2)
    table.replace(spark.range(3), spark.range(3, 7), note={"until": "x"})
    assert table.by_key(table.pieces()[0]).count() == 7 and table.note() == {"until": "x"}
    table.append(spark.range(0))
    assert table.version() == "000000000001"
    table.replace(spark.range(0))
    assert table.read().collect() == [] and table.lookup(1).collect() == []


# --- look-ups --------------------------------------------------------------------------------


def test_a_lookup_reads_one_row_group_of_one_bucket(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "run", "customer_id", 4, row_group_bytes=32 << 10)
    wide = spark.range(60_000).select(
        F.format_string("C%06d", "id").alias("customer_id"), F.lit("2024-01-01").alias("run"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    table.append(wide)
    table.append(wide.withColumn("run", F.lit("2024-01-02")))
    found = table.lookup("C031234", ["2024-01-02"])
    read = scans(found)
    assert len(read) == 1 and 0 < read[0] <= 3000  # of 60,000: one group of one file
    assert [r["customer_id"] for r in found.collect()] == ["C031234"]
    assert scans(table.lookup("C0312345", ["2024-01-02"]))[0] <= 3000
    # the files of other buckets are not opened: spoil them
    piece = table.pieces(["2024-01-02"])[0]
    files = {f.split("/")[-1] for f in table.by_key(piece).where("customer_id = 'C031234'").select(
        F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    for file in (Path(table.path) / piece.folder).glob("part-*"):
        if file.name not in files:
            file.write_bytes(b"spoilt")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert table.lookup("C031234", ["2024-01-02"]).count() == 1


def test_lookups_equal_the_scans(spark, stored):
    job = stored
    run = job.predictions(last=1)
    for customer in ("A", "C", "nobody"):
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(job.customer(customer), serving.customer_lookup(run, customer))
        assert same(job.prescription(customer), serving.prescription_lookup(job.read("prescriptions"), customer))
        assert same(job.explanation(customer), serving.explanation_lookup(job.read("explanations"), customer))
        whole = serving.customer_360(run, job.read("prescriptions"), job.read("explanations"))
        assert same(job.customer_view(customer), whole.where(F.col("customer_id") == customer))
        log = job.read("interventions")
        assert job.interventions_of(customer).count() == log.where(F.col("customer_id") == customer).count()
    assert job.customer("A").count() == 1


# --- the ledger ------------------------------------------------------------------------------


def test_the_ledger_query_derives_its_features_once(spark, monkeypatch, tmp_path):
    """Both its runs come from the stored features; none goes back to the events."""
    from holdfast.plans import catalog
    from holdfast.plans.workspace import Workspace

    class Job:
        runs = []

        def __init__(self, spark, root):
            pass

        def store_runs(self, ranked):
            self.runs.append(ranked)

        def retier(self):
            pass

        def ledger(self):
            money = "total_revenue_at_risk double, quarter_revenue_at_risk double"
            return spark.createDataFrame([(1.0, 2.0)], money)

    events = spark.range(6).select(
        (F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    customer = "c_custkey long, c_name string, c_mktsegment string, c_acctbal double"
    given = spark.createDataFrame([(0, "A", "BUILDING", 100.0), (1, "B", "MACHINERY", 9000.0)], customer)
    given.write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(catalog, "RetentionJob", Job)
    catalog.BUILDERS["run_ledger"](Workspace(spark, str(tmp_path)))
    assert len(Job.runs) == 2
    assert not [f for run in Job.runs for f in run.inputFiles() if "events" in f]
    assert [run.count() for run in Job.runs] == [12, 2]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("job"))
    panel, customers = panel_and_customers(spark)
    job = RetentionJob(spark, root, buckets=2)
    for until in ("2024-03", "2024-04", "2024-05"):
        load_inputs(spark, root, panel.where(F.col("period") <= until), customers, buckets=2)
        job.run(F.lit(f"{until}-28"))
    return job


def test_the_ledger_equals_the_full_aggregate(spark, stored, make_predictions):
    def check():
        whole = monitoring.ledger_rows(stored.predictions())
        assert rounded(stored.ledger()) == rounded(whole.select(*stored.ledger().columns))

    check()
    assert stored.ledger().count() == 3
    runs = [("A", "2024-02", 0.25, "Low Risk"), ("B", "2024-02", 0.5, "Medium Risk")]
    stored.table("predictions").replace_parts(
        make_predictions(*runs).select(*[c for c in schemas.PREDICTIONS.fieldNames() if c in make_predictions().columns])
    )
    stored.update_ledger()
    assert stored.ledger().count() == 4
    check()
    stored.retier()
    check()
    assert stored.ledger().where("prediction_date = '2024-02'").first()["high_risk_count"] == 1


def test_monitors_open_no_predictions(spark, stored):
    runs, ledger = stored.predictions(), stored.ledger()
    pairs = [
        (monitoring.history_of(ledger), monitoring.run_history(runs)),
        (monitoring.status_of(monitoring.history_of(ledger)), monitoring.run_status(runs)),
        (monitoring.delta_of(ledger), monitoring.run_delta(runs)),
        (monitoring.drift_of(ledger), monitoring.drift(runs)),
        (monitoring.anomaly_of(ledger), monitoring.risk_anomaly(runs)),
        (monitoring.checks_of(ledger), monitoring.monitoring_checks(runs)),
    ]
    for cheap, full in pairs:
        assert rounded(cheap) == rounded(full)
        assert not any("/predictions/" in f for f in cheap.inputFiles())


# --- layout and repair -------------------------------------------------------------------------


def test_the_state_update_has_no_exchange(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        new = panel_of(spark, panel_row("A", "2024-06"), panel_row("Z", "2024-06"))
        stored.add_engagement(new)
        table = stored.table("engagement")
        rows_ = table.by_key(table.pieces(["2024-06"])[0])
        known, first = state.continued(stored._state_by_key(), rows_)
        for frame in (known, first, known.repartition(2, "customer_id")):
            assert "Exchange" not in plan(frame)
        assert [r["customer_id"] for r in first.collect()] == ["Z"]
        stored.update_state()
        assert stored.state().count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_late_rows_repair_their_customers_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "late")
    panel, customers = panel_and_customers(spark, months=(1, 2, 4, 5))
    job = RetentionJob(spark, root, buckets=2)
    load_inputs(spark, root, panel, customers, buckets=2)
    job.update_state()
    late, _ = panel_and_customers(spark, months=(3, 6), names="BD")
    load_inputs(spark, root, late, customers, buckets=2)
    built = []
    real = state.build
    monkeypatch.setattr(state, "build", lambda p, *a: built.append({r[0] for r in p.select("customer_id").collect()}) or real(p, *a))
    job.update_state()
    assert built == [{"B", "D"}, {"B", "D"}]  # the repair, then the new period
    job.features()
    job.journeys()
    whole = job.engagement()
    assert rounded(job.read("current_features")) == rounded(
        features.latest_period(features.feature_matrix(whole, customers)))
    assert rounded(job.read("customer_journeys")) == rounded(journeys.summary(whole))
    assert {r["history"] for r in job.state().where("customer_id in ('B', 'D')").collect()} == {6}


def test_a_stopped_job_can_be_repeated(spark, tmp_path, monkeypatch):
    panel, customers = panel_and_customers(spark, months=(1, 2))
    names = ("predictions", "prescriptions", "customer_journeys", "explanations", "interventions",
             "current_features", "customer_state", "run_ledger", "model_metrics")

    def content(job):
        return {n: rounded(job.read(n)) for n in names}

    whole = RetentionJob(spark, str(tmp_path / "whole"), buckets=2)
    load_inputs(spark, whole.store.root, panel, customers, buckets=2)
    whole.run(F.lit("2024-06-01"))
    wanted, real = content(whole), VersionedTable._publish
    job = RetentionJob(spark, str(tmp_path / "stopped"), buckets=2)
    load_inputs(spark, job.store.root, panel, customers, buckets=2)
    for stop in range(1, 12):
        calls = []

        def publish(self, *args):
            calls.append(self.path)
            if len(calls) == stop:
                raise RuntimeError("stopped")
            return real(self, *args)

        with monkeypatch.context() as stopped:
            stopped.setattr(VersionedTable, "_publish", publish)
            try:
                job.run(F.lit("2024-06-01"))
            except RuntimeError:
                continue
        break
    assert stop > 4  # steps that had published were not repeated needlessly, and none was left out
    assert content(job) == wanted


def rounded(df):
    columns = sorted(df.columns)
    return sorted(
        [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()], key=str
    )
