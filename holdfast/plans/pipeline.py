"""The daily job: stored engagement in, every decision table out.

Each step reads published tables and publishes one, whole or not at all, so a step that is stopped
leaves the tables as they were, and repeating it adds no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.config import DEFAULT, Settings
from holdfast.operators import (
    actions,
    explain,
    monitoring,
    scoring,
    serving,
    sketches,
    state,
)
from holdfast.operators import prescriptions as rx
from holdfast.sources import rejects, tables
from holdfast.sources.versions import VersionedTable

#: Tables with one layout by customer, and their partition columns.
BY_CUSTOMER = {
    "customers": None,
    "engagement": "period",
    "customer_state": None,
    "predictions": "prediction_date",
    "interventions": "log_day",
    **dict.fromkeys(schemas.DERIVED),
}


@dataclass(frozen=True)
class Store:
    """Where the tables live."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


class JobTables:
    """The published tables below one folder. All have as many buckets, so that they join without a shuffle."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.store, self.buckets = spark, Store(root), buckets

    def table(self, name: str) -> VersionedTable:
        path = self.store.path(name)
        if name in BY_CUSTOMER:
            return VersionedTable(self.spark, path, BY_CUSTOMER[name], "customer_id", self.buckets)
        return VersionedTable(self.spark, path)

    def read(self, name: str) -> DataFrame:
        """A published table; one that is declared is empty before it is written, with the customers' key type."""
        if name == "model_metrics":
            return tables.load(self.spark, self.store.path(name), schemas.MODEL_METRICS)
        table, declared = self.table(name), self._declared(name)
        if declared is not None and not table.exists():
            return schemas.empty(self.spark, declared)
        return table.read(schema=declared)

    def _declared(self, name: str) -> T.StructType | None:
        declared = {**schemas.DERIVED, "interventions": schemas.INTERVENTION_LOG}.get(name)
        if declared is None:
            return None
        kind = self.table("customers").schema()["customer_id"].dataType
        return T.StructType([
            T.StructField("customer_id", kind, f.nullable) if f.name == "customer_id" else f for f in declared
        ])

    def one(self, name: str, customer_id, parts: list[str] | None = None) -> DataFrame:
        """Rows of one customer: of each piece one file, there the row groups that can hold the customer."""
        return self.table(name).lookup(customer_id, parts, self._declared(name))

    # --- arriving rows -----------------------------------------------------------------------

    def load_customers(self, customers: DataFrame) -> None:
        self.table("customers").replace(customers)

    def add_engagement(self, rows: DataFrame) -> None:
        """Add rows whose (customer, period) is not stored yet; rows without one are refused.

        The arriving plan runs once. Of the stored table the keys of the arriving periods are read.
        """
        table = self.table("engagement")
        arrived = tables.stored(tables.validate_columns(rows), "arriving")
        tables.refuse_null_keys(arrived, tables.PANEL_KEY)
        periods = [r["period"] for r in arrived.select("period").distinct().collect()]  # bounded by the calendar
        if table.pieces(periods):
            known = table.read(periods, T.StructType([arrived.schema[c] for c in tables.PANEL_KEY]))
            arrived = tables.new_rows(arrived, known, tables.PANEL_KEY)
        table.append(arrived)


    def ingest_customers(self, path: str | Sequence[str], fmt: str = "csv") -> dict[str, int]:
        """Replace the customers by those of arriving files; rows that cannot be read are set apart.

        Returns the number of rows by reason of rejection, good ones under ``good``.
        """
        rows = rejects.checked(self.spark, path, schemas.CUSTOMERS, ["customer_id"], fmt)
        arrived = tables.stored(rows, "checked")
        rejects.store(arrived, self.table("rejected"))
        self.load_customers(rejects.good(arrived).drop("_order"))
        return rejects.counts(arrived)

    def ingest(self, path: str | Sequence[str], fmt: str = "csv") -> dict[str, int]:
        """Store arriving engagement files: good rows once, the first of a key in file order, the others apart.

        Returns the number of rows by reason of rejection, good ones under ``good``. The files are parsed once.
        """
        rows = rejects.checked(self.spark, path, schemas.ENGAGEMENT, tables.PANEL_KEY, fmt)
        arrived = tables.stored(rows, "checked")
        rejects.store(arrived, self.table("rejected"))
        kept = tables.dedup_first(rejects.good(arrived), tables.PANEL_KEY, F.col("_order")).drop("_order")
        self.add_engagement(kept)
        return rejects.counts(arrived)


class RetentionJob(JobTables):
    """The steps of one day.

    ``strategy`` scores features, ``explainer`` adds contributions to scored
    features; both default to the scorecard.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        strategy: scoring.Strategy | None = None,
        tiers: str = "business",
        cfg: Settings = DEFAULT,
        explainer: Callable[[DataFrame], DataFrame] | None = None,
        buckets: int | None = None,
    ):
        super().__init__(spark, root, buckets)
        self.cfg, self.tiers = cfg, tiers
        self.strategy = strategy or scoring.scorecard(cfg)
        self.explainer = explainer or self._explain_scorecard

    def predictions(self, last: int | None = None) -> DataFrame:
        """Stored runs, all or the last ones; the dates come from the manifest."""
        runs = self.table("predictions")
        return runs.read(runs.parts()[-last:] if last else None)

    def engagement(self) -> DataFrame:
        return self.table("engagement").read()

    def state(self) -> DataFrame:
        return self.table("customer_state").read()

    def ledger(self) -> DataFrame:
        """One row per stored run, without opening a run."""
        return self.table("run_ledger").read()

    # --- steps ---------------------------------------------------------------------

    def update_state(self) -> None:
        """Bring the customers' state up to the last stored period.

        The state notes which pieces of engagement it has seen. New pieces of later periods continue
        it; customers with rows in new pieces of earlier periods are built anew from their history.
        """
        table, stored = self.table("customer_state"), self.table("engagement")
        pieces = stored.pieces()
        if not pieces:
            raise ValueError("no engagement has been stored")
        note = {"until": max(p.part for p in pieces), "seen": [p.folder for p in pieces]}
        before = table.note() if table.exists() else {"seen": []}
        seen = set(before["seen"])
        if not seen or not seen <= set(note["seen"]):
            table.replace(state.build(self.engagement(), self.cfg), note=note)
            return
        fresh = [p for p in pieces if p.folder not in seen]
        late = [p for p in fresh if p.part <= before["until"]]
        newer = [p for p in fresh if p.part > before["until"]]
        if late:
            known = [p for p in pieces if p.part <= before["until"]]
            kept, again = state.repaired(
                self._state_by_key(), stored.read(pieces=late), stored.read(pieces=known), self.cfg
            )
            middle = {"until": before["until"], "seen": [*before["seen"], *(p.folder for p in late)]}
            table.replace(kept, again, note=middle)
        if newer:
            rows = stored.by_key(newer[0]) if len(newer) == 1 else stored.read(pieces=newer)
            table.replace(*state.continued(self._state_by_key(), rows, self.cfg), note=note)

    def update_sketches(self) -> None:
        """Sketches of the customers of each period, for periods with new pieces; other rows are kept."""
        table, stored = self.table("customer_sketches"), self.table("engagement")
        now = {part: sorted(p.folder for p in stored.pieces([part])) for part in stored.parts()}
        before = table.note() if table.exists() else {}
        changed = [part for part, folders in now.items() if before.get(part) != folders]
        if not changed:
            return
        rows = sketches.per_group(stored.read(changed), "customer_id", "period")
        if table.exists():
            rows = table.read().where(~F.col("period").isin(changed)).unionByName(rows)
        table.replace(rows.coalesce(1), note=now)  # one row per period

    def distinct_customers(self, first: str, last: str) -> DataFrame:
        """About how many customers have rows from one period to another; reads a row per period."""
        spanned = self.read("customer_sketches").where(F.col("period").between(first, last))
        return sketches.distinct(spanned)

    def _state_by_key(self) -> DataFrame:
        table = self.table("customer_state")
        return table.by_key(table.pieces()[0])

    def features(self) -> None:
        """Features of the latest period, from the state."""
        until = self.table("customer_state").note()["until"]
        current = state.latest_features(self.state(), self.read("customers"), until, self.cfg)
        self.table("current_features").replace(current)

    def score(self) -> None:
        current = self.read("current_features")
        predicted = scoring.predict(current, self.strategy, self.tiers, self.cfg)
        self.store_runs(scoring.with_risk_rank(predicted))

    def store_runs(self, ranked: DataFrame) -> None:
        """Publish whole runs; a run of the same date is replaced, and so is its ledger row."""
        key = F.concat_ws("|", F.col("customer_id").cast("string"), "prediction_date")
        stored = ranked.withColumns({
            "prediction_id": monitoring.stable_id(key), "predicted_at": F.to_timestamp("prediction_date"),
        })
        self.table("predictions").replace_parts(
            stored.select(*[c for c in schemas.PREDICTIONS.fieldNames() if c in stored.columns])
        )
        self.update_ledger()

    def update_ledger(self) -> None:
        """Ledger rows of runs that were published since the last update; other rows are kept.

        The ledger notes the folders that its rows come from, so a stop between a run and its row
        is mended by the next update.
        """
        ledger, runs = self.table("run_ledger"), self.table("predictions")
        now = {part: sorted(p.folder for p in runs.pieces([part])) for part in runs.parts()}
        before = ledger.note() if ledger.exists() else {}
        changed = [part for part, folders in now.items() if before.get(part) != folders]
        if not changed and set(before) <= set(now):
            return
        rows = monitoring.ledger_rows(runs.read(changed))
        if ledger.exists():
            kept = [part for part in now if part not in changed]
            rows = ledger.read().where(F.col("prediction_date").isin(kept)).unionByName(rows)
        ledger.replace(rows.coalesce(1), note=now)  # one row per run

    def retier(self) -> DataFrame:
        """Give all stored runs business tiers; returns the customers per tier.

        One scan of three columns finds the runs in which a tier changes; only those are rewritten.
        """
        runs = self.table("predictions")
        now = scoring.retier(runs.read().withColumn("old_tier", F.col("risk_tier")), self.cfg)
        moved = now.where(~F.col("risk_tier").eqNullSafe(F.col("old_tier")))
        changed = [r["prediction_date"] for r in moved.select("prediction_date").distinct().collect()]
        if changed:
            runs.replace_parts(scoring.retier(runs.read(changed), self.cfg))
            self.update_ledger()
        return serving.value_counts(self.predictions(), "risk_tier")

    def prescribe(self) -> None:
        self.table("prescriptions").replace(rx.prescribe(self.predictions(last=1)))

    def journeys(self) -> None:
        self.table("customer_journeys").replace(state.journey_summary(self.state()))

    def explain(self) -> None:
        rows = explain.features_with_predictions(self.read("current_features"), self.predictions(last=1))
        self.table("explanations").replace(explain.summary(self.explainer(rows)))

    def _explain_scorecard(self, rows: DataFrame) -> DataFrame:
        return explain.explain_linear(rows, self.cfg, ("customer_id", "churn_probability"))

    def act(self, as_of: Column) -> None:
        """Log the day's actions that are not logged yet; of the log only the day is read."""
        log = self.table("interventions")
        day = F.date_format(as_of.cast("timestamp"), "yyyy-MM-dd")
        today = self.spark.range(1).select(day).first()[0]
        done = log.read([today], self._declared("interventions")).where(F.col("log_day") == today)
        new = actions.trigger(self.predictions(last=1), done, as_of).withColumn(
            "log_day", F.date_format("timestamp", "yyyy-MM-dd")
        )
        log.append(tables.new_rows(new, done, [*actions.LOG_KEY, "log_day"]))

    def monitor(self, as_of: Column) -> None:
        """The checks of the last runs, from their ledger rows."""
        checks = monitoring.checks_of(self.ledger(), self.cfg)
        logged = monitoring.log_metrics(checks, as_of)
        tables.append_log(
            self.spark, logged, self.store.path("model_metrics"), monitoring.METRIC_KEY, "metric_time"
        )

    # --- look-ups of one customer --------------------------------------------------------------

    def customer(self, customer_id) -> DataFrame:
        """The last prediction of a customer; no row when the customer is unknown."""
        last = self.table("predictions").parts()[-1:]
        return serving.customer_lookup(self.one("predictions", customer_id, last), customer_id)

    def customer_view(self, customer_id) -> DataFrame:
        """Prediction, prescription and explanation of one customer, side by side."""
        last = self.table("predictions").parts()[-1:]
        return serving.customer_360(
            self.one("predictions", customer_id, last),
            self.one("prescriptions", customer_id),
            self.one("explanations", customer_id),
        )

    def prescription(self, customer_id) -> DataFrame:
        return serving.prescription_lookup(self.one("prescriptions", customer_id), customer_id)

    def explanation(self, customer_id) -> DataFrame:
        return serving.explanation_lookup(self.one("explanations", customer_id), customer_id)

    def interventions_of(self, customer_id) -> DataFrame:
        return actions.intervention_history(self.one("interventions", customer_id), customer_id)

    def run(self, as_of: Column) -> None:
        """All steps of the day. ``as_of`` is the date of the run, never the clock."""
        self.update_state()
        self.features()
        self.score()
        self.prescribe()
        self.journeys()
        self.explain()
        self.act(as_of)
        self.monitor(as_of)


def load_inputs(
    spark: SparkSession, root: str, engagement: DataFrame, customers: DataFrame, buckets: int | None = None
) -> None:
    """Store customers whole and add the engagement rows that are new."""
    stored = JobTables(spark, root, buckets)
    stored.load_customers(customers)
    stored.add_engagement(engagement)
