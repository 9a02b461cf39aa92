"""Training on data with a known signal, and exact checks of tree contributions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.config import MODEL_FEATURES
from holdfast.operators import evaluation, ml, scoring
from holdfast.operators import tree_contributions as trees
from holdfast.plans.training import fit_and_store

SMALL = ml.BoostingSettings(trees=6, max_depth=4)


@pytest.fixture(scope="module")
def labelled(spark):
    """Rows whose label follows tickets and inactivity; the other inputs are noise."""
    draw = np.random.default_rng(3)
    n = 1500
    values = {c: draw.random(n) for c in MODEL_FEATURES}
    odds = 6 * values["support_tickets"] + 4 * values["days_inactive"] - 6
    label = (draw.random(n) < 1 / (1 + np.exp(-odds))).astype(int)
    records = [
        (f"C{i}", "2024-01", int(label[i]), 50.0, *[float(values[c][i]) for c in MODEL_FEATURES])
        for i in range(n)
    ]
    names = ["customer_id", "period", "churned", "monthly_revenue", *MODEL_FEATURES]
    return spark.createDataFrame(records, names).persist()


@pytest.fixture(scope="module")
def fitted(labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    model, report = fit_and_store(labelled, path, SMALL)
    return model, report, path


def test_split_keeps_label_shares(labelled):
    train, test = ml.stratified_split(labelled)
    for label in (0, 1):
        whole = labelled.where(F.col("churned") == label).count()
        assert test.where(F.col("churned") == label).count() == round(whole * 0.2)
    assert train.count() + test.count() == labelled.count()
    assert train.join(test, "customer_id").isEmpty()


def test_split_does_not_depend_on_partitions(labelled):
    first = ml.stratified_split(labelled)[1].select("customer_id")
    second = ml.stratified_split(labelled.repartition(3))[1].select("customer_id")
    assert first.exceptAll(second).isEmpty()


def test_rows_of_more_parts_than_cores_are_dealt_evenly(spark, labelled):
    """With one part more than cores all cores but one wait; a smaller table stays as it is."""
    cores = spark.sparkContext.defaultParallelism
    many, few = labelled.repartition(2 * cores + 1), labelled.coalesce(1)
    sizes = ml.evenly_dealt(many, many).select("customer_id").rdd.glom().map(len).collect()
    assert len(sizes) == 3 * cores and sum(sizes) == labelled.count()
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ml.evenly_dealt(few, few) is few


def test_temporal_split(labelled):
    early, late = ml.temporal_split(labelled, "2024-01")
    assert early.isEmpty() and late.count() == labelled.count()


def test_model_finds_the_signal(fitted, spark):
    model, report, _ = fitted
    test = report.where("part = 'test'").first()
    assert test["auc"] > 0.75
    best = [r["feature"] for r in ml.feature_importance(model, spark).limit(2).collect()]
    assert set(best) == {"support_tickets", "days_inactive"}


def test_saved_model_scores_equally(fitted, labelled):
    model, _, path = fitted
    again = ml.load_model(f"{path}/model")
    p = [scoring.trained(m)(labelled).select("customer_id", "churn_probability") for m in (model, again)]
    assert p[0].exceptAll(p[1]).isEmpty()


def test_missing_inputs_are_scored_as_zero(fitted, labelled):
    score = scoring.trained(fitted[0])
    gap = labelled.withColumn("support_tickets", F.lit(None).cast("double"))
    zero = labelled.withColumn("support_tickets", F.lit(0.0))
    a, b = (score(df).select("customer_id", "churn_probability") for df in (gap, zero))
    assert a.exceptAll(b).isEmpty()


def test_contributions_add_up(fitted, labelled):
    model, _, path = fitted
    explained = trees.explain_trees(labelled, model, f"{path}/model")
    scores = scoring.trained(model)(labelled).select("customer_id", "churn_probability")
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    p = F.col("churn_probability")
    gap = F.max(F.abs(F.col("base_value") + total - F.log(p / (1 - p))))
    assert explained.join(scores, "customer_id").agg(gap).first()[0] < 1e-9


def test_contributions_equal_brute_force(fitted, labelled, spark):
    """Shapley values by definition, over every subset of the features a tree uses."""
    _, _, path = fitted
    groups = trees.read_trees(spark, f"{path}/model")
    used = sorted({int(f) for g in groups for f in np.unique(g.feature)})[:4]
    # Leaves that use only these features form a smaller game of the same kind.
    kept = [
        trees.Leaves(g.feature[m], g.low[m], g.high[m], g.share[m], g.value[m])
        for g in groups for m in [np.isin(g.feature, used).all(axis=1)] if m.any()
    ]
    assert kept
    row = np.array([[r[c] for c in MODEL_FEATURES] for r in labelled.limit(5).collect()])
    found = trees.contributions_of(row, kept, [trees.outcome_table(g) for g in kept])

    def worth(x, known):
        total = 0.0
        for g in kept:
            for leaf in range(len(g.value)):
                part = g.value[leaf]
                for f, lo, hi, share in zip(g.feature[leaf], g.low[leaf], g.high[leaf], g.share[leaf]):
                    part *= (float(lo < x[f] <= hi)) if f in known else share
                total += part
        return total

    for x, ours in zip(row, found):
        for f in used:
            others = [u for u in used if u != f]
            wanted = 0.0
            for size in range(len(others) + 1):
                chance = factorial(size) * factorial(len(used) - size - 1) / factorial(len(used))
                for subset in combinations(others, size):
                    wanted += chance * (worth(x, {*subset, f}) - worth(x, set(subset)))
            assert ours[f] == pytest.approx(wanted, abs=1e-9)


def test_evaluation_marks_overfitting(spark):
    good = spark.createDataFrame([(0.9, 1, 1), (0.1, 0, 0)], "churn_probability double, churned int, predicted_churn int")
    bad = spark.createDataFrame([(0.1, 1, 0), (0.9, 0, 1)], "churn_probability double, churned int, predicted_churn int")
    found = evaluation.evaluate(good, bad).collect()
    assert all(r["overfitting"] for r in found)
    assert {r["part"]: r["auc"] for r in found} == {"train": 1.0, "test": 0.0}
