"""Additive contributions of a boosted-tree model (path-dependent Shapley values).

A leaf's output is a game in which each feature on its path is "known" (the row
either satisfies the path or not) or "unknown" (it follows the path with the
training share of rows). A leaf has at most ``depth`` features, so the Shapley
values of all 2^depth outcomes fit a small table. Explaining a row is then one
look-up per leaf. Rows are independent: the job is a map without a shuffle, and
what every task receives is bounded by the size of the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.ml import as_inputs


@dataclass
class Leaves:
    """All leaves with the same number of path features."""

    feature: np.ndarray  # (leaves, features on path)
    low: np.ndarray  # exclusive lower bound per feature
    high: np.ndarray  # inclusive upper bound per feature
    share: np.ndarray  # training share that follows the path at this feature
    value: np.ndarray  # log-odds added by the leaf


def read_trees(spark: SparkSession, model_path: str) -> list[Leaves]:
    """Flatten the trees of a saved pipeline; bounded by the model, not by data."""
    stage = f"{model_path}/stages/*GBTClassifier*"
    nodes = spark.read.parquet(f"{stage}/data").select("treeID", "nodeData.*").toPandas()
    trees = spark.read.parquet(f"{stage}/treesMetadata").toDF("treeID", "metadata", "weight")
    weights = trees.select("treeID", "weight").toPandas()
    weight_of = dict(zip(weights["treeID"], weights["weight"]))
    paths: dict[int, list] = {}
    for tree, rows in nodes.groupby("treeID"):
        for path, value in _paths(rows.set_index("id").to_dict("index")):
            # The classifier's probability is a logistic of twice the margin.
            paths.setdefault(len(path), []).append((path, 2 * weight_of[tree] * value))
    return [_pack(group) for _, group in sorted(paths.items())]


def _paths(nodes: dict[int, dict]) -> Iterator[tuple[dict[int, tuple], float]]:
    """(feature -> (low, high, share), leaf value) for every leaf of one tree."""
    waiting = [(0, {})]
    while waiting:
        node_id, path = waiting.pop()
        node = nodes[node_id]
        if node["leftChild"] < 0:
            yield path, node["prediction"]
            continue
        feature = node["split"]["featureIndex"]
        cut = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (node["leftChild"], (low, min(high, cut))),
            (node["rightChild"], (max(low, cut), high)),
        ):
            part = share * nodes[child]["rawCount"] / node["rawCount"]
            waiting.append((child, {**path, feature: (*bounds, part)}))


def _pack(group: Sequence[tuple[dict[int, tuple], float]]) -> Leaves:
    shape = (len(group), len(group[0][0]))
    feature = np.array([list(path) for path, _ in group], dtype=int).reshape(shape)
    bounds = np.array([list(path.values()) for path, _ in group], dtype=float).reshape(*shape, 3)
    value = np.array([v for _, v in group])
    return Leaves(feature, bounds[..., 0], bounds[..., 1], bounds[..., 2], value)


def outcome_table(leaves: Leaves) -> np.ndarray:
    """Shapley value of each path feature for each of the 2^d outcomes of a leaf."""
    count, d = leaves.feature.shape
    outcome = ((np.arange(2**d)[:, None] >> np.arange(d)) & 1).astype(float)
    table = np.zeros((count, 2**d, d))
    for i in range(d):
        # by_size[k]: total product over all sets of k known features without i.
        by_size = [np.ones((count, 2**d))]
        for j in (j for j in range(d) if j != i):
            known, unknown = outcome[None, :, j], leaves.share[:, j, None]
            grown = [b * unknown for b in by_size] + [np.zeros((count, 2**d))]
            for k, b in enumerate(by_size):
                grown[k + 1] = grown[k + 1] + b * known
            by_size = grown
        chance = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        expected = sum(c * b for c, b in zip(chance, by_size))
        gain = outcome[None, :, i] - leaves.share[:, i, None]
        table[:, :, i] = leaves.value[:, None] * gain * expected
    return table


def base_value(groups: Sequence[Leaves]) -> float:
    """Mean log-odds over the training rows."""
    return float(sum((g.value * g.share.prod(axis=1)).sum() for g in groups))


def contributions_of(
    rows: np.ndarray, groups: Sequence[Leaves], tables: Sequence[np.ndarray]
) -> np.ndarray:
    """(rows, features) contributions: one table look-up per row and leaf."""
    total = np.zeros(rows.shape)
    for group, table in zip(groups, tables):
        bits = 1 << np.arange(group.feature.shape[1])
        for leaf, feature in enumerate(group.feature):
            values = rows[:, feature]
            inside = (values > group.low[leaf]) & (values <= group.high[leaf])
            total[:, feature] += table[leaf][inside @ bits]
    return total


def explain_trees(
    df: DataFrame, model: PipelineModel, model_path: str, keep: Sequence[str] = ("customer_id",)
) -> DataFrame:
    """Per-row contributions on the log-odds scale: base_value + their sum = log-odds."""
    groups = read_trees(df.sparkSession, model_path)
    base = base_value(groups)
    names = list(model.stages[0].getInputCols())
    inputs = PipelineModel(model.stages[:-1]).transform(as_inputs(df))
    vectors = inputs.select(*keep, vector_to_array("features").alias("inputs"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [outcome_table(g) for g in groups]
        for batch in batches:
            if len(batch):
                amounts = contributions_of(np.vstack(batch["inputs"].to_numpy()), groups, tables)
                yield batch.assign(amounts=list(amounts))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema]
    found = vectors.mapInPandas(explain, ", ".join([*fields, "amounts array<double>"]))
    parts = F.transform(
        F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("feature"),
            F.col("inputs").alias("value"),
            F.col("amounts").alias("contribution"),
        ),
        lambda c: c,
    )
    return found.select(*keep, F.lit(base).alias("base_value"), parts.alias("contributions"))
