"""Toxic passages as maximum-scoring segments.

Fitting counts the words of labelled documents, in toxic and in clean ones. The log-odds of
a word between the two have a Dirichlet prior, the word's share of all labelled text, and
are shrunk to nothing unless they stand clear of their own error. A word's score is its
log-odds less a constant, so that ordinary text sums to a negative drift. A word whose own
log-odds come to nothing takes those of its first letters.

One linear scan per text finds all maximal segments, those that no longer segment improves.
Scores of the best segment of ordinary text follow an extreme-value law with
``E = K n exp(-lambda S)`` expected segments of score ``S`` among ``n`` words; ``lambda`` solves
the law's equation on the clean word scores. Segments with a small ``E`` are significant. What
they add up to is mapped to a probability by a logistic curve, fitted on documents whose own
words were left out of their scores (two folds).

Words and stems are counted exactly, by an aggregate. Those whose log-odds are not nothing reach the driver and
are broadcast; their number is bounded by the labelled rows, of which there are ``MAX_LABELLED`` at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Store, pieces, texts

#: Lengths of the stems that speak for words too rare to have log-odds of their own.
STEMS = (7, 5)
#: Labelled rows to fit on, at most (in expectation); more are thinned by a hash of their id.
MAX_LABELLED = 200_000
#: Standard errors that log-odds must exceed.
CLEAR = 3.0
#: What each word costs a segment.
DRIFT = 0.25
#: Expected chance segments per text below which a segment is significant.
SIGNIFICANT = 0.01
THRESHOLD = 0.7
FLOOR, CEILING, STEP = -20.0, 60.0, 0.25
MEMO = 1 << 18
#: Units that a worker counts before it passes them on.
HELD = 100_000

_NO_WORD = re.compile(r"[\W_]+")


class Memo(dict):
    """A bounded memo of a function of words."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, raw: str):
        found = self.of(raw)
        if len(raw) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[raw] = found
        return found


def units(raw: str) -> tuple[str, ...]:
    """A word and its stems, longest first; none if it has no letter or digit."""
    form = _NO_WORD.sub("", raw.lower())
    return (form, *(f"{form[:n]}-" for n in STEMS if len(form) > n)) if form else ()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, behind last, sum), from left to right.

    Linear: neighbours of one sign form a run; each positive run enters a list and joins
    those before it while that raises the sum, following links past those that cannot.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], positive.view(np.int8), [0]))))
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sums at both, link
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        low, high = total[first], total[end]
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                found.append((first, end, low, high, at))
                break
            first, low = found[at][0], found[at][2]
            del found[at:]
    return [(first, end, float(high - low)) for first, end, low, high, _ in found]


@dataclass(frozen=True)
class Model:
    """Log-odds of words and the laws that turn segments into a probability."""

    odds: dict[str, float]
    rate: float  # lambda
    chance: float  # K
    slope: float
    intercept: float

    def word(self, raw: str) -> float:
        """Score of a word: its own log-odds, or if they are nothing those of its longest stem."""
        return next((o for u in units(raw) if (o := self.odds.get(u, 0.0))), 0.0) - DRIFT

    def evidence(self, scores: np.ndarray) -> tuple[float, float]:
        """Best segment's score, and the evidence: significant segments summed, else the best."""
        if not len(scores):
            return 0.0, FLOOR
        found = [s for _, _, s in segments(scores)]
        if not found:
            return 0.0, FLOOR
        size = math.log(self.chance * len(scores))
        units = [self.rate * s - size for s in found]
        clear = [u for u in units if u >= -math.log(SIGNIFICANT)]
        return max(found), min(max(sum(clear) if clear else max(units), FLOOR), CEILING)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.intercept))))


def scored(text: str, words: Memo) -> np.ndarray:
    """The scores of a text's words."""
    split = text.split()
    return np.fromiter(map(words.__getitem__, split), dtype=np.float64, count=len(split))


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int, units: int) -> Column:
    """Shrunk log-odds of each counted unit; the prior weighs as much as the smaller class.

    ``n_toxic`` and ``n_clean`` are the sums over all ``units``.
    """
    weight = float(min(n_toxic, n_clean))
    if not weight:
        return F.lit(0.0)
    prior = weight * (toxic + clean + 0.01) / (n_toxic + n_clean + 0.01 * units)
    a, b = toxic + prior, clean + prior
    odds = F.log(a / (n_toxic + weight - a)) - F.log(b / (n_clean + weight - b))
    clear = odds**2 / (1 / a + 1 / b)
    shrunk = odds * F.greatest(F.lit(0.0), 1 - CLEAR**2 / F.greatest(clear, F.lit(1e-9)))
    return F.when(toxic + clean > 0, shrunk + 0.0).otherwise(0.0)  # no negative zero


def decay(scores: np.ndarray, clean: np.ndarray) -> float:
    """``lambda``: the positive root of E[exp(lambda s)] = 1 over the clean words."""
    share = clean / max(clean.sum(), 1e-9)
    if not (scores > 0).any() or not share.any():
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float(share @ np.exp(np.minimum(x * scores, 600)))
    while value(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return max(high, 1e-3)


def _with_labels(docs: DataFrame, labels: DataFrame, trainable: Column, bound: int) -> DataFrame:
    """``text`` and ``toxic`` of the labelled rows to learn from.

    Several labels of one document count as toxic if one does. At most ``bound`` labelled
    documents are expected to pass, so that side of the join is small at any input size.
    """
    given = labels.where(trainable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    count = given.count()
    if count > bound:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / count))
    small = given.select(F.col("doc_id").alias("labelled"), "toxic")
    return docs.join(F.broadcast(small), F.col("doc_id") == F.col("labelled")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows that ``trainable`` (a condition on ``doc_id``) admits.

    Inputs are texts only. Without both labels every text gets the smoothed base rate.
    """
    store = Store(docs.sparkSession)
    known = _with_labels(texts(docs), labels, trainable, max_labelled)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Memo(units)
        seen: dict[str, list[int]] = {}

        def counted() -> pd.DataFrame:
            return pd.DataFrame(list(seen.values()), columns=["n0", "n1", "n2", "n3"]).assign(unit=list(seen))

        for frame in pieces(frames):
            for text, toxic in zip(frame["text"], frame["toxic"]):
                cell = 2 * _fold(text) + toxic
                for u in {u for w in set(text.split()) for u in words[w]}:
                    seen.setdefault(u, [0, 0, 0, 0])[cell] += 1
                if len(seen) >= HELD:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    counts = known.mapInPandas(count, "n0 long, n1 long, n2 long, n3 long, unit string")
    counts = counts.groupBy("unit").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])
    counts = store.put(counts, "units", **{f"n{i}": F.sum(f"n{i}") for i in range(4)})
    n, sums = [F.col(f"n{i}") for i in range(4)], [counts.measured[f"n{i}"] or 0 for i in range(4)]
    # all words; then the words of a document of one fold are scored by the counts of the other
    parts = [("whole", (1, 3), (0, 2)), ("fold0", (3,), (2,)), ("fold1", (1,), (0,))]
    of = lambda values, cells: sum(values[i] for i in cells)
    rated = counts.select(
        "unit",
        *[log_odds(of(n, t), of(n, c), of(sums, t), of(sums, c), counts.measured["rows"]).alias(name) for name, t, c in parts],
        *[of(n, c).alias(f"{name}_clean") for name, _, c in parts],
    )
    rated = store.put(rated, "odds")
    whole, *folds = [_scorer(rated, name) for name, _, _ in parts]
    given = docs.sparkSession.sparkContext.broadcast(folds)

    def chances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = [Memo(model.word) for model in given.value]
        for frame in pieces(frames):
            rows = []
            for text in frame["text"]:
                model, scores = given.value[_fold(text)], scored(text, words[_fold(text)])
                rows.append(len(scores) * math.exp(-model.rate * model.evidence(scores)[0]))
            yield pd.DataFrame({"n": [len(rows)], "chance": [sum(rows)]})

    clean = known.where("not toxic").mapInPandas(chances, "n long, chance double")
    clean = clean.agg(F.sum("n").alias("n"), F.sum("chance").alias("chance")).first()
    chance = clean.n / max(clean.chance, 1e-9) if clean.n else 1.0

    def assess(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [replace(model, chance=chance) for model in given.value]
        words = [Memo(model.word) for model in models]
        for frame in pieces(frames):
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                evidence = models[_fold(text)].evidence(scored(text, words[_fold(text)]))[1]
                rows.append((math.floor(evidence / STEP), bool(toxic)))
            yield pd.DataFrame(rows, columns=["step", "toxic"])

    assessed = known.mapInPandas(assess, "step int, toxic boolean")
    steps = assessed.groupBy("step", "toxic").agg(F.count("*").alias("n")).toPandas()
    slope, intercept = _logistic(
        np.maximum(steps["step"].to_numpy() * STEP, FLOOR), steps["toxic"].to_numpy(float), steps["n"].to_numpy(float)
    )
    store.drop(counts, rated)
    return replace(whole, chance=float(chance), slope=slope, intercept=intercept)


def _fold(text: str) -> int:
    """Copies of a text are in one fold."""
    return xxhash.xxh64_intdigest(text.encode(), 7) & 1


def _scorer(rated: DataFrame, name: str) -> Model:
    """The units whose log-odds are not nothing, and the law of their scores among clean words."""
    told = rated.where(F.col(name) != 0).select("unit", F.col(name).alias("odds"), F.col(f"{name}_clean").alias("n"))
    found = told.toPandas().sort_values("unit")
    rest = rated.where(F.col(name) == 0).agg(F.sum(f"{name}_clean").alias("n")).first().n or 0
    odds = found["odds"].to_numpy(float)
    rate = decay(np.r_[odds, 0.0] - DRIFT, np.r_[found["n"].to_numpy(float), float(rest)])
    return Model(dict(zip(found["unit"], odds.tolist())), rate, 1.0, 1.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with a slight pull to zero (Newton's method)."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (y - p)) - np.array([1e-2, 1e-3]) * beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        move = np.linalg.solve(curve, slope)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def scorer(docs: DataFrame, model: Model):
    """A function from a text column to its probability of label 1 (null text: empty)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = given.value
        words = Memo(model.word)
        for batch in batches:
            found = [model.probability(model.evidence(scored(t or "", words))[1]) for t in batch]
            yield pd.Series(found, dtype=float)

    return score


def passages(docs: DataFrame, model: Model, most: float = SIGNIFICANT) -> DataFrame:
    """Every significant passage: ``doc_id``, ``first``, ``behind`` (words), ``score``, ``expected``.

    ``expected`` is the number of chance segments of that score in a text of that length.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = given.value
        words = Memo(model.word)
        for frame in pieces(frames):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                scores = scored(text, words)
                for first, behind, score in segments(scores):
                    expected = model.chance * len(scores) * math.exp(-model.rate * score)
                    if expected <= most:
                        rows.append((doc_id, first, behind, score, expected))
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "first", "behind", "score", "expected"])
                yield out.astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(run, "doc_id long, first long, behind long, score double, expected double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    Labels of held-out ids are never read for fitting. Null and empty texts get the score of
    no evidence; equal rows equal scores; an empty table none.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id")), max_labelled)
    scored = texts(docs).select("doc_id", scorer(docs, model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
