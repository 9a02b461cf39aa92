"""Quality rules with thresholds that adapt to language and source.

Every text is measured once. Quantile sketches (KLL) of the measures are built per language
and source, merged into one per language and one for all, and give each group its fences:
the middle half of the group's values, widened by a multiple of its width and by a slack
that keeps a very uniform group from rejecting ordinary texts. A group with few rows takes
the fences of its language, a language with few rows those of all rows. Rows are joined with
their fences and kept if every measure lies inside.

A sketch has a bounded size and is built before the shuffle, so a source with a third of
all rows sends one sketch per task. Sketches are random in their last digits; the fences are
stored once, so all rows of a run meet the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Store, if_small, pieces, texts

WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: Rows a group needs for fences of its own.
MIN_GROUP = 200
#: Widths of the middle half that a value may lie outside of it.
WIDTHS = 4.0
#: Size of a sketch; the rank error is below half a percent.
SKETCH = 800
#: Measures: the least distance of a fence from the median, and whether low values fail too.
MEASURES = {
    "word_length": (3.0, True),
    "symbol_share": (0.2, False),
    "dup_line_share": (0.3, False),
    "repeat_share": (0.2, False),
}

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, exactly: windows are ranked by doubling."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        width += step
        if len(count) == len(rank):  # all different: so are all wider windows
            return 0
    starts = np.flatnonzero(count[rank] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode().split()  # of bytes: at ASCII white space only
    n_lines, n_dup = duplicate_lines(text)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        n_lines,
        n_dup,
        repeated_words(words),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the counts, ``base_failed`` and the measures of every row."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = pd.DataFrame([counts(t) for t in frame["text"]], columns=names, dtype="int64")
            yield pd.concat([frame[["doc_id", "lang", "source"]].reset_index(drop=True), found], axis=1)

    rows = texts(docs, "lang", "source").mapInPandas(run, f"doc_id long, lang string, source string, {COUNTS}")
    n = F.col("n_words")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return rows.select(
        "*",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)).alias("base_failed"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def fences(rows: DataFrame, store: Store) -> DataFrame:
    """``lang``, ``source`` and for each measure ``lo`` and ``hi`` in a struct; one row per group."""
    names = list(MEASURES)
    own = rows.where("n_words > 0").groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in names]
    )
    own = store.put(own, "sketches")
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in names]]
    language = _fenced(own.groupBy("lang").agg(*merge)).withColumnsRenamed({"n": "n_lang", "fence": "fence_lang"})
    whole = _fenced(own.agg(*merge).where("n > 0")).select("fence").scalar()
    group = _fenced(own)
    language = language.withColumnRenamed("lang", "lang_of")
    both = group.join(language, group.lang.eqNullSafe(language.lang_of))
    chosen = F.when(F.col("n") >= MIN_GROUP, F.col("fence")).when(
        F.col("n_lang") >= MIN_GROUP, F.col("fence_lang")
    ).otherwise(whole)
    return store.put(both.select("lang", "source", chosen.alias("fence")), "fences")


def _fenced(sketches: DataFrame) -> DataFrame:
    """The sketches of each measure replaced by its fences, in a struct ``fence``."""
    keys = [c for c in sketches.columns if c not in MEASURES]
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return sketches.select(
        *keys, *[F.kll_sketch_get_quantile_double(m, quarters).alias(m) for m in MEASURES]
    ).select(*keys, F.struct(*[_bounds(m, *MEASURES[m]).alias(m) for m in MEASURES]).alias("fence"))


def _bounds(measure: str, slack: float, low_too: bool) -> Column:
    low, middle, high = (F.get(F.col(measure), i) for i in range(3))
    reach = (high - low) * WIDTHS
    lo = F.least(low - reach, middle - slack) if low_too else F.lit(float("-inf"))
    return F.struct(lo.alias("lo"), F.greatest(high + reach, middle + slack).alias("hi"))


def filtered(docs: DataFrame, store: Store) -> DataFrame:
    """The counts of every row with ``base_failed``, ``failed`` (measures outside) and ``kept``.

    Null and empty texts have no words and fail the base rule. Null languages and sources are
    groups of their own. Equal rows get equal verdicts; an empty table gives no rows.
    """
    rows = store.put(measured(docs), "measured")
    limits = fences(rows, store)
    limits = if_small(limits).withColumnsRenamed({"lang": "lang_of", "source": "source_of"})
    both = rows.join(
        limits, rows.lang.eqNullSafe(limits.lang_of) & rows.source.eqNullSafe(limits.source_of), "left"
    )
    outside = [
        F.when(~F.col(m).between(F.col(f"fence.{m}.lo"), F.col(f"fence.{m}.hi")), F.lit(m)) for m in MEASURES
    ]
    return both.withColumn("failed", F.array_compact(F.array(*outside))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )
