"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from holdfast.llm import (
    bpe, collocations, ctw, decontamination, licenses, lines, quality, sharding, simhash, substrings, toxicity,
)
from holdfast.llm.common import Store
from holdfast.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("key", "label", "size", "shard", "bits", "score", "id", "row", "gone", "n_words", "block", "part")


def operators(spark):
    items = spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven"), (1, None)],
                                  "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    return {
        "repeats": lambda d: substrings.repeats(d, Store(spark)),
        "bpe": lambda d: bpe.digest(d, RANKS, public_tokenizers.PATTERN),
        "encode": lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
        "ctw": lambda d: ctw.score(d, ~ctw.held_out(F.col("doc_id")), Store(spark)),
        "lines": lambda d: lines.removed(d, Store(spark)),
        "line texts": lambda d: lines.deduplicate(d, Store(spark)),
        "toxicity": lambda d: toxicity.score(d, labels),
        "licenses": lambda d: licenses.summary(licenses.scan(d, Store(spark))),
        "decontaminate": lambda d: decontamination.decontaminate(d, items, Store(spark)),
        "shards": lambda d: sharding.assign(d, 3, Store(spark)),
        "simhash": lambda d: simhash.near_duplicates(d, Store(spark)),
        "representatives": lambda d: simhash.representatives(d, Store(spark)),
        "quality": lambda d: quality.filtered(d, Store(spark)),
        "collocations": lambda d: collocations.collocations(d, Store(spark), min_count=2),
    }


#: Operators that return one row per input row.
ROWWISE = ("bpe", "encode", "ctw", "lines", "line texts", "toxicity", "licenses", "decontaminate", "shards",
           "simhash", "quality")


@pytest.fixture(scope="module")
def odd(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
        (4, text, "en", "a", 1), (4, text, "en", "a", 1), (5, text, None, "a", 1), (None, text, "en", None, 1),
        (None, None, "en", "a", 1), (6, "word " * 60_000, "en", "a", 1), (7, "x" * 120_000, "fr", "b", 1),
        (8, "ÄÖ   日本語 😀 É\x1c\x85", "fr", "b", 1), (9, "\n".join([text] * 5), "fr", "b", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in EXTRA:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.mark.parametrize("name", ("repeats", "representatives", "collocations", *ROWWISE))
def test_odd_rows_and_empty_table(spark, odd, name):
    run = operators(spark)[name]
    found = run(odd).collect()
    if name in ROWWISE:
        given = [r.doc_id for r in odd.select("doc_id").collect()]
        assert sorted(map(str, given)) == sorted(str(r.doc_id) for r in found)
    twice = [r for r in found if r.asDict().get("doc_id") == 4]
    if name in ROWWISE and name != "shards":
        assert len(twice) == 2 and twice[0] == twice[1]
    assert run(odd.limit(0)).collect() == []


def test_pass_through_operators_keep_all_columns(spark, odd):
    for run in (lines.deduplicate, simhash.representatives):
        assert run(odd, Store(spark)).columns == odd.columns


def test_the_pipeline_and_its_stages_take_odd_rows(spark, odd, tmp_path):
    """Every stage keeps the columns; the whole run digests each kept row, and none of an empty table."""
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    big = odd.where("doc_id = 7").withColumn("text", F.expr("repeat('a long line of words without end ', 100000)"))
    odd.union(big).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(found) <= docs.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(found[0].asDict())


def test_shards_of_ties(spark):
    """Many rows of one size: all shards nearly equal, slots without gaps."""
    docs = spark.createDataFrame([(i, f"{i:04d}") for i in range(401)], "doc_id long, text string")
    found = sharding.assign(docs, 10, Store(spark)).collect()
    sizes = [sorted(r.slot for r in found if r.shard == s) for s in range(10)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 3
