"""From raw documents to token digests: the operators of ``holdfast.llm`` in sequence.

Every stage takes all rows that its predecessor kept. ``run`` writes a stage's rows to the
shared folder and the next stage reads them, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, decontamination, lines, simhash, toxicity
from holdfast.llm.common import Store, if_small, table, text_key
from holdfast.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold."""
    learnable = ~toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable)
    return docs.where(toxicity.scorer(docs, model)(F.col("text")) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; of each group of near-equal lines one occurrence stays in the texts."""
    return lines.deduplicate(docs, Store(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that of the least ``doc_id``."""
    return simhash.representatives(docs, Store(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of words with a benchmark item."""
    store = Store(spark)
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"), store)
    hit = found.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).distinct()
    hit = if_small(store.put(hit, "contaminated"))
    key = text_key(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (key == hit["hit_key"]), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of the ids and of the bytes they decode to."""
    return bpe.digest(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: The stages fit models and follow links of any length, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, store.put(stage(spark, docs, sf_dir), "stage")
        store.drop(before)
    return docs
