"""The operators as queries over the tables of one data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    bpe, collocations, ctw, decontamination, licenses, lines, prefix_trie, quality, sharding, simhash, substrings,
    toxicity, url_templates,
)
from holdfast.llm.common import Store, table

SHARDS = 40
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"), Store(spark))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ctw.held_out(F.col("doc_id"))
    found = ctw.score(table(spark, sf_dir, "documents"), ~held_out, Store(spark))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed(table(spark, sf_dir, "documents"), Store(spark))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents"), Store(spark)))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.decontaminate(docs, items, Store(spark)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), SHARDS, Store(spark))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Store(spark))
    return found.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def op10_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filtered(table(spark, sf_dir, "documents"), Store(spark)).drop("failed")


def op11_zfast_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"), Store(spark))


def op12_collocation_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), Store(spark))


URL_RULES = (
    url_templates.Rule("org", "/", "allow"),
    url_templates.Rule("example.org", "/es/", "block"),
    url_templates.Rule("example.org", "/en/1", "block"),
    url_templates.Rule("com", "/fr/", "allow"),
    url_templates.Rule("com", "/de/", "block"),
)


def op13_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES, Store(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compact_windows,
        op2_byte_bpe,
        op3_context_tree,
        op4_fuzzy_lines,
        op5_toxic_segments,
        op6_license_index,
        op7_winnowing,
        op8_best_fit_shards,
        op9_simhash_golay,
        op10_adaptive_quality,
        op11_zfast_prefix_trie,
        op12_collocation_stripes,
        op13_path_templates,
    )
}
