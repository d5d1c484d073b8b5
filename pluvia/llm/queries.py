"""The subpackage's queries and, where SQL can say the same, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, embedding_dedup, language_id, line_dedup, mixing, packing, quality_rules, ranked_search, sharding, simhash, substring_dedup, token_counts, warc_store


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_docs(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    return language_id.identify(_docs(spark, sf_dir))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(_docs(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_dedup(spark, sf_dir):
    return simhash.simhash_components(_docs(spark, sf_dir))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_warc_archive(spark, sf_dir):
    return warc_store.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_consistent_ring(spark, sf_dir):
    return sharding.shard(_docs(spark, sf_dir))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(_docs(spark, sf_dir))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_token_counts, op4_mixing, op5_simhash_dedup,
        op6_substring_dedup, op7_best_fit_packing, op8_embedding_dedup, op9_warc_archive, op10_consistent_ring,
        op11_conversation_repair, op12_line_dedup, op13_ranked_search,
    )
}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op8_embedding_dedup": embedding_dedup.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
