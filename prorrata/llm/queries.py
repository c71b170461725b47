"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prorrata.llm.backoff import score_documents
from prorrata.llm.bursttrie import conversation_trie
from prorrata.llm.common import table
from prorrata.llm.divergence import quality_rules
from prorrata.llm.hashforest import search
from prorrata.llm.langid import identify
from prorrata.llm.mixing import mixed_order
from prorrata.llm.multiindex import mine_negatives
from prorrata.llm.packing import pack_documents
from prorrata.llm.quality import classify
from prorrata.llm.sharding import grown_tree, regular_tree, shard_documents
from prorrata.llm.simhash import near_duplicates
from prorrata.llm.tokencount import count_tokens
from prorrata.llm.transcripts import format_conversations

SHARDS = 8
ENTROPY_SHARE, MAX_REPEATS = 0.98, 4.0


def byte_bpe() -> str:
    """Place of the byte-level BPE file, the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op2_subword_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = regular_tree(2, 2, SHARDS // 4)
    return shard_documents(table(spark, folder, "documents"), tree, grown_tree(tree, SHARDS))


def op4_overlap_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), byte_bpe())


def op5_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


def op6_transcript_roles(spark: SparkSession, folder: str) -> DataFrame:
    return format_conversations(table(spark, folder, "conversations"))


def op7_temperature_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_order(table(spark, folder, "documents"), entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS)


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), byte_bpe())


def op9_simhash_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return mine_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_burst_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


def op13_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence_rules": op1_divergence_rules,
    "op2_subword_classifier": op2_subword_classifier,
    "op3_shard_tree": op3_shard_tree,
    "op4_overlap_tokens": op4_overlap_tokens,
    "op5_cross_parsing": op5_cross_parsing,
    "op6_transcript_roles": op6_transcript_roles,
    "op7_temperature_mix": op7_temperature_mix,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_tiles": op9_simhash_tiles,
    "op10_prefix_forest": op10_prefix_forest,
    "op11_multi_index": op11_multi_index,
    "op12_burst_trie": op12_burst_trie,
    "op13_backoff_automaton": op13_backoff_automaton,
}

# Hashes, learned models and tokenizers have no counterpart in SQL; these queries are tested
# against brute-force versions in tests/llm.
ORACLE: dict[str, str] = {}
