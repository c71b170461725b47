"""From documents to packed sequences: language, quality, near-duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the shared folder and reads it back as the next stage's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prorrata.llm import langid, mixing, packing, quality, simhash
from prorrata.llm.common import id_remainder, table
from prorrata.llm.queries import ENTROPY_SHARE, MAX_REPEATS, byte_bpe
from prorrata.sources.workarea import written

# A language must be this much likelier than if all were alike.
LEAST_LANGUAGE_FACTOR = 1.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, nor those that are like no language more than another.

    Null and empty texts go. Null tags are predicted like all others. If no
    document has a tag there is nothing to compare with, and only documents
    without a letter go.
    """
    model = langid.learn(docs.filter(id_remainder("doc_id", 3) != 1))
    if not model.names:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike("\\p{L}"))
    found = langid.language_of(docs, F.col("text"), model)
    least = LEAST_LANGUAGE_FACTOR / len(model.names) if len(model.names) > 1 else 0.0
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= least))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as quality 1. Learns from the labels that op2 learns from."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0)
    model = quality.learn(docs, labels)
    return docs.filter(quality.score_of(docs, F.col("text"), model) >= quality.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of op9's near-duplicates: the one with the smallest doc_id, null ids last.

    Rows get a number that is written with them, so that of repeated rows, with
    the same id or none, one stays as well.
    """
    numbered = written(docs.withColumn("_at", F.monotonically_increasing_id()), "numbered-docs")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_at").alias("a"))
    classes = simhash.near_duplicates(numbered.withColumn("_order", order), id_column="_order")
    kept = classes.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.a").alias("_at"))
    return numbered.join(kept, "_at", "left_semi").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: sources at the weights of op7, with all tokens as budget."""
    plan = written(
        mixing.mixing_plan(docs, entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS), "mixture"
    )
    return mixing.mix(docs, plan).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("mixture", mixture),
    ("packing", packed),
]

# Learned models, hashes and a tokenizer decide; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
