"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents.
Null texts stay null unless a stage changes them; empty tables pass through; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.llm import common, dedup, minhash, packing, substring
from impactgraph.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by models learnt from the labelled ones among them. Rows with equal texts get equal scores, so they stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; rows that repeat its id as well become one."""
    kept = dedup.exact_dedup(docs).where("kept")
    again = kept.groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_sha256"])
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate component; rows that share an id are told apart by their texts. Rows that repeat an id and a text stay or go together."""
    kept = minhash.near_dedup(docs, text_hash="__hash").where("kept").select(F.col("doc_id").alias("__kept"), "__hash").distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & minhash.hash_of("text").eqNullSafe(F.col("__hash")), "left_semi")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where repeated windows were found, the text is its remaining words joined by one space."""
    out = substring.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens. Repeated rows are documents of their own."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot encode tokens or search neighbours; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables are deleted when its result is written."""
    docs, began = common.documents(spark, sf_dir), common.staged_count()
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.sweep(spark, began, (docs,))
    return docs
