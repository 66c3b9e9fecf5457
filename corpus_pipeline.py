"""Corpus pipeline: rules, near copies, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last keep the columns of documents. Empty
tables pass through, null text counts as empty, columns beyond those of
documents stay. The stages learn rules, hash and tokenize, which SQL can't
express, so ORACLE_SQL is None; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import chosen_path, mixing, packing, pii, rules
from talus.llm.tokenizer_files import tokenizer_path
from talus.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned decision list reject (operator 6)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, learned = rules.judge(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    # A filter on a row number can't move below the statistics, where each use would work them out again.
    judged = rules.text_statistics(rows, "_text").withColumn("_number", F.monotonically_increasing_id())
    kept = ~rules.base_failed() & rules.verdict(learned) & (F.col("_number") >= 0)
    return judged.where(kept).select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id (operator 4).

    Of several rows with that id and text the one with the smallest hash of all columns stays.
    """
    heads = chosen_path.near_classes(docs).where("stays")
    heads = heads.select(F.coalesce("doc_id", F.lit(chosen_path.NO_ID)).alias("_k1"), F.col("k2").alias("_k2")).distinct()
    keys = [F.coalesce("doc_id", F.lit(chosen_path.NO_ID)).alias("_k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k2")]
    # The given columns travel as one struct, so their names meet none of those used here.
    rows = docs.select(F.struct("*").alias("_row"), mixing.row_hash(docs).alias("_hash"), *keys)
    kept = rows.join(heads, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min_by("_row", "_hash").alias("_row"))
    return kept.select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind (operator 7)."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw every source to its target, in shuffled shards (operator 10)."""
    return mixing.materialise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents, placed in sequences (operator 5)."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
