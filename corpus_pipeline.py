"""A corpus from raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.cluster import delete, shared_folder
from keyweave.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from keyweave.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go, and documents of which nothing is left; ``n_chars`` follows the text."""
    rows = line_dedup.dedup_lines(docs)
    removed = F.col(rows.columns[-1])
    rows = rows.where((removed == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(removed == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard", drop_near_copies), ("decontamination", decontaminated), ("bpe", encode)]

#: The toxicity model and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder; those of the stages before it are dropped as soon as the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
