"""From documents to encoded training data: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.checkpoints import checkpoint_root
from sitecorpus.llm import byte_bpe, decontaminate, jaccard_join, quality, secrets
from sitecorpus.llm.common import free_name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    out = free_name(docs, "quality_rules")
    judged = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out=out)
    return judged.where(F.col(out)["kept"]).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies the one with the smallest id stays (all its rows)."""
    found = jaccard_join.near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    out = free_name(docs, "contamination")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.where(F.size(F.col(out)["spans"]) == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` follows where it is there."""
    out = free_name(docs, "secrets")
    found = secrets.scan(docs, out=out)
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col(out)))
    if "n_chars" in docs.columns:
        changed = F.size(out) > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), exact.alias("exact"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("encoding", encoding_stage),
]

#: Trained verdicts and chosen paths have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    folder = f"{checkpoint_root(spark)}/sitecorpus-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
