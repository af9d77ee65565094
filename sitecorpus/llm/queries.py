"""One query for each operator, over its whole table, with its production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.checkpoints import checkpoint_root
from sitecorpus.llm import byte_bpe, decontaminate, divergence, fill_in_middle, jaccard_join, language, orc_ids, piecewise_hash, quality, recurrent_lm, secrets, token_counts, warc
from sitecorpus.llm.oracles import ORACLES as ORACLES

END_ID = 2
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/sitecorpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "contamination.n_words",
        n_hit.alias("n_hit"),
        F.size("contamination.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("contamination.item_ids")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "contamination.spans",
    )


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = recurrent_lm.score(_documents(spark, sf_dir).select("doc_id", "text"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "orc_ids")
    orc_ids.write_ids(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, END_ID)
    return orc_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", orc_ids.ids_crc32().alias("ids_crc32"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = byte_bpe.decode(byte_bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), path, pattern), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality_rules.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    kinds = [k for k, *_ in secrets.KINDS]
    base = F.filter("secrets", lambda x: x["kind"].isin(kinds))
    counts = [F.size(F.filter("secrets", secrets.is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.where(~F.coalesce(held_out, F.lit(False))), public_tokenizers.path("piece_bpe_32k.model"))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.*")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("fim.form"), F.col("fim.output"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = piecewise_hash.edited_pairs(_documents(spark, sf_dir).select("doc_id", "text"))
    own = F.col("fingerprint")
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        piecewise_hash.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        piecewise_hash.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_recurrent_lm": op2_recurrent_lm,
    "op3_orc_ids": op3_orc_ids,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_piecewise_hash": op13_piecewise_hash,
}
