"""F9 over stored tables: a new run rewrites the buckets it touches and no others.

Documents lie in buckets by hash of the name that their path was made from, numbers
taken off, so whatever can replace a document or clash with its path is in its bucket.
A run reads the buckets of its own pages, merges, and writes them anew beside the old ones.
Last it writes the manifest, one file that says for each bucket which run holds it:
until then readers see the state before, and what a broken run left is never read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.operators.documents import NUMBER, _stem_and_ending, assigned_paths, merged_documents, with_path

#: Buckets of a stored table.
BUCKETS = 256
MANIFEST = "_manifest"


def bucket_of(path: Column, buckets: int) -> Column:
    """The bucket of a path, the same for all numbers of a name."""
    stem, ending = _stem_and_ending(path)
    base = F.concat(F.regexp_replace(stem, f"(?:{NUMBER[:-2]})+\\z", ""), ending)
    return F.pmod(F.xxhash64(base), F.lit(buckets)).cast("int")


def create(docs: DataFrame, target: str, single_site: bool = False, buckets: int = BUCKETS) -> None:
    """Store a first run ``(seq, url, content)`` under ``target``."""
    files = assigned_paths(docs, single_site=single_site).select("path", "url", "content")
    _write(docs.sparkSession, files, target, buckets, None, 0)


def current(spark: SparkSession, target: str) -> DataFrame:
    """``path, url, content`` of the stored documents as of the last committed run."""
    held, _, _ = _manifest(spark, target)
    return _read(spark, target, held).select("path", "url", "content")


def upsert(new: DataFrame, target: str, single_site: bool = False) -> DataFrame:
    """Merge a run ``(seq, url, content)`` into the stored documents; gives ``path, url, state`` of the buckets it rewrote.

    At most one number for each bucket comes to the driver.
    """
    spark = new.sparkSession
    held, buckets, version = _manifest(spark, target)
    wanted = with_path(new.select("url"), "url", "md", single_site, "want").select(bucket_of(F.col("want"), buckets).alias("bucket"))
    touched = sorted(r.bucket for r in wanted.distinct().collect())
    stored = _read(spark, target, {b: run for b, run in held.items() if b in set(touched)}).select("path", "url", "content")
    merged = cut(merged_documents(stored, new, single_site), "merged")
    if touched:
        _write(spark, merged.select("path", "url", "content"), target, buckets, held, version + 1)
    return merged.select("path", "url", "state")


def _write(spark: SparkSession, files: DataFrame, target: str, buckets: int, held: dict[int, str] | None, version: int) -> None:
    run = uuid.uuid4().hex
    placed = files.withColumns({"run": F.lit(run), "bucket": bucket_of(F.col("path"), buckets)})
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "path").write.mode("append").partitionBy("run", "bucket").parquet(f"{target}/data")
    filled = [r.bucket for r in spark.read.parquet(f"{target}/data").where(F.col("run") == run).select("bucket").distinct().collect()] if not files.isEmpty() else []
    now = {**(held or {}), **dict.fromkeys(filled, run)}
    rows = [(b, r) for b, r in sorted(now.items())] or [(-1, "")]
    manifest = spark.createDataFrame(rows, "bucket int, held_by string").withColumn("buckets", F.lit(buckets))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{target}/{MANIFEST}/version={version}")


def _manifest(spark: SparkSession, target: str) -> tuple[dict[int, str], int, int]:
    """Which run holds each bucket, the number of buckets, and the version of that state."""
    manifests = spark.read.parquet(f"{target}/{MANIFEST}")
    version = manifests.agg(F.max("version")).first()[0]
    rows = manifests.where(F.col("version") == version).collect()
    return {r.bucket: r.held_by for r in rows if r.held_by}, rows[0].buckets, version


def _read(spark: SparkSession, target: str, held: dict[int, str]) -> DataFrame:
    """The files of these buckets; the filter is on folders alone."""
    if not held:
        return spark.createDataFrame([], "path string, url string, content string")
    of: dict[str, list[int]] = {}
    for bucket, run in held.items():
        of.setdefault(run, []).append(bucket)
    wanted = reduce(lambda a, b: a | b, [(F.col("run") == run) & F.col("bucket").isin(list_) for run, list_ in of.items()])
    return spark.read.schema("path string, url string, content string, run string, bucket int").parquet(f"{target}/data").where(wanted)
