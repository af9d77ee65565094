"""What a run leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions.text import quoted

# Keys of a page in the combined export, in order, and the fields they hold.
PAGE_KEYS = {
    "url": "url", "file": "path", "title": "title", "description": "description", "domain": "domain",
    "favicon": "favicon", "image": "image", "metaTags": "meta_tags", "parseTime": None,
    "published": "date_published", "author": "author", "site": "site", "schemaOrgData": "schema_org_data",
    "wordCount": "word_count", "content": "content",
}


def site_export(pages: DataFrame, generated_at: str | None = None) -> DataFrame:
    """O1: the combined JSON of each root as lines, ``(root_url, seq, line)``.

    ``pages`` holds ``root_url``, ``seq`` (processing order, unique per root) and
    the fields of ``PAGE_KEYS`` it has.  The lines of a root, in order of ``seq``,
    are one JSON document: an opening line, one line per page, a closing line.
    A site of any size stays many rows; only its count and last place are
    aggregated.  The pages are written first, so that they are extracted once.
    """
    pages = cut(pages.select("root_url", "seq", *sorted({f for f in PAGE_KEYS.values() if f in pages.columns})), "export-pages")
    fields = [
        (F.col(field) if field in pages.columns else F.lit(None).cast("string")).alias(key)
        for key, field in PAGE_KEYS.items()
        if field is None or field in pages.columns
    ]
    totals = pages.groupBy("root_url").agg(F.count("*").alias("total"), F.max("seq").alias("last"), F.min("seq").alias("first"))
    page = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    body = pages.join(totals, "root_url").select(
        "root_url", "seq", F.concat(page, F.when(F.col("seq") < F.col("last"), F.lit(",")).otherwise(F.lit(""))).alias("line")
    )
    root = "substr(to_json(named_struct('root_url', root_url)), 2)"
    at = "" if generated_at is None else f", {quoted(',"generated_at":' + json.dumps(generated_at))}"
    opening = f"concat('{{', left({root}, length({root}) - 1){at}, ',\"total_pages\":', total, ',\"pages\":[')"
    return (
        body.unionByName(totals.selectExpr("root_url", "first - 1 AS seq", f"{opening} AS line"))
        .unionByName(totals.selectExpr("root_url", "last + 1 AS seq", "']}' AS line"))
    )


BUCKETS = 256  # folders of a written table, whatever the number of hosts


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a domain or root."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


MANIFEST = "_manifest"


def write_documents(documents: DataFrame, target: str, extension: str = "md", buckets: int = BUCKETS, run: str = "first") -> None:
    """One row per document, in folders by hash of the domain; domain and path stay columns.

    ``documents`` holds ``domain``, ``path`` and the text.  Rows of a folder are drawn
    together for few files and sorted by domain, so that a reader of one domain
    takes one folder and skips most row groups in it; a folder that is too large
    is split over tasks.  Each run is committed by a manifest, see ``committed``.
    """
    placed = documents.withColumns({"run": F.lit(run), "extension": F.lit(extension), "bucket": bucket_of(F.col("domain"), buckets)})
    balanced = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "domain", "path")
    balanced.write.mode("append").partitionBy("run", "extension", "bucket").parquet(target)
    _commit(documents.sparkSession, target, f"run={run}/extension={extension}", documents.columns)


def in_domain(domain: str, buckets: int = BUCKETS) -> Column:
    """The filter on written documents that reads one folder only."""
    return (F.col("bucket") == bucket_of(F.lit(domain), buckets)) & (F.col("domain") == domain)


def write_site_export(export: DataFrame, target: str, buckets: int = BUCKETS, run: str = "first") -> None:
    """The lines of all roots in folders by hash of the root; by ``seq`` those of a root are its document.

    Rows are split by ranges of place, so a root of any size is spread over
    tasks.  Finding the ranges reads the input once more, which is why it is
    written to the checkpoint folder first.
    """
    placed = export.select(F.lit(run).alias("run"), F.lit("json").alias("extension"), bucket_of(F.col("root_url"), buckets).alias("bucket"), "root_url", "seq", "line")
    lines = cut(placed, "site-export")
    ordered = lines.repartitionByRange("bucket", "root_url", "seq").sortWithinPartitions("bucket", "root_url", "seq")
    ordered.write.mode("append").partitionBy("run", "extension", "bucket").parquet(target)
    _commit(export.sparkSession, target, f"run={run}/extension=json", ["root_url", "seq", "line"])


def _sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and digest of each folder; the digest does not depend on the order of rows."""
    digest = F.sum(F.xxhash64(*sorted(columns)).cast("decimal(20,0)"))
    return rows.groupBy("run", "extension", "bucket").agg(F.count("*").alias("rows"), digest.alias("digest"))


def _commit(spark: SparkSession, target: str, part: str, columns: list[str]) -> None:
    """Record what a run has left in each folder; it counts from the moment this table is complete."""
    written = spark.read.option("basePath", target).parquet(f"{target}/{part}")
    _sums(written, columns).drop("run", "extension").coalesce(1).write.mode("overwrite").parquet(f"{target}/{MANIFEST}/{part}")


def committed(spark: SparkSession, target: str, verify: bool = True) -> DataFrame:
    """The rows of all committed runs under ``target``; those of a run that broke off before its manifest are left out.

    With ``verify`` every folder is compared with its manifest before, and missing, added or changed rows are an error.
    """
    manifest = spark.read.parquet(f"{target}/{MANIFEST}")
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in ("run", "extension", "bucket")]
    rows = rows.join(manifest.select("run", "extension").distinct(), ["run", "extension"], "left_semi")
    if verify:
        promised = manifest.select("run", "extension", "bucket", F.col("rows").alias("promised"), F.col("digest").alias("expected"))
        both = _sums(rows, columns).join(promised, ["run", "extension", "bucket"], "full")
        bad = both.where(~(F.col("rows").eqNullSafe(F.col("promised")) & F.col("digest").eqNullSafe(F.col("expected"))))
        worst = bad.orderBy("run", "extension", "bucket").limit(5).collect()
        if worst:
            raise ValueError(f"written data differ from the manifest of {target}: {[tuple(r) for r in worst]}")
    return rows
