"""The stored web as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.functions import urls


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def latest_pages(pages: DataFrame) -> DataFrame:
    """The latest page id per crawl key: ``page_id, url_key, scheme, netloc``.

    Only the narrow columns are read and the maximum is taken map-side first,
    so many copies of one URL never meet in one task with their HTML.
    """
    keyed = urls.with_page_key(pages.select("page_id", "url"))
    return keyed.groupBy(
        "url_key", F.col("url_key_scheme").alias("scheme"), F.col("url_key_netloc").alias("netloc")
    ).agg(F.max("page_id").alias("page_id"))


def fetched_pages(pages: DataFrame) -> DataFrame:
    """The latest snapshot per crawl key; an empty body is a failed fetch."""
    return (
        pages.select("page_id", "html")
        .join(latest_pages(pages), "page_id")
        .select("page_id", "url_key", "scheme", "netloc", "html", is_fetched(F.col("html")).alias("ok"))
    )


def is_fetched(html: Column) -> Column:
    return F.coalesce(html, F.lit("")) != ""


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """``robots_docs(site, status, body)``."""
    return spark.read.schema("site string, status int, body string").parquet(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``sitemap_docs(url, body)`` with the root-document test."""
    return with_sitemap_test(spark.read.schema("url string, body string").parquet(path))


def with_sitemap_test(sitemap_docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("body"), F.lit(""))
    return sitemap_docs.withColumn(
        "valid", body.contains("<?xml") & (body.contains("<urlset") | body.contains("<sitemapindex"))
    )
