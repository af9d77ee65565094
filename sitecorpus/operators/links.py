"""The link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecorpus.functions import markup, urls

ANCHORS = markup.any_of(
    markup.COMMENT, markup.raw_element("script"), markup.raw_element("style"), r"a[\s/]" + markup.TAG_BODY + ">"
)
# Fixed value: the tolerant pattern; it also takes tags whose name only starts with "a".
LOOSE_ANCHOR = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""


def page_links(pages: DataFrame, mode: str = "html", root_netloc: str | None = None) -> DataFrame:
    """L1 and L2: every followable link of each page, in document order.

    ``pages`` needs ``page_id``, ``url`` and ``html``.  ``root_netloc`` names a
    column with the host that counts as internal; the page's own by default.
    Gives ``page_id, url, pos, href, target, target_netloc, internal, crawlable``.
    """
    if mode not in ("html", "regex"):
        raise ValueError(f"unknown link mode {mode!r}")
    if mode == "html":
        # Comments and raw text are matched too, so anchors inside them are passed over.
        tags = markup.tags_sql("html", ANCHORS, "<a")
        hrefs = F.expr(f"transform({tags}, a -> {markup.attribute_sql('a', 'href')})")
    else:
        hrefs = F.regexp_extract_all("html", F.lit(LOOSE_ANCHOR), F.lit(1))
    kept = [c for c in ("page_id", "url", root_netloc) if c]
    df = urls.with_url_parts(pages, "url", "b_").select(
        *kept, *[f"b_{part}" for part in urls.PARTS], F.posexplode(hrefs).alias("pos", "href")
    )
    df = df.where(F.col("href").isNotNull() & ~urls.is_skipped_href(F.col("href")))
    df = urls.with_target(df, "href", "b_")
    root = F.col(root_netloc) if root_netloc else F.col("b_netloc")
    return df.select(
        "page_id",
        "url",
        "pos",
        "href",
        "target",
        "target_netloc",
        urls.is_internal(F.col("target_netloc"), root).alias("internal"),
        urls.is_crawlable(F.col("target_scheme"), F.col("target_path")).alias("crawlable"),
    )


def followed(links: DataFrame) -> DataFrame:
    return links.where(F.col("internal") & F.col("crawlable"))


def internal_edges(links: DataFrame) -> DataFrame:
    """L3: distinct (source key, target key); a page linking to itself counts."""
    keyed = urls.with_page_key(followed(links).select("url", "target"))
    return keyed.select(F.col("url_key").alias("source"), "target").distinct()


def links_per_page(pages: DataFrame, links: DataFrame) -> DataFrame:
    """L4: followed links of each page, repeats counted, 0 if none."""
    counts = followed(links).groupBy("page_id").agg(F.count("*").alias("n_links"))
    return (
        pages.select("page_id")
        .join(counts, "page_id", "left")
        .select("page_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def dropped_links(links: DataFrame) -> DataFrame:
    """Links a crawl drops, by page host, target host and reason."""
    reason = F.when(~F.col("internal"), F.lit("external")).otherwise(F.lit("not_a_page"))
    host = urls.with_url_parts(links.where(~(F.col("internal") & F.col("crawlable"))), "url", "p_")
    return host.groupBy(
        F.col("p_netloc").alias("host"), F.col("target_netloc").alias("target_host"), reason.alias("reason")
    ).agg(F.count("*").alias("n_links"))


def url_profile(pages: DataFrame) -> DataFrame:
    """One row per host with what its page URLs look like."""
    df = urls.with_url_parts(urls.with_page_key(pages.select("page_id", "url")), "url", "p_")
    crawlable = urls.is_crawlable(F.col("url_key_scheme"), F.col("url_key_path"))
    return df.groupBy(F.col("p_netloc").alias("host"), urls.output_root(F.col("p_netloc")).alias("output_root")).agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("p_query") != "").alias("n_query"),
        F.count_if(F.col("p_fragment") != "").alias("n_fragment"),
        F.count_if(crawlable).alias("n_crawlable"),
        F.count_if(urls.is_internal(F.col("url_key_netloc"), F.col("p_netloc"))).alias("n_internal"),
        F.countDistinct("url_key").alias("n_url_keys"),
        F.countDistinct(urls.document_key(F.col("url"))).alias("n_document_keys"),
        F.countDistinct("p_scheme").alias("n_schemes"),
    )
