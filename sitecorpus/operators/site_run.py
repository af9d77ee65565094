"""A whole run, from roots to files, for many sites at once.

The run keeps a ledger: one row for each URL that a site lists or a crawl finds,
in processing order.  Every stage reads the open rows and closes those it can take no
further, with the outcome as the reason; no stage drops a row.  The rows
that are still open at the end are saved.

=============  =========================================================
``no_urls``    neither a sitemap nor a crawl gave the root any URL
``disallowed`` robots rules deny the URL
``empty_body`` no snapshot, a failed fetch, or an empty body
``no_content`` nothing was left of the page after extraction
``not_saved``  a part of the path is longer than a file system takes
``saved``      the document is written under ``path``
=============  =========================================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import urls
from sitecorpus.operators import crawl, documents, render, robots, sitemaps
from sitecorpus.operators.crawl import discovery_order
from sitecorpus.operators.extract import Options
from sitecorpus.operators.running import WIDTH
from sitecorpus.sources.snapshots import with_sitemap_test

#: Bytes of one part of a path that file systems take.
PART_BYTES = 255
EXTENSIONS = {"markdown": "md", "html": "html"}


@dataclass(frozen=True)
class Run:
    """``ledger``: ``root_url, seq, url, source, page_id, outcome, path``.  ``files``: ``root_url, seq, path, domain, document``, one row a file."""

    ledger: DataFrame
    files: DataFrame


@dataclass(frozen=True)
class Rules:
    """How a run treats its sites."""

    agent: str
    max_depth: int = 5
    respect_robots: bool = True
    policy_403: str = "allow"
    sitemap_only: bool = False
    single_site: bool = False
    fmt: str = "markdown"
    options: Options = Options()


def listed_urls(roots: DataFrame, pages: DataFrame, robots_docs: DataFrame, sitemap_docs: DataFrame, rules: Rules, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(root_url, seq, url, source)`` of all URLs to process, in order, and the policies of the sites.

    ``roots`` holds ``root_url, root_netloc``; ``pages`` holds ``page_id, url, html, ok`` with one row per crawl key.
    A root without a sitemap is crawled; one without any URL keeps a row without one.
    """
    policies = robots.site_policies(robots_docs, rules.agent)
    docs = cut(with_sitemap_test(sitemap_docs), "sitemaps")
    open_docs = robots.with_decision(docs, policies, policy_403=rules.policy_403, respect=rules.respect_robots).where("allowed").select("url", "body", "valid")
    candidates = sitemaps.sitemap_candidates(roots, policies if rules.respect_robots else None)
    expanded = cut(sitemaps.expand_sitemaps(sitemaps.chosen_sitemaps(candidates, open_docs), sitemaps.sitemap_locs(open_docs), width), "expanded")
    # Only roots without a sitemap are walked.
    bare = cut(roots.join(expanded.select("root_url").distinct(), "root_url", "left_anti"), "bare-roots")
    if rules.sitemap_only:
        bare = bare.limit(0)
    walked = crawl.crawl(bare, crawl.crawl_edges(pages), rules.max_depth, True, width, policies if rules.respect_robots else None, rules.policy_403)
    found = cut(sitemaps.url_sources(roots, expanded, crawl.with_outcome(walked, pages)), "found")
    order = found.where("url is not null").select("root_url", "url", "source", F.col("ord").alias("parent_ord"), "pos")
    listed = discovery_order(cut(order, "order"), width=width).select("root_url", F.col("rank").alias("seq"), "url", "source")
    none = found.where("url is null").select("root_url", F.lit(0).cast("long").alias("seq"), "url", "source")
    return listed.unionByName(none), policies


def run_sites(roots: DataFrame, pages: DataFrame, robots_docs: DataFrame, sitemap_docs: DataFrame, rules: Rules, extracted_at: str | None = None, width: int = WIDTH) -> Run:
    """The ledger and the files of a run over stored snapshots."""
    listed, policies = listed_urls(roots, pages, robots_docs, sitemap_docs, rules, width)
    decided = robots.with_decision(listed, policies, policy_403=rules.policy_403, respect=rules.respect_robots)
    snapshots = pages.select(F.col("url").alias("url_key"), "page_id", "ok")
    fetched = urls.with_page_key(decided.withColumn("allowed", F.coalesce("allowed", F.lit(True)))).join(snapshots, "url_key", "left")
    outcome = (
        F.when(F.col("url").isNull(), "no_urls")
        .when(~F.col("allowed"), "disallowed")
        .when(~F.coalesce("ok", F.lit(False)), "empty_body")
    )
    ledger = cut(fetched.select("root_url", "seq", "url", "source", F.when(outcome.isNull(), F.col("page_id")).alias("page_id"), outcome.alias("outcome")), "ledger-fetched")

    # A page listed more than once, or under several roots, is extracted once.
    wanted = ledger.where("outcome is null").select("page_id").distinct()
    rendered = render.rendered_pages(pages.join(wanted, "page_id", "left_semi").select("page_id", "url", "html"), rules.fmt, rules.options)
    rendered = cut(rendered.drop("meta_tags", "schema_org_data", "favicon", "image", "site", "word_count"), "run-rendered")
    extracted = ledger.join(rendered.select("page_id", F.col("ok").alias("filled")), "page_id", "left")
    ledger = extracted.withColumn("outcome", F.coalesce("outcome", F.when(~F.col("filled"), F.lit("no_content")))).drop("filled")

    extension = EXTENSIONS[rules.fmt]
    placed = documents.with_path(ledger, "url", extension, rules.single_site, "want")
    ledger = cut(_closed(placed, "want"), "ledger-extracted")
    claims = ledger.where("outcome is null").select("root_url", "seq", "url", "want")
    files = cut(documents.assigned_within(claims, "root_url", extension, width), "files")
    ledger = cut(
        _closed(ledger.join(files.drop("last"), ["root_url", "seq"], "left").drop("want"), "path").select(
            "root_url", "seq", "url", "source", "page_id",
            F.coalesce("outcome", F.lit("saved")).alias("outcome"),
            F.when(F.col("outcome").isNull(), F.col("path")).alias("path"),
        ),
        "ledger",
    )
    kept = ledger.where("outcome = 'saved'").join(files.where("last").select("root_url", "seq"), ["root_url", "seq"], "left_semi")
    written = kept.select("root_url", "seq", "url", "page_id", "path").join(rendered.drop("url", "ok"), "page_id")
    if rules.fmt == "markdown":
        written = documents.with_front_matter(written, extracted_at)
    else:
        written = written.withColumn("document", F.col("content"))
    return Run(ledger, written.select("root_url", "seq", "path", "domain", "document"))


def _closed(rows: DataFrame, path: str) -> DataFrame:
    """Close open rows whose path a file system would refuse."""
    longest = F.array_max(F.transform(F.split(path, "/"), F.octet_length))
    return rows.withColumn("outcome", F.coalesce("outcome", F.when(longest > PART_BYTES, F.lit("not_saved"))))


def run_summary(ledger: DataFrame) -> DataFrame:
    """O2: successes and failures per root, and how many failed for each reason, as the ledger has them."""
    reasons = ("disallowed", "empty_body", "no_content", "not_saved")

    def count(of: Column) -> Column:
        return F.count_if(of)

    outcome = F.col("outcome")
    return ledger.groupBy("root_url").agg(
        count(outcome == "saved").alias("successful"),
        count(outcome.isin(*reasons)).alias("failed"),
        *[count(outcome == name).alias(name) for name in reasons],
        F.bool_or(outcome == "no_urls").alias("no_urls"),
    )
