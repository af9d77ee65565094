"""Which URLs a crawl reaches, for many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut, cut_bucketed
from sitecorpus.functions import urls
from sitecorpus.functions.urls import is_internal
from sitecorpus.operators.links import page_links
from sitecorpus.operators.robots import with_decision
from sitecorpus.operators.running import WIDTH, running_sum


def crawl_edges(site_pages: DataFrame) -> DataFrame:
    """Edges ``(source, target, target_netloc, pos)`` of fetched pages, first position per target.

    A failed or disallowed page (``ok`` false) has no out-edges.  The test
    against the root's host is left to the crawl, which knows the root.
    """
    links = page_links(site_pages.where("ok")).where("crawlable")
    return links.groupBy(F.col("url").alias("source"), "target", "target_netloc").agg(F.min("pos").alias("pos"))


def discovery_order(found: DataFrame, root: str = "root_url", width: int = WIDTH) -> DataFrame:
    """Number rows 1, 2, ... per root by parent order, then position; adds ``rank``.

    ``found`` is already written.  Rows of one parent are numbered among themselves, which a page bounds; the
    offset of a parent is a running sum that stays split for a root of any size.
    """
    per_parent = found.groupBy(root, "parent_ord").agg(F.count("*").alias("children"))
    offsets = running_sum(per_parent, [root], "parent_ord", F.col("children"), "upto", width)
    own = Window.partitionBy(root, "parent_ord").orderBy("pos")
    return (
        found.withColumn("own", F.row_number().over(own))
        .join(offsets, [root, "parent_ord"])
        .withColumn("rank", F.col("upto") - F.col("children") + F.col("own"))
        .drop("own", "upto", "children")
    )


def crawl(
    roots: DataFrame,
    edges: DataFrame,
    max_depth: int = 5,
    ordered: bool = False,
    width: int = WIDTH,
    policies: DataFrame | None = None,
    policy_403: str = "allow",
) -> DataFrame:
    """``(root_url, url, url_key, depth, allowed)`` of every URL visited, each at its least depth.

    ``roots`` holds ``root_url, root_netloc``.  A root is visited as given, so it and the same page under its
    crawl key are two URLs; both read the snapshot and the links of that key.  With ``policies``
    (``site_policies``) a URL that robots disallow is visited and has no links.  With ``ordered`` each URL
    also gets ``ord``, its place in the order of discovery.

    One round per depth, bounded by ``max_depth``.  Edges are written once in buckets by source, and visited
    URLs round by round in buckets by root and URL, so a round shuffles the newest URLs alone.
    """
    edges = cut_bucketed(edges.select("source", "target", "target_netloc", "pos"), "edges", ["source"])
    start = roots.select("root_url", "root_netloc").distinct()
    start = urls.with_page_key(start.withColumn("url", F.col("root_url"))).withColumns({"depth": F.lit(0), "ord": F.lit(1).cast("long")})
    frontier = _round(start, policies, policy_403)
    rounds = [frontier]
    for depth in range(1, max_depth + 1):
        new = found_links(frontier, edges)
        for earlier in rounds:
            new = new.join(earlier.select("root_url", "url"), ["root_url", "url"], "left_anti")
        new = new.select("root_url", "root_netloc", "url", F.col("url").alias("url_key"), F.lit(depth).alias("depth"), "first.parent_ord", "first.pos")
        if ordered:
            seen = frontier.groupBy("root_url").agg(F.max("ord").alias("seen"))
            new = (
                discovery_order(cut(new, "crawl-found"), width=width)
                .join(seen, "root_url")
                .withColumn("ord", F.col("seen") + F.col("rank"))
            )
        else:
            new = new.withColumn("ord", F.lit(0).cast("long"))
        frontier = _round(new, policies, policy_403)
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    visited = rounds[0]
    for later in rounds[1:]:
        visited = visited.unionByName(later)
    return visited.select("root_url", "url", "url_key", "depth", "allowed", *(["ord"] if ordered else []))


def _round(new: DataFrame, policies: DataFrame | None, policy_403: str) -> DataFrame:
    """The URLs of one depth with the decision on each, written."""
    kept = ["root_url", "root_netloc", "url", "url_key", "depth", "ord"]
    if policies is None:
        new = new.select(*kept, F.lit(True).alias("allowed"))
    else:
        new = with_decision(new.select(*kept), policies, "url", policy_403).select(*kept, "allowed")
    return cut_bucketed(new, "crawl", ["root_url", "url"])


def found_links(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """``root_url, url, root_netloc, first`` of what the allowed URLs of one round link to; ``first`` is the first place."""
    reached = frontier.where("allowed").join(edges, F.col("url_key") == F.col("source")).where(
        is_internal(F.col("target_netloc"), F.col("root_netloc"))
    )
    return reached.groupBy("root_url", F.col("target").alias("url")).agg(
        F.min("root_netloc").alias("root_netloc"), F.min(F.struct(F.col("ord").alias("parent_ord"), "pos")).alias("first")
    )


def with_outcome(visited: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Add ``ok``, whether the visit gave content, and the ``page_id`` it came from."""
    status = site_pages.select(F.col("url").alias("url_key"), "page_id", F.col("ok").alias("fetched"))
    ok = F.coalesce("fetched", F.lit(False)) & F.col("allowed")
    return visited.join(status, "url_key", "left").select(*visited.columns, F.when(ok, F.col("page_id")).alias("page_id"), ok.alias("ok"))


def depth_histogram(outcome: DataFrame) -> DataFrame:
    """C4: URLs visited, fetched and failed per root and depth."""
    return outcome.groupBy("root_url", "depth").agg(
        F.count("*").alias("visited"),
        F.count_if(F.col("ok")).alias("fetched"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
