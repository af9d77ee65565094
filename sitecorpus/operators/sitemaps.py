"""M1 to M5: finding, reading and expanding sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import markup, urls
from sitecorpus.functions.text import quoted
from sitecorpus.operators.crawl import discovery_order
from sitecorpus.operators.running import WIDTH

# Where a site's sitemap is looked for, in this order.
SITEMAP_PATHS = [
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap/", "/sitemap/sitemap.xml",
    "/sitemaps/sitemap.xml", "/wp-sitemap.xml", "/sitemap-index.xml",
]


def sitemap_candidates(roots: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """M1: ``(root_url, priority, url)``; sitemaps named in robots files come first.

    Without ``policies`` robots files are ignored and only the usual paths are left.
    """
    df = urls.with_url_parts(roots.select("root_url"), "root_url", "r_")
    df = df.select("root_url", urls.site_key(F.col("r_scheme"), F.col("r_netloc")).alias("site"))
    usual = F.transform(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), lambda p: F.concat("site", p))
    if policies is None:
        listed = F.array().cast("array<string>")
    else:
        df = df.join(policies.select("site", "sitemaps"), "site", "left")
        listed = F.coalesce("sitemaps", F.array().cast("array<string>"))
    return df.select("root_url", F.posexplode(F.concat(listed, usual)).alias("priority", "url"))


def chosen_sitemaps(candidates: DataFrame, sitemap_docs: DataFrame) -> DataFrame:
    """M2: ``(root_url, url)`` of the first candidate that can be fetched and passes the root test.

    ``sitemap_docs`` holds ``url, valid`` and only documents that may be fetched.
    """
    found = candidates.join(sitemap_docs.where("valid").select("url"), "url", "left_semi")
    return found.groupBy("root_url").agg(F.min_by("url", "priority").alias("url"))


def looks_like_sitemap(url: Column) -> Column:
    return url.endswith(".xml") | F.lower(url).contains("sitemap")


CDATA = r"<!\[CDATA\[[\s\S]*?(?:\]\]>|\z)"
# One piece of XML: comment, a run of text and CDATA, instruction, declaration, tag, a tag that the end cuts off.
PIECES = (
    r"<!--[\s\S]*?(?:-->|\z)|(?:" + CDATA + r"|[^<]++|<(?!/?[A-Za-z_:]|/?\z|[!?]))++|<\?[\s\S]*?(?:\?>|\z)|<![^>]*(?:>|\z)"
    r"""|</?[A-Za-z_:](?:"[^"]*+"|'[^']*+'|[^<>"'])*+>|</?(?:[A-Za-z_:][^<>]*)?\z|<"""
)
DROPPED = r"^<\?|^<!(?!--|\[CDATA\[)|^</?(?:[A-Za-z_:][^<>]*)?\z|^\s*\z"


def sitemap_events(sitemap_docs: DataFrame) -> DataFrame:
    """``(doc_url, pos, kind, name, text, level)``: the tags and texts of each document, as a recovering parser reads them.

    An end tag closes the innermost open element, whatever its name; what is open at the end of the text ends there;
    what follows the root element, or a text that starts with no tag, does not count.  ``level`` is the depth of
    the element that a tag opens or closes.  A document is one input row, which bounds its windows.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^[\ufeff\\s]+", "")
    pieces = F.filter(
        F.when(body.startswith("<"), F.regexp_extract_all(body, F.lit(PIECES), F.lit(0))),
        lambda p: ~p.rlike(DROPPED),
    )
    partitions = int(sitemap_docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sitemap_docs.select(F.col("url").alias("doc_url"), "body").repartition(partitions, "doc_url").select("doc_url", F.posexplode(pieces).alias("pos", "piece"))
    piece = F.col("piece")
    kind = (
        F.when(piece.startswith("<!--"), "comment")
        .when(piece.startswith("<![CDATA[") | ~piece.rlike("^</?[A-Za-z_:]"), "text")
        .when(piece.startswith("</"), "close")
        .when(piece.endswith("/>"), "void")
        .otherwise("open")
    )
    plain, quoted_cdata = markup.decoded_sql("t", loose=False), quoted("^" + CDATA)
    text = F.expr(
        f"""array_join(transform(regexp_extract_all(piece, {quoted(CDATA + "|[^<]+|<")}, 0),
          t -> IF(regexp_like(t, {quoted_cdata}), regexp_replace(substr(t, 10), '\\\\]\\\\]>\\\\z', ''), {plain})), '')"""
    )
    so_far = Window.partitionBy("doc_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kind", kind).withColumn("depth", F.sum(F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)).over(so_far))
    over = F.max((F.col("kind") == "close") & (F.col("depth") <= 0)).over(before)
    return rows.withColumn("over", over).where("over IS NULL OR NOT over").select(
        "doc_url",
        "pos",
        "kind",
        F.when(F.col("kind").isin("open", "close", "void"), F.regexp_extract("piece", r"^</?([^\s/>]+)", 1)).alias("name"),
        F.when(F.col("kind") == "text", text).alias("text"),
        (F.col("depth") + F.when(F.col("kind") == "open", 0).otherwise(1)).alias("level"),
    )


def sitemap_locs(sitemap_docs: DataFrame) -> DataFrame:
    """M3: ``(doc_url, kind, pos, loc, nested)``; text that is no sitemap gives no rows, broken XML what a recovering parser finds.

    Of a document with a ``sitemapindex`` the ``sitemap`` elements count, else the ``url`` elements; each gives its
    first ``loc``, which holds text alone.  ``nested`` tells whether any entry of the document looks like a sitemap.
    """
    in_order = Window.partitionBy("doc_url").orderBy("pos")
    whole = Window.partitionBy("doc_url")
    same_level = Window.partitionBy("doc_url", "level").orderBy("pos")
    backwards = Window.partitionBy("doc_url").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    events = sitemap_events(sitemap_docs)
    is_tag = F.col("kind").isin("open", "void")
    # A loc counts if one run of text is followed by its end, or by that of the document.
    alone = (F.lead("kind", 1).over(in_order) == "text") & (F.coalesce(F.lead("kind", 2).over(in_order), F.lit("close")) == "close")
    text = F.when((F.col("kind") == "open") & alone, F.regexp_replace(F.lead("text", 1).over(in_order), r"^\s+|\s+\z", "")).otherwise(F.lit(""))
    events = events.withColumns(
        {
            "is_index": F.max(is_tag & (F.col("name") == "sitemapindex")).over(whole),
            "span_end": F.when(F.col("kind") == "open", F.lead("pos").over(same_level)),
            "loc": F.when(is_tag & (F.col("name") == "loc"), F.struct("pos", text.alias("text"))),
        }
    ).withColumn("first", F.last("loc", ignorenulls=True).over(backwards))
    wanted = F.when(F.col("is_index"), "sitemap").otherwise("url")
    entries = events.where((F.col("kind") == "open") & (F.col("name") == wanted) & (F.col("first.text") != "")).where(
        "span_end IS NULL OR first.pos < span_end"
    )
    return entries.select(
        "doc_url",
        F.when(F.col("is_index"), "index").otherwise("urlset").alias("kind"),
        (F.row_number().over(in_order) - 1).alias("pos"),
        F.col("first.text").alias("loc"),
        F.max(looks_like_sitemap(F.col("first.text"))).over(whole).alias("nested"),
    )


def expand_sitemaps(chosen: DataFrame, locs: DataFrame, width: int = WIDTH) -> DataFrame:
    """M4: page URLs of each root, ``(root_url, url, ord, pos)`` in the order they come out.

    A queued URL is handled once, at its first place in the queue.  One that
    looks like a sitemap is opened: if any of its entries looks like a sitemap
    all of them join the queue, else all come out, repeats included.  The queue
    shrinks to nothing because handled URLs never come back and there are only so many.
    """
    locs = cut(locs, "sitemap-locs")
    queue = chosen.join(locs, F.col("url") == F.col("doc_url")).select(
        "root_url", F.col("loc").alias("url"), F.lit(0).cast("long").alias("parent_ord"), "pos"
    )
    first = F.min(F.struct("parent_ord", "pos")).alias("first")
    handled, out = None, None
    done = chosen.select("root_url", F.lit(0).cast("long").alias("seen"))
    while True:
        new = queue.groupBy("root_url", "url").agg(first)
        if handled is not None:
            new = new.join(handled, ["root_url", "url"], "left_anti")
        new = cut(new.select("root_url", "url", "first.parent_ord", "first.pos"), "queue-found")
        if new.isEmpty():
            break
        ordered = discovery_order(new, width=width).join(done, "root_url").select(
            "root_url", "url", (F.col("seen") + F.col("rank")).alias("ord")
        )
        items = cut(ordered, "queue")
        done = items.groupBy("root_url").agg(F.max("ord").alias("seen"))
        keys = items.select("root_url", "url")
        handled = keys if handled is None else handled.union(keys)
        opened = items.where(looks_like_sitemap(F.col("url"))).join(locs, F.col("url") == F.col("doc_url"))
        leaves = opened.where("not nested").select("root_url", F.col("loc").alias("url"), "ord", "pos")
        plain = items.where(~looks_like_sitemap(F.col("url"))).select("root_url", "url", "ord", F.lit(0).alias("pos"))
        pages = plain.unionByName(leaves)
        out = pages if out is None else out.unionByName(pages)
        queue = opened.where("nested").select("root_url", F.col("loc").alias("url"), F.col("ord").alias("parent_ord"), "pos")
    if out is None:
        out = queue.select("root_url", "url", F.col("parent_ord").alias("ord"), "pos").limit(0)
    return out


def url_sources(roots: DataFrame, from_sitemaps: DataFrame, crawled: DataFrame, sitemap_only: bool = False) -> DataFrame:
    """M5: the URLs to process per root and where they come from.

    ``crawled`` holds ``root_url, url, ord, ok``.  Roots without any URL keep
    one row with source ``none``.
    """
    mapped = from_sitemaps.select("root_url", "url", "ord", "pos", F.lit("sitemap").alias("source"))
    with_map = mapped.select("root_url").distinct()
    found = mapped
    if not sitemap_only:
        walked = crawled.where("ok").join(with_map, "root_url", "left_anti")
        found = mapped.unionByName(walked.select("root_url", "url", "ord", F.lit(0).alias("pos"), F.lit("crawl").alias("source")))
    rest = roots.select("root_url").join(found.select("root_url").distinct(), "root_url", "left_anti")
    nothing = rest.select(
        "root_url", F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("ord"),
        F.lit(None).cast("int").alias("pos"), F.lit("none").alias("source"),
    )
    return found.unionByName(nothing)
