"""Every operator as a query over the given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecorpus.checkpoints import checkpoint_root, cut
from sitecorpus.functions import urls
from sitecorpus.operators import crawl, documents, export, extract, links, metadata, pacing, render, robots, sitemaps, stored, tokens
from sitecorpus.operators import site_run as site_runs
from sitecorpus.sources import fixtures, snapshots

DEPTH = 5
AGENT = fixtures.AGENT
OFF = dict(
    remove_exact_selectors=False, remove_partial_selectors=False, remove_hidden_elements=False,
    remove_low_scoring=False, remove_small_images=False, standardize=False,
)


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.read_pages(spark, sf_dir)


def rich_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.rich_pages(pages_of(spark, sf_dir))


# Sources

def fetched(spark, sf):
    df = snapshots.fetched_pages(pages_of(spark, sf))
    return df.select("page_id", "url_key", "netloc", F.length("html").alias("n_chars"), "ok")


def robots_snapshots(spark, sf):
    return fixtures.robots_docs(pages_of(spark, sf))


def sitemap_snapshots(spark, sf):
    return snapshots.with_sitemap_test(fixtures.sitemap_docs(pages_of(spark, sf)))


# URLs and links

def url_keys(spark, sf):
    df = urls.with_page_key(pages_of(spark, sf).select("page_id", "url"))
    return df.select(
        "page_id", "url_key", urls.document_key(F.col("url")).alias("document_key"), urls.output_root(F.col("url_key_netloc")).alias("output_root"),
        urls.is_crawlable(F.col("url_key_scheme"), F.col("url_key_path")).alias("crawlable"),
    )


def url_profile(spark, sf):
    return links.url_profile(pages_of(spark, sf))


def page_links(spark, sf):
    return links.page_links(pages_of(spark, sf)).drop("url")


def page_links_regex(spark, sf):
    """Links of pages with bare values and references in them, which the tolerant pattern passes over or leaves as they are."""
    return links.page_links(fixtures.site_pages(pages_of(spark, sf)), mode="regex").drop("url")


def internal_edges(spark, sf):
    return links.internal_edges(links.page_links(pages_of(spark, sf)))


def links_per_page(spark, sf):
    pages = pages_of(spark, sf)
    return links.links_per_page(pages, links.page_links(pages))


def dropped_links(spark, sf):
    site = fixtures.site_pages(pages_of(spark, sf))
    return links.dropped_links(links.page_links(site))


# Crawl

def _site(spark, sf):
    pages = pages_of(spark, sf)
    ranked = fixtures.ranked_pages(pages)
    site = fixtures.site_pages(pages, ranked)
    return pages, ranked, site, fixtures.site_roots(pages, ranked)


def _walked(spark, sf, ordered=False):
    """What a crawl under the robots files visits, and the site it walks."""
    pages, _, site, roots = _site(spark, sf)
    policies = _policies(pages)
    return crawl.crawl(roots, crawl.crawl_edges(site), DEPTH, ordered, policies=policies), site


def crawl_closure(spark, sf):
    _, _, site, roots = _site(spark, sf)
    return crawl.crawl(roots, crawl.crawl_edges(site), DEPTH).select("root_url", "url", "depth")


def crawl_outcome(spark, sf):
    return crawl.with_outcome(*_walked(spark, sf)).drop("url_key")


def crawl_order(spark, sf):
    return _walked(spark, sf, ordered=True)[0].select("root_url", "url", "depth", "ord")


def crawl_depths(spark, sf):
    return crawl.depth_histogram(crawl_outcome(spark, sf))


# Sitemaps

def _policies(pages):
    return robots.site_policies(fixtures.robots_docs(pages), AGENT)


def _sitemaps(spark, sf):
    """Roots, the chosen sitemap of each, and the entries of all that may be fetched."""
    pages = pages_of(spark, sf)
    ranked = fixtures.ranked_pages(pages)
    roots = fixtures.site_roots(pages, ranked)
    docs = cut(snapshots.with_sitemap_test(fixtures.sitemap_docs(pages, ranked)), "sitemaps")
    policies = _policies(pages)
    open_docs = robots.with_decision(docs, policies).where("allowed").select("url", "body", "valid")
    chosen = sitemaps.chosen_sitemaps(sitemaps.sitemap_candidates(roots, policies), open_docs)
    return pages, ranked, roots, chosen, sitemaps.sitemap_locs(open_docs)


def sitemap_candidates(spark, sf):
    pages = pages_of(spark, sf)
    return sitemaps.sitemap_candidates(fixtures.site_roots(pages, fixtures.ranked_pages(pages)), _policies(pages))


def sitemap_choice(spark, sf):
    return _sitemaps(spark, sf)[3]


def sitemap_locs(spark, sf):
    return sitemaps.sitemap_locs(fixtures.sitemap_docs(pages_of(spark, sf)))


def sitemap_pages(spark, sf):
    *_, chosen, locs = _sitemaps(spark, sf)
    return sitemaps.expand_sitemaps(chosen, locs).select("root_url", "url")


def url_sources(spark, sf):
    pages, ranked, roots, chosen, locs = _sitemaps(spark, sf)
    walked = crawl.with_outcome(*_walked(spark, sf, ordered=True))
    expanded = cut(sitemaps.expand_sitemaps(chosen, locs), "expanded")
    return sitemaps.url_sources(roots, expanded, walked).select("root_url", "source", "url")


# Robots and pacing

def robots_rules(spark, sf):
    df = robots.robots_rules(fixtures.robots_docs(pages_of(spark, sf)))
    return df.withColumn("agents", F.array_join("agents", ","))


def robots_groups(spark, sf):
    return robots.chosen_groups(fixtures.robots_docs(pages_of(spark, sf)), AGENT)


def _decided(spark, sf, **how):
    pages = pages_of(spark, sf)
    return robots.with_decision(pages.select("page_id", "url"), _policies(pages), **how)


def robots_decisions(spark, sf):
    return _decided(spark, sf).select("page_id", "allowed", "why")


def robots_conservative(spark, sf):
    return _decided(spark, sf, policy_403="conservative").select("page_id", "allowed")


def crawl_delays(spark, sf):
    return _policies(pages_of(spark, sf)).select("site", "denied", "crawl_delay")


def robots_sitemaps(spark, sf):
    return robots.listed_sitemaps(fixtures.robots_docs(pages_of(spark, sf))).select("site", "sitemap")


def robots_audit(spark, sf):
    return robots.robots_audit(_decided(spark, sf))


def request_gaps(spark, sf):
    policies = _policies(pages_of(spark, sf))
    return policies.select("site", pacing.request_gap(1.0, F.col("crawl_delay")).alias("gap"))


def _requests(spark, sf):
    decided = _decided(spark, sf).where("allowed")
    status = F.when(F.col("page_id") % 11 == 3, 503).otherwise(200)
    return decided.select(F.col("page_id").alias("seq"), "url", status.alias("status"))


def fetch_schedule(spark, sf):
    return pacing.fetch_schedule(_requests(spark, sf), _policies(pages_of(spark, sf))).drop("url")


def fetch_finish(spark, sf):
    return pacing.finish_times(pacing.fetch_schedule(_requests(spark, sf), _policies(pages_of(spark, sf))))


def fetch_back_off(spark, sf):
    return pacing.fetch_schedule(_requests(spark, sf), _policies(pages_of(spark, sf)), max_delay=3.0).drop("url")


# Extraction

def page_tokens(spark, sf):
    return tokens.tokenize(pages_of(spark, sf)).select("page_id", "pos", "kind", "tag", "attrs", "text")


def element_spans(spark, sf):
    spans = tokens.with_spans(tokens.tokenize(rich_of(spark, sf)))
    return spans.where("span_end is not null").select("page_id", "pos", "tag", "span_end")


def main_content(spark, sf):
    marked = extract.marked_tokens(pages_of(spark, sf))
    return marked.where("in_main").groupBy("page_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("tag", "pos").alias("tag")
    )


def _removed(rule: str, **switches):
    """Positions one rule removes, with all other rules off."""
    def run(spark, sf):
        marked = extract.marked_tokens(rich_of(spark, sf), extract.Options(**{**OFF, **switches}))
        return marked.where(F.col("rule") == rule).select("page_id", "pos")

    return run


def low_scoring(spark, sf):
    options = extract.Options(**{**OFF, "remove_low_scoring": True})
    marked = extract.marked_tokens(rich_of(spark, sf), options)
    blocks = extract.page_blocks(marked, options, F.lit(""), F.lit(""))
    return blocks.where("low").select("page_id", F.col("head.pos").alias("pos"), "words", "link_words")


def content_selector(spark, sf):
    options = extract.Options(**OFF, content_selector="div.newsletter-signup, blockquote")
    marked = extract.marked_tokens(rich_of(spark, sf), options)
    return marked.where("in_main").groupBy("page_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def removal_report(spark, sf):
    return extract.removal_report(rich_of(spark, sf))


def page_metadata(spark, sf):
    df = metadata.page_metadata(rich_of(spark, sf)).where("has_html")
    return df.select(
        "page_id", "title", "description", "author", "date_published", "domain", "site", "language", "favicon", "image",
        F.size("meta_tags").alias("n_meta_tags"), F.array_join("schema_org_data", "|").alias("schema_org_data"),
    )


def metadata_only(spark, sf):
    return render.metadata_only(pages_of(spark, sf)).select("page_id", "title", "language", "domain", "word_count")


def page_property(spark, sf):
    """Some properties, each asked for alone."""
    pages = rich_of(spark, sf)
    one = [render.page_property(pages, name).select("page_id", F.lit(name).alias("name"), "value") for name in ("author", "description", "published", "site", "image", "title")]
    return functools.reduce(DataFrame.unionByName, one)


def markdown(spark, sf):
    return render.rendered_pages(pages_of(spark, sf)).select("page_id", "content")


def markdown_rich(spark, sf):
    return render.rendered_pages(rich_of(spark, sf)).select("page_id", "content")


def markdown_plain(spark, sf):
    return render.rendered_pages(rich_of(spark, sf), "markdown", extract.Options(standardize=False)).select("page_id", "content")


def html(spark, sf):
    return render.rendered_pages(pages_of(spark, sf), "html").select("page_id", "content")


def json_pages(spark, sf):
    return render.json_pages(pages_of(spark, sf)).select("page_id", "json")


def skipped_pages(spark, sf):
    return render.rendered_pages(fixtures.with_blank_copies(rich_of(spark, sf))).select("page_id", "ok")


# Documents

def document_paths(spark, sf):
    return documents.with_path(pages_of(spark, sf).select("page_id", "url"))


def document_paths_json(spark, sf):
    return documents.with_path(pages_of(spark, sf).select("page_id", "url"), extension="json", single_site=True)


def front_matter(spark, sf):
    """Rendered pages under an old header, some without a title."""
    df = render.rendered_pages(rich_of(spark, sf), "markdown", extract.Options(standardize=False)).where("ok")
    df = df.withColumn("content", F.concat(F.lit("---\nold: header\n---\n\n"), "content"))
    df = df.withColumn("title", F.when(F.col("page_id") % 3 != 0, F.col("title")))
    return documents.with_front_matter(df, "2024-01-01T00:00:00", stored=True).select("page_id", "document")


def _texts(spark, sf):
    """The text of every page, empty where there is none."""
    rendered = render.rendered_pages(pages_of(spark, sf)).select("page_id", "url", F.coalesce("content", F.lit("")).alias("content"))
    return cut(rendered, "texts")


def path_collisions(spark, sf):
    return documents.assigned_paths(fixtures.run_one(_texts(spark, sf))).select("path", "seq", "content")


def path_collisions_html(spark, sf):
    return documents.assigned_paths(fixtures.run_one(_texts(spark, sf)), "html").select("path", "seq", "content")


def merged_run(spark, sf):
    pages = _texts(spark, sf)
    first = documents.assigned_paths(fixtures.run_one(pages)).select("path", "url", "content")
    return documents.merged_documents(cut(first, "stored-documents"), fixtures.run_two(pages)).select("path", "content", "state")


def upserted_run(spark, sf):
    """The same two runs over a stored table, of which the second rewrites the buckets it touches."""
    pages, target = _texts(spark, sf), _path(spark, "stored")
    stored.create(fixtures.run_one(pages), target)
    stored.upsert(fixtures.run_two(pages), target)
    return stored.current(spark, target).select("path", "content")


def page_documents(spark, sf):
    """Pages to Markdown documents with header and path: the whole pipeline."""
    rendered = render.rendered_pages(pages_of(spark, sf)).where("ok")
    with_header = documents.with_front_matter(rendered)
    return documents.with_path(with_header).select("page_id", "path", "document")


def saved_documents(spark, sf):
    """As ``page_documents``, with a path of its own for every file: clashes are numbered, of one page's copies the last stays."""
    rendered = documents.with_front_matter(render.rendered_pages(pages_of(spark, sf)).where("ok"))
    rendered = cut(rendered.select(F.col("page_id").alias("seq"), "url", "document"), "rendered")
    return rendered.join(documents.assigned(rendered), "seq").select(F.col("seq").alias("page_id"), "path", "document")


# Exports

def site_export(spark, sf):
    pages = pages_of(spark, sf)
    rendered = render.rendered_pages(pages, "html").where("ok")
    parts = urls.with_url_parts(documents.with_path(rendered, extension="json"), "url", "s_")
    parts = parts.withColumns({"root_url": urls.site_key(F.col("s_scheme"), F.col("s_netloc")), "seq": F.col("page_id")})
    kept = ["root_url", "seq", "url", "path", "title", "domain", "word_count", "content"]
    return export.site_export(parts.select(*kept), "2024-01-01T00:00:00")


def _site_run(spark, sf):
    """A run over all hosts of the table, with stored robots files, sitemaps and snapshots."""
    pages = cut(fixtures.run_pages(pages_of(spark, sf)), "run-pages")
    ranked = fixtures.ranked_pages(pages)
    site = cut(fixtures.site_pages(pages, ranked), "run-site")
    robots_path, sitemaps_path = _path(spark, "robots"), _path(spark, "sitemaps")
    fixtures.robots_docs(pages).write.parquet(robots_path)
    fixtures.sitemap_docs(pages, ranked).write.parquet(sitemaps_path)
    roots = cut(fixtures.site_roots(pages, ranked), "run-roots")
    return site_runs.run_sites(
        roots, site, snapshots.read_robots(spark, robots_path), snapshots.read_sitemaps(spark, sitemaps_path), site_runs.Rules(AGENT, DEPTH)
    )


def site_run(spark, sf):
    """Every listed or found URL, what became of it, and its file."""
    return _site_run(spark, sf).ledger


def run_summary(spark, sf):
    return site_runs.run_summary(_site_run(spark, sf).ledger)


def saved_site(spark, sf):
    """The files of a run, written and read back."""
    target = _path(spark, "saved-site")
    export.write_documents(_site_run(spark, sf).files, target)
    return export.committed(spark, target).select("root_url", "path", "document")


def written_documents(spark, sf):
    """Markdown documents, written and read back."""
    target = _path(spark, "documents")
    rendered = documents.with_path(documents.with_front_matter(render.rendered_pages(pages_of(spark, sf)).where("ok")))
    export.write_documents(rendered.select("page_id", "domain", "path", "document"), target)
    return export.committed(spark, target).select("page_id", "domain", "path", "document")


def written_json(spark, sf):
    """JSON documents, written and read back."""
    target = _path(spark, "json")
    df = documents.with_path(render.json_pages(pages_of(spark, sf)), extension="json")
    df = df.select("page_id", F.get_json_object("json", "$.domain").alias("domain"), "path", F.col("json").alias("document"))
    export.write_documents(df, target, "json")
    return export.committed(spark, target).select("page_id", "path", "document")


def written_export(spark, sf):
    """The combined export, written and read back."""
    target = _path(spark, "export")
    export.write_site_export(site_export(spark, sf), target)
    return export.committed(spark, target).select("root_url", "seq", "line")


def _path(spark, name):
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/sitecorpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fetched_pages": fetched,
    "robots_snapshots": robots_snapshots,
    "sitemap_snapshots": sitemap_snapshots,
    "url_keys": url_keys,
    "url_profile": url_profile,
    "page_links": page_links,
    "page_links_regex": page_links_regex,
    "internal_edges": internal_edges,
    "links_per_page": links_per_page,
    "dropped_links": dropped_links,
    "crawl_closure": crawl_closure,
    "crawl_outcome": crawl_outcome,
    "crawl_order": crawl_order,
    "crawl_depths": crawl_depths,
    "sitemap_candidates": sitemap_candidates,
    "sitemap_choice": sitemap_choice,
    "sitemap_locs": sitemap_locs,
    "sitemap_pages": sitemap_pages,
    "url_sources": url_sources,
    "robots_rules": robots_rules,
    "robots_groups": robots_groups,
    "robots_decisions": robots_decisions,
    "robots_conservative": robots_conservative,
    "crawl_delays": crawl_delays,
    "robots_sitemaps": robots_sitemaps,
    "robots_audit": robots_audit,
    "request_gaps": request_gaps,
    "fetch_schedule": fetch_schedule,
    "fetch_finish": fetch_finish,
    "fetch_back_off": fetch_back_off,
    "page_tokens": page_tokens,
    "element_spans": element_spans,
    "main_content": main_content,
    "content_selector": content_selector,
    "removed_exact": _removed("exact_selectors", remove_exact_selectors=True),
    "removed_partial": _removed("partial_selectors", remove_partial_selectors=True),
    "removed_hidden": _removed("hidden_elements", remove_hidden_elements=True),
    "removed_small_images": _removed("small_images", remove_small_images=True),
    "removed_images": _removed("images", remove_images=True),
    "low_scoring": low_scoring,
    "removal_report": removal_report,
    "page_metadata": page_metadata,
    "metadata_only": metadata_only,
    "page_property": page_property,
    "markdown": markdown,
    "markdown_rich": markdown_rich,
    "markdown_plain": markdown_plain,
    "html": html,
    "json_pages": json_pages,
    "skipped_pages": skipped_pages,
    "document_paths": document_paths,
    "document_paths_json": document_paths_json,
    "front_matter": front_matter,
    "path_collisions": path_collisions,
    "path_collisions_html": path_collisions_html,
    "merged_run": merged_run,
    "upserted_run": upserted_run,
    "page_documents": page_documents,
    "saved_documents": saved_documents,
    "site_export": site_export,
    "site_run": site_run,
    "saved_site": saved_site,
    "run_summary": run_summary,
    "written_documents": written_documents,
    "written_json": written_json,
    "written_export": written_export,
}
