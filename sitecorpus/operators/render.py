"""Pages as Markdown, HTML or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.functions import markup
from sitecorpus.operators.extract import BLOCK_TAGS, HEADINGS, Options, _role, markdown_piece, marked_tokens, page_blocks
from sitecorpus.operators.metadata import page_metadata, squeezed
from sitecorpus.operators.tokens import by_page

# Attributes that stay in HTML output.
KEPT_ATTRIBUTES = ["href", "src", "alt", "title", "colspan", "rowspan", "lang"]
# Keys of the JSON output, in order, and the fields they hold.
JSON_KEYS = {
    "content": "content", "title": "title", "description": "description", "domain": "domain", "favicon": "favicon",
    "image": "image", "metaTags": "meta_tags", "parseTime": None, "published": "date_published", "author": "author",
    "site": "site", "schemaOrgData": "schema_org_data", "wordCount": "word_count",
}
FORMATS = ["markdown", "html"]


def _block_text() -> Column:
    """The pieces of a block in order; marks that do not pair up in it are left out."""
    def one(p: Column) -> Column:
        unpaired = F.lit(False)
        for name in ("strong", "em", "code", "link"):
            unpaired = unpaired | ((p["role"] == name) & (F.col(name) != 0))
        return F.when(unpaired, F.lit("")).when(p["to"].isNotNull(), F.concat(p["piece"], p["to"], F.lit(")"))).otherwise(p["piece"])

    return F.array_join(F.transform(F.array_sort("pieces"), one), "")


def _markdown_blocks(blocks: DataFrame, options: Options) -> DataFrame:
    """Add ``heading`` (plain text of a heading block) and ``out`` (the block as Markdown)."""
    head = F.col("head")
    opens = head["kind"] == "open"
    is_pre, is_heading = head["pre_depth"] > 0, opens & head["tag"].isin(HEADINGS)
    blocks = blocks.withColumn("body", _block_text())
    line = F.regexp_replace(F.regexp_replace("body", "[ \\t]+", " "), " ?\n ?", "\n")
    blocks = blocks.withColumn(
        "body",
        F.when(is_pre, F.regexp_replace(F.col("body"), r"^\n+|\s+\z", "")).otherwise(F.regexp_replace(line, r"^\s+|\s+\z", "")),
    )
    level = F.substr(head["tag"], F.lit(2)).try_cast("int")
    if options.standardize:
        level = F.greatest(level, F.lit(2))
    depth = F.greatest(head["list_depth"], F.lit(0)).cast("int")
    bullet = F.when((depth > 0) & (F.col("list_tag") == "ol"), F.lit("1. ")).otherwise(F.lit("- "))
    lead = (
        F.when(is_heading, F.concat(F.repeat(F.lit("#"), level), F.lit(" ")))
        .when(opens & (head["tag"] == "li"), F.concat(F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0))), bullet))
        .when(depth > 0, F.repeat(F.lit("  "), depth))
        .otherwise(F.lit(""))
    )
    lang = F.coalesce("lang", F.lit("")) if options.standardize else F.lit("")
    text = (
        F.when(head["tag"] == "hr", F.concat(F.lit("---"), F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise(F.lit(""))))
        .when(F.col("body") == "", F.lit(""))
        .when(is_pre, F.concat(F.lit("```"), lang, F.lit("\n"), "body", F.lit("\n```")))
        .otherwise(F.concat(lead, "body"))
    )
    quote = F.repeat(F.lit("> "), F.greatest(head["quote_depth"], F.lit(0)).cast("int"))
    quoted = F.when((quote != "") & (text != ""), F.concat(quote, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), quote)))).otherwise(text)
    return blocks.withColumns({"heading": F.when(is_heading, F.col("body")), "out": quoted})


def _html_piece(options: Options) -> Column:
    """A token as HTML: text as written, tags with the kept attributes only."""
    tag, kind, attr_list = F.col("tag"), F.col("kind"), F.col("attr_list")
    name = F.when(tag == "h1", F.lit("h2")).otherwise(tag) if options.standardize else tag

    def escaped(value: Column) -> Column:
        return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))

    def kept(attr: str) -> Column:
        value = markup.attribute("attr_list", attr)
        if attr == "href":
            value = F.when(tag == "a", F.col("link")).otherwise(value)
        if attr == "src":
            value = F.when(tag == "img", F.col("link")).otherwise(value)
        return F.coalesce(F.concat(F.lit(f' {attr}="'), escaped(value), F.lit('"')), F.lit(""))

    with_attrs = F.when(attr_list.isNull(), F.lit("")).otherwise(F.concat(*[kept(a) for a in KEPT_ATTRIBUTES]))
    written = F.when(tag == "math", F.col("raw")).otherwise(F.lit(""))
    math = F.concat(F.lit("$"), F.trim("text"), F.lit("$")) if options.standardize else written
    return (
        F.when(kind == "text", F.col("raw"))
        .when(kind == "math", math)
        .when(kind == "close", F.concat(F.lit("</"), name, F.lit(">")))
        .otherwise(F.concat(F.lit("<"), name, with_attrs, F.lit(">")))
    )


def _html_blocks(blocks: DataFrame) -> DataFrame:
    """``out`` is the whole block; ``frame`` its block-level tags, which stay when its text goes."""
    join = lambda pieces: F.array_join(F.transform(F.array_sort(pieces), lambda p: p["piece"]), "")
    plain = "array_join(transform(filter(array_sort(pieces), p -> p.role = 'text'), p -> p.piece), '')"
    is_heading = (F.col("head.kind") == "open") & F.col("head.tag").isin(HEADINGS)
    return blocks.withColumns(
        {
            "out": join(F.col("pieces")),
            "frame": join(F.filter("pieces", lambda p: p["role"] == "frame")),
            "heading": F.when(is_heading, squeezed(markup.decoded(plain))),
        }
    )


EMPTY_ELEMENTS = [r"<(?:p|li|h2|h3|h4|h5|h6)>\s*</(?:p|li|h2|h3|h4|h5|h6)>", r"<(?:ul|ol|div|blockquote)>\s*</(?:ul|ol|div|blockquote)>"]


def rendered_pages(pages: DataFrame, fmt: str = "markdown", options: Options = Options()) -> DataFrame:
    """Metadata and content of every page.

    Gives ``page_id``, ``url``, the metadata fields, ``word_count``, ``content`` (NULL
    for a page without any) and ``ok``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "markdown":
        marked = marked_tokens(pages, options)
        blocks = _markdown_blocks(page_blocks(marked, options, markdown_piece(options), _role(options), lists=True), options)
        blocks = blocks.withColumn("frame", F.lit(""))
    else:
        marked = marked_tokens(pages, options, keep=("raw", "attr_list"))
        role = F.when(F.col("kind").isin("text", "math"), "text").when(F.col("tag").isin(BLOCK_TAGS), "frame").otherwise("other")
        blocks = _html_blocks(page_blocks(marked, options, _html_piece(options), role))
    bodies = blocks.groupBy("page_id").agg(
        F.sum(F.when(~F.col("low"), F.col("words")).otherwise(0)).alias("words"),
        F.min(F.when(F.col("heading").isNotNull() & ~F.col("low"), F.struct("block", "heading"))).alias("top"),
        F.array_sort(
            F.collect_list(F.struct("block", F.when(F.col("low"), F.col("frame")).otherwise(F.col("out")).alias("out"), "frame"))
        ).alias("blocks"),
    )
    df = page_metadata(by_page(pages)).join(bodies, "page_id", "left")
    repeated = F.lit(None).cast("long")
    if options.standardize:
        repeated = F.when(squeezed(F.col("top.heading")) == F.col("title"), F.col("top.block"))
    df = df.withColumn("repeated", repeated)
    parts = F.transform("blocks", lambda b: F.when(b["block"].eqNullSafe(F.col("repeated")), b["frame"]).otherwise(b["out"]))
    if fmt == "markdown":
        content = F.array_join(F.filter(parts, lambda s: s != ""), "\n\n")
    else:
        content = F.array_join(parts, "")
        if options.standardize:
            for pattern in EMPTY_ELEMENTS:
                content = F.regexp_replace(content, pattern, "")
    df = df.withColumn("content", F.when(F.col("has_html"), content))
    filled = F.col("content").rlike(r"\S")
    return df.select(
        "page_id", "url", "title", "description", "author", "date_published", "domain", "site", "language",
        F.coalesce("words", F.lit(0)).cast("int").alias("word_count"),
        "favicon", "image", "meta_tags", "schema_org_data",
        F.when(filled, F.col("content")).alias("content"),
        F.coalesce(filled, F.lit(False)).alias("ok"),
    )


def json_pages(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """``page_id, url, json``; the content is HTML, and the page's URL and language are not among the keys."""
    df = rendered_pages(pages, "html", options).where("ok")
    fields = [(F.col(field) if field else F.lit(None).cast("int")).alias(key) for key, field in JSON_KEYS.items()]
    return df.select("page_id", "url", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def page_property(pages: DataFrame, name: str, options: Options = Options()) -> DataFrame:
    """``page_id, value`` of one property; an unknown name fails before any job starts."""
    if name not in JSON_KEYS:
        raise ValueError(f"property {name!r} not found, available: {', '.join(JSON_KEYS)}")
    field = JSON_KEYS[name]
    if field is None:
        return pages.select("page_id", F.lit(None).cast("string").alias("value"))
    source = rendered_pages(pages, "html", options).where("ok") if field in ("content", "word_count") else page_metadata(pages).where("has_html")
    value = F.col(field)
    if field in ("meta_tags", "schema_org_data"):
        value = F.to_json(value)
    return source.select("page_id", value.cast("string").alias("value"))


def metadata_only(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """All metadata fields; the content is not rendered, for nothing selects it."""
    return rendered_pages(pages, "markdown", options).drop("content", "ok")
