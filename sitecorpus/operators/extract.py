"""The main content of a page and what is removed from it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.functions import markup, urls
from sitecorpus.operators.tokens import inside_any, tokenize, with_page_ends, with_spans


@dataclass(frozen=True)
class Options:
    """The pipeline's switches with their defaults."""

    remove_exact_selectors: bool = True
    remove_partial_selectors: bool = True
    remove_hidden_elements: bool = True
    remove_low_scoring: bool = True
    remove_small_images: bool = True
    remove_images: bool = False
    standardize: bool = True
    content_selector: str | None = None


EXACT_TAGS = ["nav", "header", "footer", "aside", "form", "button", "iframe"]
EXACT_NAMES = r"(?i)(?:^|\s)(?:ad|ads|sidebar|comments|share)(?:\s|\z)"
PARTIAL_NAMES = r"(?i)advert|banner|breadcrumb|cookie|newsletter|popup|promo|related|social"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_TAGS = HEADINGS + [
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hr", "html", "legend", "li", "main",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
]
# Blocks that may be short without being noise.
SHORT_BLOCKS = HEADINGS + ["li", "pre", "tr", "dt", "dd", "figcaption", "caption"]
SMALL = 33  # pixels
# Rules that spare what the main element lies in.
SPARING = ["exact_selectors", "partial_selectors", "hidden_elements"]
# Classes under which libraries draw a formula that also stands in the page as TeX.
DRAWN_FORMULA = r"(?:^|\s)(?:katex-html|MathJax|MathJax_Preview|MathJax_Display|MathJax_SVG|MathJax_CHTML)(?:\s|\z)"
FOOTNOTE = r"^#(?:fn|footnote)[:_-]?([A-Za-z0-9]+)\z"


def selector_filter(selector: str) -> Column:
    """``tag``, ``.class``, ``#id``, ``tag.class``, ``[attr=value]`` and lists of these, as a filter on tokens."""
    test = None
    for one in selector.split(","):
        found = re.fullmatch(r"\s*([A-Za-z][\w-]*)?(?:([.#])([\w-]+)|\[([\w-]+)=[\"']?([^\"'\]]*)[\"']?\])?\s*", one)
        if not found or not one.strip():
            raise ValueError(f"unsupported content selector {one!r}")
        tag, mark, name, attr, value = found.groups()
        parts = []
        if tag:
            parts.append(F.col("tag") == tag.lower())
        if mark == ".":
            parts.append(markup.attribute("attr_list", "class").rlike(rf"(?:^|\s){re.escape(name)}(?:\s|\z)"))
        if mark == "#":
            parts.append(markup.attribute("attr_list", "id") == name)
        if attr:
            parts.append(markup.attribute("attr_list", attr.lower()) == value)
        both = parts[0]
        for p in parts[1:]:
            both = both & p
        test = both if test is None else test | both
    return F.coalesce(test, F.lit(False))


def _flags(options: Options) -> dict[str, Column]:
    """What can be told of a token from its own tag and attributes."""
    attr_list, tag = F.col("attr_list"), F.col("tag")
    starts = F.col("kind").isin("open", "void") & ~tag.isin("html", "body")
    get = lambda name: F.coalesce(markup.attribute("attr_list", name), F.lit(""))
    has = attr_list.isNotNull()

    def named(pattern: str) -> Column:
        return has & (get("class").rlike(pattern) | get("id").rlike(pattern))

    def small(name: str) -> Column:
        return F.coalesce(F.regexp_extract(get(name), "^[0-9]{1,9}", 0).try_cast("int") < SMALL, F.lit(False))

    style = F.regexp_replace(F.lower(get("style")), r"\s+", "")
    flags = {
        "f_exact": starts
        & (tag.isin(EXACT_TAGS) | (has & F.lower(get("role")).isin("navigation", "banner")) | named(EXACT_NAMES)),
        "f_partial": starts & named(PARTIAL_NAMES),
        "f_hidden": starts
        & has
        & (
            markup.attribute("attr_list", "hidden").isNotNull()
            | (F.lower(get("aria-hidden")) == "true")
            | style.contains("display:none")
            | style.contains("visibility:hidden")
        ),
        "f_drawn": starts & has & get("class").rlike(DRAWN_FORMULA),
        "f_small": (tag == "img")
        & has
        & (small("width") | small("height")),
        "main_kind": F.when(F.col("kind") != "open", F.lit(None))
        .when(selector_filter(options.content_selector) if options.content_selector else F.lit(False), 0)
        .when(tag == "article", 1)
        .when(tag == "main", 2)
        .when(has & (F.lower(get("role")) == "main"), 3)
        .when(tag.isin("div", "section"), 4)
        .when(tag == "body", 5),
    }
    return flags


def marked_tokens(pages: DataFrame, options: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens with ``in_main``, the ``rule`` that removed them, their block and context.

    ``rule`` names the first rule that took the token, NULL if it stays.  A main
    element named as such outside all removed elements comes first; then one in
    a removed element (a form or a named wrapper around the page) that holds more
    text than all that stays outside; then ``div``, ``section`` and ``body`` outside.
    Elements around the chosen one are not removed.
    """
    by_page = Window.partitionBy("page_id").orderBy("pos")
    upto = by_page.rowsBetween(Window.unboundedPreceding, 0)
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    kind, tag = F.col("kind"), F.col("tag")
    tokens = tokenize(pages).withColumns(_flags(options))
    href = F.when(
        (tag == "a") & (kind == "open"), markup.attribute("attr_list", "href")
    ).when(tag == "img", markup.attribute("attr_list", "src"))
    tokens = urls.with_resolved(tokens.withColumn("href", href), "href", "b_", "link")
    class_ = F.coalesce(markup.attribute("attr_list", "class"), F.lit(""))
    tokens = tokens.withColumns(
        {
            "alt": F.when(tag == "img", F.coalesce(markup.attribute("attr_list", "alt"), F.lit(""))).when((tag == "math") & (kind == "math"), markup.decoded("shown")),
            "lang": F.when(
                tag.isin("pre", "code") & (F.col("attrs") != ""),
                F.regexp_extract(class_, r"(?:^|\s)(?:language|lang)-([A-Za-z0-9+#_.-]+)", 1),
            ),
            "note": F.when((tag == "a") & (kind == "open"), F.regexp_extract(F.coalesce("href", F.lit("")), FOOTNOTE, 1)),
            "is_link": (tag == "a") & (kind == "open") & F.col("href").isNotNull(),
        }
    ).select(
        "page_id", "pos", "kind", "tag", "text", "link", "alt", "lang", "note", "is_link",
        "f_exact", "f_partial", "f_hidden", "f_small", "f_drawn", "main_kind", *keep,
    )
    # First what the spans need; the rest waits until they are known, so that their sorts move narrow rows.
    is_open_anchor = (tag == "a") & (kind == "open")
    in_link = F.last(F.when(is_open_anchor, F.col("is_link")).when((tag == "a") & (kind == "close"), F.lit(False)), ignorenulls=True)
    size = F.when(kind == "text", F.length("text")).otherwise(0)
    tokens = tokens.withColumn("in_link", F.coalesce(in_link.over(upto), F.lit(False))).withColumns(
        {
            "chars": F.sum(size).over(upto),
            "link_chars": F.sum(F.when(F.col("in_link"), size).otherwise(0)).over(upto),
        }
    )
    tokens = with_spans(with_page_ends(tokens, ["pos", "chars", "link_chars"]), ("chars", "link_chars"))
    starts = kind.isin("open", "void")
    wordless = (tag == "figure") & (F.col("chars_end") == F.col("chars"))
    rules: list[tuple[str, Column]] = [("title", (tag == "title") & (kind == "open"))]
    if options.remove_exact_selectors:
        rules.append(("exact_selectors", F.col("f_exact")))
    if options.remove_partial_selectors:
        rules.append(("partial_selectors", F.col("f_partial")))
    if options.remove_hidden_elements:
        rules.append(("hidden_elements", F.col("f_hidden")))
    if options.remove_small_images:
        rules.append(("small_images", F.col("f_small")))
    if options.remove_images:
        rules.append(("images", starts & (tag.isin("img", "picture", "svg") | wordless)))
    if options.standardize:
        rules.append(("drawn_formulas", F.col("f_drawn")))
    flagged = F.lit(False)
    for _, flag in rules:
        flagged = flagged | flag
    flagged = F.coalesce(flagged, F.lit(False))
    whole = by_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = tokens.withColumn("removed", inside_any(flagged)).withColumn(
        "staying", F.sum(F.when(F.col("removed") | F.col("in_link"), 0).otherwise(size)).over(whole)
    )
    dense = (F.col("chars_end") - F.col("chars")) - (F.col("link_chars_end") - F.col("link_chars"))
    wrapped = F.col("removed") & ~flagged & (F.col("main_kind") < 5) & (dense > F.col("staying"))
    tier = F.when(wrapped, 1).when(~F.col("removed"), F.when(F.col("main_kind") < 4, 0).otherwise(2))
    candidate = F.when(
        F.col("main_kind").isNotNull() & tier.isNotNull(),
        F.struct(
            tier.alias("tier"),
            "main_kind",
            F.when(F.col("main_kind") == 4, -dense).otherwise(0).alias("score"),
            F.when(F.col("main_kind") == 4, -F.col("pos")).otherwise(F.col("pos")).alias("place"),
            F.col("pos").alias("start"),
            F.col("span_end").alias("end"),
        ),
    )
    tokens = tokens.withColumn("main", F.min(candidate).over(whole))
    around_main = F.coalesce((F.col("pos") < F.col("main.start")) & (F.col("span_end") >= F.col("main.end")), F.lit(False))
    rule = F.lit(None).cast("string")
    for name, flag in reversed(rules):
        spared = flag & ~around_main if name in SPARING else flag
        rule = F.when(inside_any(spared), F.lit(name)).otherwise(rule)
    # Stray closes close nothing.
    opened = F.when(kind == "open", 1).when(F.col("paired"), -1).otherwise(0)
    solid = (kind != "text") | F.col("text").rlike(r"\S")
    last_anchor = F.last(F.when(is_open_anchor, F.struct("link", "note", "is_link")), ignorenulls=True).over(upto)
    in_anchor = F.last(F.when(tag == "a", kind == "open"), ignorenulls=True).over(upto)
    tokens = tokens.withColumns(
        {
            "rule": rule,
            "list_depth": F.sum(F.when(tag.isin("ul", "ol"), opened).otherwise(0)).over(upto),
            "quote_depth": F.sum(F.when(tag == "blockquote", opened).otherwise(0)).over(upto),
            "pre_depth": F.sum(F.when(tag == "pre", opened).otherwise(0)).over(upto),
            "anchor": last_anchor,
            "in_anchor": F.coalesce(in_anchor, F.lit(False)),
            "previous": F.last(F.when(solid, F.struct("kind", "tag")), ignorenulls=True).over(before),
        }
    )
    item_text = (tag == "p") & (kind == "open") & (F.col("previous.tag") == "li") & (F.col("previous.kind") == "open")
    starts_block = tag.isin(BLOCK_TAGS) & ~F.coalesce(item_text, F.lit(False))
    is_anchor = tag == "a"
    tokens = tokens.withColumns(
        {
            # Of the anchor a token belongs to, only its own tags and its text need to know.
            "anchor_link": F.when(is_anchor & (kind == "close") & F.col("anchor.is_link"), F.col("anchor.link")),
            "anchor_note": is_anchor & F.coalesce(F.col("anchor.note") != "", F.lit(False)),
            "in_note": F.col("in_anchor") & F.coalesce(F.col("anchor.note") != "", F.lit(False)),
            "starts_block": F.when(starts_block, 1).otherwise(0),
        }
    ).drop("anchor", "in_anchor", "previous")
    tokens = tokens.withColumns(
        {
            "block": F.sum("starts_block").over(upto),
        }
    ).drop("removed", "staying", "paired")
    return tokens.withColumn(
        "in_main", F.col("main").isNull() | F.col("pos").between(F.col("main.start"), F.col("main.end"))
    )


def _role(options: Options) -> Column:
    tag, kind = F.col("tag"), F.col("kind")
    role = (
        F.when(kind.isin("text", "math"), "text")
        .when(tag.isin("b", "strong"), "strong")
        .when(tag.isin("i", "em"), "em")
        .when(tag == "code", "code")
    )
    if options.standardize:
        role = role.when(F.col("anchor_note"), "note")
    return role.when(tag == "a", "link").otherwise("other")


def markdown_piece(options: Options) -> Column:
    """What a token adds to the text of its block."""
    tag, kind, text = F.col("tag"), F.col("kind"), F.col("text")
    in_pre = F.col("pre_depth") > 0
    opens = kind == "open"
    piece = F.lit(None).cast("string")
    noted = F.lit(False)
    if options.standardize:
        noted = F.col("in_note")
        piece = F.when((tag == "a") & opens & (F.col("note") != ""), F.concat(F.lit("[^"), "note", F.lit("]"))).when(
            F.col("anchor_note"), F.lit("")
        ).when(kind == "math", F.concat(F.lit("$"), F.trim(text), F.lit("$")))
        start = piece
    else:
        start = F.when(kind == "math", F.coalesce("alt", F.lit("")))
    return (
        start.when((kind == "text") & noted, F.lit(""))
        .when((kind == "text") & in_pre, text)
        .when(kind == "text", F.regexp_replace(text, r"\s+", " "))
        .when(in_pre, F.when(tag == "br", F.lit("\n")).otherwise(F.lit("")))
        .when(tag.isin("b", "strong"), F.lit("**"))
        .when(tag.isin("i", "em"), F.lit("*"))
        .when(tag == "code", F.lit("`"))
        .when((tag == "a") & opens & F.col("is_link"), F.lit("["))
        .when(F.col("anchor_link").isNotNull(), F.lit("]("))
        .when(tag == "br", F.lit("\n"))
        .when((tag == "img") & (F.col("link") != ""), F.concat(F.lit("!["), "alt", F.lit("]("), "link", F.lit(")")))
        .when(tag.isin("td", "th") & (kind == "close"), F.lit(" | "))
        .otherwise(F.lit(""))
    )


def page_blocks(marked: DataFrame, options: Options, piece: Column, role: Column, lists: bool = False) -> DataFrame:
    """The kept tokens of each block, its features, and whether it scores too low.

    A block runs from one block-level tag to the next.  It is low if more than
    half of its words are link text, or if it has under five words, no
    punctuation and is not of a kind that may be short; blocks with an image
    stay.  With ``lists`` each block knows the tag of its innermost list as ``list_tag``,
    also of one that opens outside the kept tokens.
    """
    text, kind = F.col("text"), F.col("kind")
    keeps = F.col("in_main") & F.col("rule").isNull()
    kept = marked if lists else marked.where(keeps)
    words = F.when(kind == "text", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).otherwise(0)
    in_text_link = F.col("in_link") & (kind == "text")

    def balance(name: str) -> Column:
        return F.sum(
            F.when(F.col("role") == name, F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)).otherwise(0)
        )

    blocks = (
        kept.withColumns({"piece": F.when(keeps, piece), "role": F.when(keeps, role)})
        .groupBy("page_id", "block")
        .agg(
            F.min(F.when(keeps, F.struct("pos", "kind", "tag", "list_depth", "quote_depth", "pre_depth"))).alias("head"),
            # A list's tags start blocks, so its depth is one in a block.
            F.min("list_depth").alias("list_depth"),
            F.max(F.when(F.col("tag").isin("ul", "ol") & (kind == "open"), F.col("tag"))).alias("opened_list"),
            F.sum(F.when(keeps, words)).alias("words"),
            F.sum(F.when(keeps & in_text_link, words).otherwise(0)).alias("link_words"),
            F.coalesce(F.max(F.when(keeps & (kind == "text"), text.rlike("[.,;:!?]"))), F.lit(False)).alias("punctuated"),
            F.max(F.when(keeps, F.col("tag") == "img")).alias("has_image"),
            F.max(F.when(keeps, F.col("lang"))).alias("lang"),
            balance("strong").alias("strong"),
            balance("em").alias("em"),
            balance("code").alias("code"),
            balance("link").alias("link"),
            F.sum(F.when(keeps, F.length("text"))).alias("chars"),
            F.count_if(keeps).alias("tokens"),
            F.collect_list(
                F.when(
                    F.col("piece") != "",
                    F.struct("pos", "role", "piece", F.when(F.col("piece") == "](", F.col("anchor_link")).alias("to")),
                )
            ).alias("pieces"),
        )
    )
    if lists:
        # The latest list that opened at this depth; blocks are far fewer than tokens.
        level = Window.partitionBy("page_id", "list_depth").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        blocks = blocks.withColumn("list_tag", F.last("opened_list", ignorenulls=True).over(level)).where("head is not null")
    short = (F.col("words") < 5) & ~F.col("punctuated") & ~(
        F.col("head.tag").isin(SHORT_BLOCKS) & (F.col("head.kind") == "open")
    )
    linky = F.col("link_words") * 2 > F.col("words")
    low = F.lit(False)
    if options.remove_low_scoring:
        low = (F.col("words") > 0) & ~F.col("has_image") & (linky | short)
    return blocks.withColumn("low", low)


def removal_report(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Tokens and characters each rule removed, per page."""
    marked = marked_tokens(pages, options)
    by_rule = (
        marked.where("rule is not null or not in_main")
        .groupBy("page_id", F.coalesce("rule", F.lit("outside_main")).alias("rule"))
        .agg(F.count("*").alias("tokens"), F.sum(F.length("text")).alias("characters"))
    )
    blocks = page_blocks(marked, options, F.lit(""), F.lit(""))
    low = (
        blocks.where("low")
        .groupBy("page_id")
        .agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("characters"))
        .select("page_id", F.lit("low_scoring").alias("rule"), "tokens", "characters")
    )
    return by_rule.unionByName(low)
