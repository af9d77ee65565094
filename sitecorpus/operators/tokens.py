"""A page as rows, and the spans of its elements.

A page is cut into tags and text runs inside its own row and then exploded.
All later windows and groupings go by ``page_id`` first, so the one shuffle of
the pages before the explode serves them all; a group never holds more than
one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.functions import markup, urls

RAW_TAGS = ["script", "style", "noscript", "template"]
# A formula in MathML, up to its own end: one token, as its TeX stands at no fixed place in it.
FORMULA = r"math(?:\s[^<>]*)?>[^<]*+(?:<(?!/?math[\s>/])[^<]*+)*+</math\s*>"
PIECES = (
    markup.any_of(
        markup.COMMENT,
        r"[!?][^>]*(?:>|\z)",
        *[markup.raw_element(t) for t in RAW_TAGS],
        FORMULA,
        "/?[a-z]" + markup.TAG_BODY + ">",
        r"/?[a-z][\s\S]*\z",
    )
    + "|[^<]+|<"
)
# Markup that never becomes a token, and a tag that the end of the page cuts off.
DROPPED = r"(?i)^(?:<[!?]|<(?:" + "|".join(RAW_TAGS) + r")[\s>])|^<[\s\S]*[^>]\z"
MATH = r"""(?i)^<script[^>]*type=["']?math/tex"""
IS_FORMULA = r"(?i)^<math[\s>][\s\S]*</math\s*>\z"
ANNOTATION = r"(?i)<annotation(?:-xml)?(?:\s[^>]*)?>[\s\S]*?</annotation(?:-xml)?\s*>"
# Where a formula holds its TeX, in order.
TEX_SOURCES = [
    r"""(?i)<annotation\s[^>]*encoding\s*=\s*["']?application/x-tex["']?[^>]*>([\s\S]*?)</annotation""",
    r"""(?i)^<math\s[^<>]*?\balttext\s*=\s*"([^"]*)""",
    r"""(?i)^<math\s[^<>]*?\balttext\s*=\s*'([^']*)""",
    r"""(?i)^<math\s[^<>]*?\bdata-latex\s*=\s*"([^"]*)""",
]


def by_page(pages: DataFrame) -> DataFrame:
    """The one shuffle of the pages, while they are still single rows; its result is shared by all that follows.

    The number of partitions is named, so that small inputs are not drawn
    together before the explode makes them ten times larger, and so that all
    users of the shuffle see the same partitions.
    """
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("page_id", "url", "html").repartition(partitions, "page_id")


def tokenize(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, kind, tag, attrs, text)``, one row per tag or text run.

    ``kind`` is ``open``, ``close``, ``void``, ``text`` or ``math``; ``raw`` is the
    token as written and ``attr_list`` its attributes.  A formula in MathML is one token: ``math`` with its TeX, or
    text if it holds none.  The base parts of the page's URL ride along as ``b_*``
    for links to be resolved and are pruned where nothing asks for them.
    """
    pieces = F.filter(
        F.regexp_extract_all("html", F.lit(PIECES), F.lit(0)),
        lambda t: ~(t.startswith("<") & (F.length(t) > 1)) | ~t.rlike(DROPPED) | t.rlike(MATH),
    )
    base = urls.with_url_parts(by_page(pages), "url", "b_")
    # The outer form keeps Spark from filtering the pages before their shuffle, which would make it another one.
    tokens = base.select(
        "page_id", *[f"b_{part}" for part in urls.PARTS], F.posexplode_outer(pieces).alias("pos", "raw")
    ).where("pos is not null")
    raw = F.col("raw")
    is_formula = raw.rlike(IS_FORMULA)
    tokens = tokens.withColumn("tex", F.when(is_formula, formula_tex("raw")))
    is_tag = raw.startswith("<") & (F.length(raw) > 1) & F.coalesce(F.col("tex") != "", F.lit(True))
    tokens = tokens.withColumn(
        "tag", F.when(is_tag, F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][^\s/>]*)", 1))).otherwise(F.lit(""))
    ).withColumn("shown", F.when(F.col("tex").isNotNull(), formula_text("raw")))
    tag = F.col("tag")
    kind = (
        F.when(tag == "", "text")
        .when((tag == "script") | F.col("tex").isNotNull(), "math")
        .when(raw.startswith("</"), "close")
        .when(tag.isin(markup.VOID_TAGS) | raw.endswith("/>"), "void")
        .otherwise("open")
    )
    tokens = tokens.withColumns(
        {
            "kind": kind,
            "attrs": F.when((tag != "") & (tag != "script") & F.col("tex").isNull(), F.trim(F.regexp_extract(raw, markup.INSIDE, 1))).otherwise(F.lit("")),
            "text": F.when((tag == "") & F.col("tex").isNull(), markup.decoded("raw"))
            .when(tag == "", markup.decoded("shown"))
            .when(F.col("tex").isNotNull(), markup.decoded("tex"))
            .when(tag == "script", F.regexp_extract(raw, r"^<[^>]*>([\s\S]*?)(?:</[^>]*>)?\z", 1))
            .otherwise(F.lit("")),
        }
    )
    return tokens.withColumn("attr_list", F.when(F.col("attrs") != "", F.expr(markup.attributes_sql("attrs"))))


def formula_tex(raw: str) -> Column:
    """The TeX of a formula in MathML, or an empty string."""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(raw, source, 1)), F.lit("")) for source in TEX_SOURCES], F.lit(""))
    return F.when(F.col(raw).rlike(IS_FORMULA), found).otherwise(F.lit(""))


def formula_text(raw: str) -> Column:
    """What a formula shows: its text without annotations."""
    bare = F.regexp_replace(F.regexp_replace(raw, ANNOTATION, ""), "<[^>]*>", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def with_page_ends(tokens: DataFrame, names: list[str]) -> DataFrame:
    """Add ``<name>_last``, the greatest value of each column on its page."""
    whole = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tokens.withColumns({f"{name}_last": F.max(name).over(whole) for name in names})


def with_spans(tokens: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Add ``span_end`` to every open or void token: the position its element ends at.

    The level of a tag is its running open minus close count, taken before a
    close.  After an open the next row of its level can only be its close;
    stray closes shift the count but close nothing.  A ``p`` ends at the next
    ``p``; what is never closed ends with the page.  For each rising count in
    ``carried`` its value at the span's end is added as ``<name>_end``; ``paired``
    tells closes that close something.
    """
    names = ["pos", *carried]
    if "pos_last" not in tokens.columns:
        tokens = with_page_ends(tokens, names)
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    by_level = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    kind = F.col("kind")
    step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
    df = tokens.withColumns(
        {
            "balance": F.sum(step).over(by_tag.rowsBetween(Window.unboundedPreceding, 0)),
            "next_pos": F.lead("pos").over(by_tag),
            "next_kind": F.lead("kind").over(by_tag),
        }
    ).withColumn("level", F.when(kind != "void", F.col("balance") + F.when(kind == "close", 1).otherwise(0)))
    df = df.withColumns({f"{name}_end": F.lead(name).over(by_level) for name in names}).withColumn(
        "paired", (kind == "close") & F.coalesce(F.lag("kind").over(by_level) == "open", F.lit(False))
    )
    flat_end = F.when(F.col("next_kind") == "open", F.col("next_pos") - 1).otherwise(F.col("next_pos"))
    closes = F.when(F.col("tag") == "p", flat_end).otherwise(F.col("pos_end"))
    return df.withColumns(
        {
            "span_end": F.when(kind == "void", F.col("pos")).when(kind == "open", F.coalesce(closes, F.col("pos_last"))),
            **{f"{name}_end": F.coalesce(f"{name}_end", f"{name}_last") for name in carried},
        }
    ).drop("balance", "next_pos", "next_kind", "level", "pos_end", *[f"{name}_last" for name in names])


def inside_any(flag: Column) -> Column:
    """Whether a token lies in the span of a flagged open token at or before it on its page."""
    by_page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(flag, F.col("span_end"))).over(by_page) >= F.col("pos"), F.lit(False))
