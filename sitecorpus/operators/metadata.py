"""What a page says about itself, read from its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.functions import markup, urls
from sitecorpus.functions.text import listed, quoted

# Everything metadata is read from, found in one pass; what must not be read is matched too, and passed over.
HEAD = markup.any_of(
    markup.COMMENT,
    *[markup.raw_element(t) for t in ("script", "style", "noscript", "template", "title", "h1")],
    *[t + r"[\s/]" + markup.TAG_BODY + ">" for t in ("html", "meta", "link")],
)
ICON = r"(?:^|\s)icon(?:\s|\z)"
JSON_LD = r"""(?i)^<script[^>]*type=["']?application/ld\+json[^>]*>([\s\S]*?)</script\s*>"""


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _starting(pieces: str, start: str) -> str:
    return f"filter({pieces}, t -> lower(left(t, {len(start)})) = {quoted(start)})"


def _first_text(pieces: str, start: str) -> str:
    """Text of the first element that starts with ``start``, tags dropped."""
    return f"regexp_replace(coalesce(try_element_at({_starting(pieces, start)}, 1), ''), '<[^>]*>', '')"


def _drawn_together(text: str) -> str:
    return f"trim(regexp_replace({markup.decoded_sql(text)}, {quoted(BLANKS)}, ' '))"


BLANKS, SOLID = r"\s+", r"\S"


def _nodes_sql(blocks: str) -> str:
    """The objects of JSON-LD blocks: each block itself or what its list holds, and after each what its ``@graph`` holds."""
    parsed = f"filter(transform({blocks}, s -> try_parse_json(s)), v -> v IS NOT NULL)"
    listed_ = f"flatten(transform({parsed}, v -> {_members_sql('v')}))"
    graph = """try_variant_get(v, '$["@graph"]', 'variant')"""
    return f"flatten(transform({listed_}, v -> concat(array(v), {_members_sql(graph)})))"


def _members_sql(value: str) -> str:
    """A list's members; anything else alone."""
    return f"coalesce(try_variant_get({value}, '$', 'array<variant>'), array({value}))"


def _text_sql(value: str) -> str:
    """The value if it is text."""
    return f"IF(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), NULL)"


def page_metadata(pages: DataFrame) -> DataFrame:
    """X11 without the word count: one narrow pass, no shuffle.  ``title`` is ``Untitled`` if there is none."""
    base = [f"b_{part}" for part in urls.PARTS]
    df = urls.with_url_parts(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "url", "b_")
    df = df.selectExpr(
        "page_id",
        "url",
        *base,
        f"regexp_extract_all(html, {quoted(HEAD)}, 0) AS pieces",
        f"regexp_like(html, {quoted(SOLID)}) AS has_html",
    )
    as_attributes = f"t -> {markup.attributes_sql(markup.inside_sql('t'))}"
    df = df.selectExpr(
        "page_id",
        "url",
        *base,
        f"transform({_starting('pieces', '<meta')}, {as_attributes}) AS meta_lists",
        f"transform({_starting('pieces', '<link')}, {as_attributes}) AS link_lists",
        f"try_element_at(transform({_starting('pieces', '<html')}, {as_attributes}), 1) AS html_list",
        f"""transform(filter(pieces, t -> regexp_like(t, {quoted(JSON_LD)})), t -> trim(regexp_extract(t, {quoted(JSON_LD)}, 1)))
            AS schema_org_data""",
        f"{_first_text('pieces', '<title')} AS title_text",
        f"{_first_text('pieces', '<h1')} AS h1_text",
        "has_html",
    )
    get = markup.attribute_sql
    df = df.selectExpr(
        "page_id",
        "url",
        *base,
        f"""transform(meta_lists, a -> named_struct('name', lower({get('a', 'name')}), 'property', lower({get('a', 'property')}),
            'content', {get('a', 'content')})) AS metas""",
        f"""coalesce(try_element_at(transform(filter(link_lists, a -> regexp_like(lower({get('a', 'rel')}), {quoted(ICON)})),
            a -> {get('a', 'href')}), 1), '/favicon.ico') AS icon""",
        "schema_org_data",
        f"{_nodes_sql('schema_org_data')} AS ld_nodes",
        f"{_drawn_together('title_text')} AS title_tag",
        f"{_drawn_together('h1_text')} AS h1",
        f"{get('html_list', 'lang')} AS language",
        "has_html",
    )

    def meta(*names: str) -> str:
        hits = f"filter(metas, m -> (m.name IN ({listed(list(names))}) OR m.property IN ({listed(list(names))})) AND m.content <> '')"
        return f"try_element_at({hits}, 1).content"

    def ld_value(key: str) -> str:
        value = f"try_variant_get(v, '$.{key}', 'variant')"
        return f"try_element_at(filter(transform(ld_nodes, v -> {_text_sql(value)}), t -> t <> ''), 1)"

    people = f"""flatten(transform(ld_nodes, v -> {_members_sql("try_variant_get(v, '$.author', 'variant')")}))"""
    name = f"""coalesce({_text_sql("try_variant_get(p, '$.name', 'variant')")}, {_text_sql('p')})"""
    ld_author = f"try_element_at(filter(transform({people}, p -> {name}), t -> t <> ''), 1)"

    df = df.selectExpr(
        "page_id",
        "url",
        *base,
        "has_html",
        f"coalesce({meta('og:title')}, nullif(title_tag, ''), nullif(h1, ''), 'Untitled') AS title",
        f"coalesce({meta('description', 'og:description', 'twitter:description')}, {ld_value('description')}) AS description",
        f"coalesce({meta('author', 'article:author')}, {ld_author}) AS author",
        f"coalesce({meta('article:published_time', 'date', 'datepublished')}, {ld_value('datePublished')}) AS date_published",
        "regexp_replace(b_netloc, '^www[.]', '') AS domain",
        f"{meta('og:site_name')} AS site",
        "language",
        "icon",
        f"{meta('og:image')} AS image_href",
        "filter(metas, m -> m.name IS NOT NULL OR m.property IS NOT NULL) AS meta_tags",
        "schema_org_data",
    )
    df = urls.with_resolved(urls.with_resolved(df, "icon", "b_", "favicon"), "image_href", "b_", "image")
    return df.select(
        "page_id", "url", "has_html", "title", "description", "author", "date_published", "domain", "site", "language",
        "favicon", "image", "meta_tags", "schema_org_data",
    )
