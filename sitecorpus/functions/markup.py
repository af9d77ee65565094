"""Patterns and expressions for HTML text.

The patterns avoid repeated groups that backtrack, so that a long or broken
page can neither overflow the stack nor take quadratic time.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitecorpus.functions.text import quoted

# Inside of a tag: anything up to ">", where a quoted value may hold ">".
TAG_BODY = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
# Bodies of markup, to be put behind a common "<" so that matching skips plain text quickly.
COMMENT = r"!--[\s\S]*?(?:-->|\z)"


def raw_element(name: str) -> str:
    """An element whose content is not markup; a missing end tag runs to the end of the page."""
    return rf"{name}(?:\s[^>]*)?>[\s\S]*?(?:</{name}\s*>|\z)"


def any_of(*bodies: str) -> str:
    return "(?i)<(?:" + "|".join(bodies) + ")"


# One attribute, with or without a value.
ATTRIBUTE = r"""[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""

# HTML elements that never have content.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]

# Named character references, as HTML defines them; some may end without ";".
ENTITIES = {f"&{name}": text for name, text in html5.items()}

REFERENCE = r"&#[0-9]+;|&#[xX][0-9A-Fa-f]+;|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"
# Without ";" a reference is a whole word and not the name of a URL's parameter.
LOOSE_REFERENCE = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*+(?!=);?|[^&]+|&"


def _numeric_sql(digits: str, base: int) -> str:
    """The character of a number; U+FFFD for one that is none."""
    code = f"CAST(conv(right({digits}, 7), {base}, 10) AS INT)"
    return (
        f"IF(ltrim('0', {digits}) <> '' AND length(ltrim('0', {digits})) <= 7 AND ({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111),"
        f" decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), '�')"
    )


def decoded_sql(text: str, loose: bool = True) -> str:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``; ``loose`` also those that end without ``;``, as HTML allows."""
    table = "str_to_map({}, '\\u0001', '\\u0002')".format(
        quoted("\x01".join(k + "\x02" + v for k, v in ENTITIES.items()))
    )
    return f"""IF(instr({text}, '&') > 0, array_join(transform(regexp_extract_all({text}, {quoted(LOOSE_REFERENCE if loose else REFERENCE)}, 0), ref ->
      CASE WHEN NOT startswith(ref, '&') OR length(ref) = 1 THEN ref
        WHEN startswith(lower(ref), '&#x') THEN {_numeric_sql("rtrim(';', substr(ref, 4))", 16)}
        WHEN startswith(ref, '&#') THEN {_numeric_sql("rtrim(';', substr(ref, 3))", 10)}
        ELSE coalesce(try_element_at({table}, ref), ref) END), ''), {text})"""


def attributes_sql(attrs: str) -> str:
    """All attributes in the inside of a tag, as an array of ``(name, value)`` with decoded values."""
    name = f"lower(regexp_extract(entry, {quoted(r'^[^\s=]+')}, 0))"
    value = f"regexp_replace(regexp_extract(entry, {quoted(r'^[^=]+=\s*([\s\S]*)')}, 1), {quoted(QUOTES)}, '')"
    return f"""transform(
      transform(regexp_extract_all({attrs}, {quoted(ATTRIBUTE)}, 0), entry -> named_struct('name', {name}, 'value', {value})),
      pair -> named_struct('name', pair.name, 'value', {decoded_sql('pair.value')}))"""


QUOTES = r"""^["']|["']\z"""


def attribute_sql(attribute_list: str, name: str) -> str:
    """Value of the first attribute ``name`` in an array from ``attributes_sql``; NULL if absent."""
    return f"try_element_at(filter({attribute_list}, pair -> pair.name = {quoted(name)}), 1).value"


def inside_sql(tag: str) -> str:
    """What stands between the tag name and the closing ``>``."""
    return f"regexp_extract({tag}, {quoted(INSIDE)}, 1)"


INSIDE = r"^</?[A-Za-z][^\s/>]*([\s\S]*?)/?>\z"


def tags_sql(html: str, pattern: str, start: str) -> str:
    """The attributes of each tag among the matches of ``pattern`` that starts with ``start``."""
    mine = f"filter(regexp_extract_all({html}, {quoted(pattern)}, 0), tag -> lower(left(tag, {len(start)})) = {quoted(start)})"
    return f"transform({mine}, tag -> {attributes_sql(inside_sql('tag'))})"


def decoded(text: str) -> Column:
    return F.expr(decoded_sql(text))


def attribute(attribute_list: str, name: str) -> Column:
    return F.expr(attribute_sql(attribute_list, name))
