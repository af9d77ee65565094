"""URL handling as column expressions.

``with_url_parts`` and ``with_target`` add columns in a few projections instead
of nesting one large expression, so that each part of a URL is computed once
per row and the plan stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.functions.text import endings, listed, quoted

# Path endings whose query string is kept.
CONTENT_ENDINGS = [".html", ".htm", ".php", ".asp", ".aspx", ".jsp"]
# Path endings that are not web pages.
BINARY_ENDINGS = [
    ".jpg", ".jpeg", ".png", ".gif", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".zip", ".tar.gz", ".exe", ".dmg",
]
# Schemes written with "//" even when the host is empty.
HOST_SCHEMES = ["http", "https", "ftp", "file"]
# Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = ["", "http", "https", "ftp", "sftp", "tel"]

PARTS = ["scheme", "netloc", "path", "params", "query", "fragment"]


# scheme, netloc, path, params, query, fragment.
SPLIT = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?((?:[^?#]*/)?[^?#;/]*)(?:;([^?#/]*))?"
    r"(?:\?([^#]*))?(?:#([\s\S]*))?"
)


def cleaned(url: Column) -> Column:
    """Without leading blanks and control characters and without tabs and line breaks."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def with_url_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add ``<prefix>scheme/netloc/path/params/query/fragment``, empty where absent.

    ``params`` is what follows ``;`` in the last path segment.
    """
    p, text = prefix, f"__{prefix}text"
    df = df.withColumn(text, cleaned(F.col(url)))
    raw = {name: f"regexp_extract({text}, {quoted(SPLIT)}, {i + 1})" for i, name in enumerate(PARTS)}
    df = df.selectExpr(
        *[c for c in df.columns if c != text],
        f"lower({raw['scheme']}) AS {p}scheme",
        *[f"{raw[name]} AS {p}{name}" for name in ("netloc", "query", "fragment")],
        f"{raw['path']} AS {p}path0",
        f"{raw['params']} AS {p}params0",
    )
    kept = [c for c in df.columns if c not in (f"{p}path0", f"{p}params0")]
    plain = f"({p}params0 = '' OR {p}scheme IN ({listed(PARAM_SCHEMES)}))"
    return df.selectExpr(
        *kept,
        f"IF({plain}, {p}path0, concat({p}path0, ';', {p}params0)) AS {p}path",
        f"IF({plain}, {p}params0, '') AS {p}params",
    )


def drop_parts(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[f"{prefix}{part}" for part in PARTS if part not in keep])


def unsplit_sql(scheme: str, netloc: str, path: str, params: str, query: str) -> str:
    """The parts of a URL, without its fragment, together again; ``path`` is rooted if there is a host."""
    tail = f"concat({path}, IF({params} <> '', concat(';', {params}), ''))"
    host = (
        f"IF({netloc} <> '' OR startswith({path}, '//') OR ({scheme} IN ({listed(HOST_SCHEMES)})"
        f" AND ({tail} = '' OR startswith({path}, '/'))), concat('//', {netloc}), '')"
    )
    return (
        f"concat(IF({scheme} <> '', concat({scheme}, ':'), ''), {host}, {tail},"
        f" IF({query} <> '', concat('?', {query}), ''))"
    )


# Walks path segments: ".." takes one back, "." is skipped, a final dot leaves a slash.
DOTLESS = """
array_join(
  concat(
    aggregate(split({path}, '/'), CAST(array() AS array<string>), (done, seg) ->
      CASE WHEN seg = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
           WHEN seg = '.' THEN done ELSE concat(done, array(seg)) END),
    IF(substring_index({path}, '/', -1) IN ('.', '..'), array(''), CAST(array() AS array<string>))),
  '/')"""


def _with_joined_parts(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add the parts of ``href`` seen from the page as ``<out>_...``, and ``<out>_foreign``."""
    h, b = f"__{out}h_", base
    df = with_url_parts(df, href, h)
    kept = [c for c in df.columns if not c.startswith(h)]
    dropped = [f"{h}{part}" for part in PARTS]
    directory = f"regexp_replace({b}path, '[^/]*\\\\z', '')"
    # Empty segments in the middle are dropped for relative paths only.
    relative = f"regexp_replace(concat({directory}, IF(endswith({directory}, '/'), '', '/'), {h}path), '(?<=.)/{{2,}}', '/')"
    df = df.selectExpr(
        *kept,
        *dropped,
        f"({h}scheme <> '' AND {h}scheme <> {b}scheme) AS {out}_foreign",
        f"({h}netloc = '' AND ({h}scheme = '' OR {h}scheme = {b}scheme)) AS {out}_local",
        f"IF(startswith({h}path, '/'), {h}path, {relative}) AS {out}_merged",
    )
    same_page = f"({out}_local AND {h}path = '' AND {h}params = '')"
    dotted = f"regexp_like({out}_merged, '(?:^|/)[.][.]?(?:/|\\\\z)')"
    walked = DOTLESS.format(path=f"{out}_merged")
    df = df.selectExpr(
        *kept,
        f"{out}_foreign",
        f"IF({h}scheme = '', {b}scheme, {h}scheme) AS {out}_scheme",
        f"IF({out}_local, {b}netloc, {h}netloc) AS {out}_netloc",
        f"""CASE WHEN NOT {out}_local THEN {h}path WHEN {same_page} THEN {b}path
            WHEN {dotted} THEN coalesce(nullif({walked}, ''), '/') ELSE {out}_merged END AS {out}_path0""",
        f"IF({same_page}, {b}params, {h}params) AS {out}_params",
        f"IF({same_page} AND {h}query = '', {b}query, {h}query) AS {out}_query",
        f"{h}fragment AS {out}_fragment",
    )
    kept = [c for c in df.columns if c != f"{out}_path0"]
    rooted = f"concat(IF({out}_netloc <> '' AND {out}_path0 <> '' AND NOT startswith({out}_path0, '/'), '/', ''), {out}_path0)"
    return df.selectExpr(*kept, f"{rooted} AS {out}_path")


def _unsplit_of(out: str) -> str:
    return unsplit_sql(*[f"{out}_{part}" for part in PARTS[:5]])


def with_resolved(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``href`` as an absolute URL, query and fragment kept; a URL of another scheme stays as it is."""
    kept = [c for c in df.columns]
    full = f"concat({_unsplit_of(out)}, IF({out}_fragment <> '', concat('#', {out}_fragment), ''))"
    return _with_joined_parts(df, href, base, out).selectExpr(*kept, f"IF({out}_foreign, {href}, {full}) AS {out}")


def with_target(df: DataFrame, href: str, base: str, out: str = "target") -> DataFrame:
    """Add the crawl key of ``href`` seen from the page.

    ``base`` is the prefix of the page's own URL parts (``with_url_parts``).
    Besides ``out`` this adds ``<out>_scheme``, ``<out>_netloc`` and ``<out>_path``.
    """
    kept = [c for c in df.columns]
    keeps_query = (
        f"(regexp_like({out}_path, {quoted(endings(CONTENT_ENDINGS))}) OR {out}_path = '' OR endswith({out}_path, '/'))"
    )
    return _with_joined_parts(df, href, base, out).selectExpr(
        *kept,
        f"""CASE WHEN NOT {keeps_query} THEN concat({out}_scheme, '://', {out}_netloc, {out}_path)
            WHEN {out}_foreign AND instr({href}, '#') = 0 THEN {href}
            ELSE {_unsplit_of(out)} END AS {out}""",
        f"{out}_scheme",
        f"{out}_netloc",
        f"{out}_path",
    )


def with_page_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    """The crawl key of a page's own URL, with its ``_scheme``, ``_netloc`` and ``_path``."""
    p = f"__{out}b_"
    return drop_parts(with_target(with_url_parts(df, url, p), url, p, out), p)


def is_internal(netloc: Column, root_netloc: Column) -> Column:
    """U4: an empty netloc, or exactly the root's."""
    return (netloc == "") | (netloc == root_netloc)


def is_crawlable(scheme: Column, path: Column) -> Column:
    """Http or https, and not a path that ends like a binary file."""
    return scheme.isin("http", "https") & ~path.rlike(endings(BINARY_ENDINGS))


def is_skipped_href(href: Column) -> Column:
    """Nothing to follow."""
    return (href == "") | href.startswith("#") | href.startswith("javascript:")


def document_key(url: Column) -> Column:
    """No trailing slashes, no ``www.`` after the scheme."""
    return F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), "(https?://)www\\.", "$1")


def output_root(netloc: Column) -> Column:
    """U8: host in lower case, without user, port and ``www.``; ``output`` if there is none."""
    after_user = F.substring_index(netloc, "@", -1)
    host = F.lower(
        F.when(after_user.startswith("["), F.regexp_extract(after_user, r"^\[([^\]]*)", 1))
        .otherwise(F.substring_index(after_user, ":", 1))
    )
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host == "", F.lit("output")).otherwise(host)


def site_key(scheme: Column, netloc: Column) -> Column:
    return F.concat(scheme, F.lit("://"), netloc)


def percent_decoded(text: Column) -> Column:
    """Decode ``%XX`` runs as UTF-8; a ``%`` without two hex digits and ``+`` stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    decoded = F.transform(
        pieces,
        lambda s: F.when(s.startswith("%") & (F.length(s) > 1), F.coalesce(F.try_url_decode(s), s)).otherwise(s),
    )
    return F.when(F.instr(text, "%") > 0, F.array_join(decoded, "")).otherwise(text)
