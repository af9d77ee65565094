"""Building blocks of the check queries: plain SQL over the given tables.

Each named block is one common table expression; ``build`` puts those a query
needs, in order, before its last SELECT.
"""

from __future__ import annotations

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, sql: str, *needs: str) -> None:
    BLOCKS[name] = (list(needs), sql.strip())


def build(last: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in BLOCKS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{name} AS (\n{BLOCKS[name][1]}\n)" for name in order)
    return f"WITH RECURSIVE {parts}\n{last.strip()}" if order else last.strip()


RFC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{RFC}', {group}, 's')"


def key_of(scheme: str, netloc: str, path: str, query: str) -> str:
    """The query-string policy of a crawl key, for URLs with a host."""
    return rf"""CASE WHEN regexp_matches({path}, '\.(html|htm|php|asp|aspx|jsp)$') OR {path} = '' OR {path} LIKE '%/'
      THEN {scheme} || '://' || {netloc} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END
      ELSE {scheme} || '://' || {netloc} || {path} END"""


def crawlable(scheme: str, path: str) -> str:
    return (
        f"({scheme} IN ('http', 'https') AND NOT regexp_matches({path}, "
        r"'\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|zip|tar\.gz|exe|dmg)$'))"
    )


def decode(text: str) -> str:
    """The references that occur in the tables; ``&amp;`` comes last."""
    pairs = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
    for ref, char in pairs:
        text = f"replace({text}, '{ref}', '{char}')"
    return text


def attr(tag: str, name: str) -> str:
    """Value of an attribute of a tag, empty if absent."""
    found = rf"regexp_extract({tag}, '(?i)[\s\x22'']{name}\s*=\s*(\x22[^\x22]*\x22|''[^'']*''|[^\s\x22''>]+)', 1)"
    return decode(rf"regexp_replace({found}, '^[\x22'']|[\x22'']$', '', 'g')")


def anchors(pages: str, tolerant: bool = False) -> str:
    """Followable links of a table with page_id, url and html, in document order; ``tolerant`` by the fallback's pattern."""
    tags = (
        "list_filter(regexp_extract_all(html, "
        r"'(?is)<!--.*?(?:-->|\z)|<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)|<a\s[^>]*>'"
        "), lambda t: lower(t[1:2]) = '<a')"
    )
    href = attr("tag", "href")
    if tolerant:
        tags, href = r"""regexp_extract_all(html, '(?i)<a[^>]+href=[\x22\x27]([^\x22\x27]+)[\x22\x27][^>]*>', 1)""", "tag"
    return rf"""
SELECT page_id, url, pos, href, b_netloc, p_scheme AS t_scheme, p_netloc AS target_netloc, p_path AS t_path,
  {key_of('p_scheme', 'p_netloc', 'p_path', 'p_query')} AS target
FROM (
  SELECT *, {part('full_url', 1)} AS p_scheme, {part('full_url', 2)} AS p_netloc, {part('full_url', 3)} AS p_path, {part('full_url', 4)} AS p_query
  FROM (
    SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
        WHEN href LIKE '//%' THEN b_scheme || ':' || href
        WHEN href LIKE '/%' THEN b_scheme || '://' || b_netloc || href
        WHEN href LIKE '?%' THEN b_scheme || '://' || b_netloc || b_path || href
        ELSE b_scheme || '://' || b_netloc || regexp_replace(b_path, '[^/]*$', '') || href END AS full_url
    FROM (
      SELECT page_id, url, pos, {href} AS href,
        lower({part('url', 1)}) AS b_scheme, {part('url', 2)} AS b_netloc, {part('url', 3)} AS b_path
      FROM (SELECT page_id, url, unnest(tags) AS tag, (generate_subscripts(tags, 1) - 1)::INT AS pos
            FROM (SELECT page_id, url, {tags} AS tags FROM {pages}))
    )
    WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'javascript:%'
  )
)"""


block(
    "keyed",
    f"""
SELECT page_id, url, html, scheme, netloc, path, query, fragment, {key_of('scheme', 'netloc', 'path', 'query')} AS url_key
FROM (SELECT page_id, url, html, lower({part('url', 1)}) AS scheme, {part('url', 2)} AS netloc, {part('url', 3)} AS path,
        {part('url', 4)} AS query, {part('url', 5)} AS fragment FROM pages)
""",
)
block(
    "fetched",
    """
SELECT page_id, url_key, scheme, netloc, html, coalesce(html, '') <> '' AS ok
FROM keyed QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id DESC) = 1
""",
    "keyed",
)
block(
    "links",
    f"""
SELECT page_id, url, pos, href, target, target_netloc, (target_netloc = '' OR target_netloc = b_netloc) AS internal,
  {crawlable('t_scheme', 't_path')} AS crawlable
FROM ({anchors('pages')})
""",
)
block("ranked", "SELECT *, row_number() OVER (PARTITION BY netloc ORDER BY page_id) AS rk FROM fetched", "fetched")
block(
    "site_pages",
    """
SELECT p.page_id, p.url_key AS url, p.netloc, p.rk, p.ok AND p.page_id % 17 <> 5 AS ok,
  CASE WHEN contains(p.html, '</article>') THEN replace(p.html, '</article>', l.links || '</article>') ELSE p.html || l.links END AS html
FROM ranked p JOIN (
  SELECT p.page_id, '<p>' || coalesce('<a href="' || replace(a.url_key, '&', '&amp;') || '">left</a>', '')
    || coalesce('<a href="' || replace(b.url_key, '&', '&amp;') || '">right</a>', '')
    || coalesce('<a href="' || replace(a.url_key, '&', '&amp;') || '">again</a>', '')
    || '<a href=''#frag''>f</a><a href="javascript:void(0)">j</a><a href="mailto:a@example.com">m</a><A HREF=/file.pdf>d</A>'
    || '<a href="/PHOTO.JPG">p</a><a href="https://elsewhere.example/">e</a></p>' AS links
  FROM ranked p LEFT JOIN ranked a ON a.netloc = p.netloc AND a.rk = 2 * p.rk
  LEFT JOIN ranked b ON b.netloc = p.netloc AND b.rk = 2 * p.rk + 1) l ON l.page_id = p.page_id
""",
    "ranked",
)
block(
    "site_edges",
    f"""
SELECT url AS source, target, target_netloc, min(pos) AS pos FROM ({anchors('(SELECT * FROM site_pages WHERE ok)')})
WHERE {crawlable('t_scheme', 't_path')} GROUP BY ALL
""",
    "site_pages",
)
block("roots", "SELECT k.url AS root_url, r.netloc AS root_netloc, r.url_key AS root_key FROM ranked r JOIN keyed k USING (page_id) WHERE rk = 1", "ranked", "keyed")


def walk_blocks(p: str, opened: str, *needs: str) -> None:
    """What a crawl visits, as ``<p>visited`` and ``<p>visit_order``; ``opened`` is a test on the URL ``w.url``."""
    block(
        f"{p}walk",
        f"""
SELECT root_url, root_netloc, root_url AS url, root_key AS key, 0 AS depth FROM roots
UNION
SELECT w.root_url, w.root_netloc, e.target, e.target, w.depth + 1 FROM {p}walk w JOIN site_edges e ON e.source = w.key
WHERE w.depth < 5 AND (e.target_netloc = '' OR e.target_netloc = w.root_netloc) AND {opened}
""",
        "roots", "site_edges", *needs,
    )
    block(f"{p}visited", f"SELECT root_url, url, key, min(depth) AS depth FROM {p}walk GROUP BY root_url, url, key", f"{p}walk")
    # The order of discovery: the path of (position) steps from the root, compared step by step among the shortest paths.
    block(
        f"{p}walk_paths",
        f"""
SELECT root_url, root_netloc, root_url AS url, root_key AS key, 0 AS depth, []::BIGINT[] AS steps FROM roots
UNION ALL
SELECT w.root_url, w.root_netloc, e.target, e.target, w.depth + 1, list_append(w.steps, e.pos)
FROM {p}walk_paths w JOIN {p}visited p ON p.root_url = w.root_url AND p.url = w.url AND p.depth = w.depth
JOIN site_edges e ON e.source = w.key
JOIN {p}visited v ON v.root_url = w.root_url AND v.url = e.target AND v.depth = w.depth + 1
WHERE w.depth < 5 AND {opened}
""",
        "roots", "site_edges", f"{p}visited",
    )
    block(
        f"{p}visit_order",
        f"""
SELECT root_url, url, key, depth, row_number() OVER (PARTITION BY root_url ORDER BY depth, steps) AS ord
FROM (SELECT root_url, url, key, depth, min(steps) AS steps FROM {p}walk_paths GROUP BY root_url, url, key, depth)
""",
        f"{p}walk_paths",
    )


walk_blocks("", "true")
