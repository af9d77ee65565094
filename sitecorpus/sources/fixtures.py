"""Site graph, robots files, sitemaps, decorated pages and runs derived from ``pages``.

The given pages link to nothing in the table and come without robots files and
sitemaps.  These derivations give the other operators whole, connected inputs
that grow with the pages, and keep every derived row of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import urls
from sitecorpus.operators.running import numbered
from sitecorpus.sources.snapshots import is_fetched, latest_pages

AGENT = "sitecorpus/1.0"
PART = 100  # pages listed by one sitemap file
SECTION = 1_000_000  # pages below one section index


def ranked_pages(pages: DataFrame) -> DataFrame:
    """One row per crawl key with ``rk``, its rank by page id within its host; written once, without HTML."""
    keys = cut(latest_pages(pages), "latest")
    return cut(numbered(keys, ["netloc"], "page_id", "rk"), "ranked")


def site_pages(pages: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Pages joined to a binary tree per host, with links that must not be followed.

    Page ``k`` of a host links to pages ``2k`` and ``2k + 1``; fetches fail for
    ``page_id % 17 = 5``.
    """
    ranked = ranked_pages(pages) if ranked is None else ranked
    names = ranked.select("netloc", "rk", "url_key")
    parents = names.select(
        "netloc",
        F.floor(F.col("rk") / 2).alias("rk"),
        F.struct("rk", F.replace("url_key", F.lit("&"), F.lit("&amp;")).alias("link")).alias("child"),
    ).where("rk > 0")
    children = parents.groupBy("netloc", "rk").agg(F.array_sort(F.collect_list("child")).alias("children"))
    first = F.try_element_at("children", F.lit(1))["link"]
    second = F.try_element_at("children", F.lit(2))["link"]

    def anchor(link: Column, text: str) -> Column:
        return F.coalesce(F.concat(F.lit('<a href="'), link, F.lit(f'">{text}</a>')), F.lit(""))

    links = F.concat(
        F.lit("<p>"),
        anchor(first, "left"),
        anchor(second, "right"),
        anchor(first, "again"),
        F.lit(
            "<a href='#frag'>f</a><a href=\"javascript:void(0)\">j</a><a href=\"mailto:a@example.com\">m</a>"
            "<A HREF=/file.pdf>d</A><a href=\"/PHOTO.JPG\">p</a><a href=\"https://elsewhere.example/\">e</a></p>"
        ),
    )
    with_links = F.when(
        F.contains("html", F.lit("</article>")), F.replace("html", F.lit("</article>"), F.concat(links, F.lit("</article>")))
    ).otherwise(F.concat("html", links))
    linked = ranked.join(children, ["netloc", "rk"], "left")
    return linked.join(pages.select("page_id", "html"), "page_id").select(
        "page_id",
        F.col("url_key").alias("url"),
        "netloc",
        "rk",
        with_links.alias("html"),
        (is_fetched(F.col("html")) & (F.col("page_id") % 17 != 5)).alias("ok"),
    )


def site_roots(pages: DataFrame, ranked: DataFrame) -> DataFrame:
    """The first page of each host, under its URL as stored: with query and fragment."""
    return ranked.where("rk = 1").join(pages.select("page_id", "url"), "page_id").select(
        F.col("url").alias("root_url"), F.col("netloc").alias("root_netloc")
    )


def sites(pages: DataFrame) -> DataFrame:
    """One row per ``scheme://netloc`` with its lowest page id."""
    parts = urls.with_url_parts(pages.select("page_id", "url"), "url", "p_")
    return parts.groupBy(urls.site_key(F.col("p_scheme"), F.col("p_netloc")).alias("site")).agg(
        F.min("page_id").alias("n")
    )


LONG_FILE = (
    "User-agent: SiteCorpus\nAllow: /en/1\n" + "".join(f"Disallow: /x{i % 50}/{i}\nAllow: /de/{i}\n" for i in range(40)) + "Disallow: /en/\nDisallow: /de\n"
)


def robots_docs(pages: DataFrame) -> DataFrame:
    """A robots file or an answer without one for each site, by ``n % 5``; some have long files, some answer with 401 or 503."""
    kind = F.col("n") % 5
    body = (
        F.when(
            kind == 0,
            F.concat(
                F.lit("User-agent: *\nDisallow: *\nDisallow: /%64e/\nCrawl-delay: "),
                (F.col("n") % 4).cast("string"),
                F.lit("\n\nSitemap: "),
                F.col("site"),
                F.lit("/sitemap.xml\n"),
            ),
        )
        .when(F.col("n") % 10 == 6, F.lit(LONG_FILE))
        .when(
            kind == 1,
            F.lit(
                "Disallow: /\nUser-agent: other\nUser-Agent: SiteCorpus\nAllow: /en/1\nDisallow: /en/\n"
                "\nUser-agent: *\nDisallow: /\n"
            ),
        )
        .when(kind == 2, F.lit("# none\nUser-agent: *  # all\nDisallow:\nCrawl-delay: 1.5\n"))
        .otherwise(F.lit(""))
    )
    status = F.when(kind == 3, 403).when(F.col("n") % 20 == 9, 503).when(F.col("n") % 20 == 19, 401).when(kind == 4, 404).otherwise(200)
    return sites(pages).select("site", status.alias("status"), body.alias("body"))


def sitemap_docs(pages: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Sitemaps per site by ``n % 4``; files of ``PART`` pages below section indexes.

    0: index, sections, files.  1: the same with the files halved and the first
    page in both halves.  2: plain text first, then a urlset that lists itself
    and a page whose name looks like a sitemap.  3: none.
    """
    ranked = ranked_pages(pages) if ranked is None else ranked
    per_site = numbered(
        ranked.select("page_id", "url_key", urls.site_key(F.col("scheme"), F.col("netloc")).alias("site")),
        ["site"], "page_id", "k",
    )
    listed = per_site.join(sites(pages), "site").select(
        "site",
        (F.col("n") % 4).alias("kind"),
        "k",
        F.floor((F.col("k") - 1) / PART).alias("part"),
        F.floor((F.col("k") - 1) / SECTION).alias("section"),
        F.replace("url_key", F.lit("&"), F.lit("&amp;")).alias("loc"),
    )

    kind, k, part = F.col("kind"), F.col("k"), F.col("part")

    def name(text: str, *cols: str) -> Column:
        return F.concat("site", F.format_string(text, *cols)) if cols else F.concat("site", F.lit(text))

    def entry(when: Column, doc: Column, tag: str, pos: Column, loc: Column) -> Column:
        made = F.struct(doc.alias("url"), F.lit(tag).alias("tag"), pos.cast("long").alias("pos"), loc.alias("loc"))
        return F.when(when, made)

    whole, section = name("/part-%d.xml", "part"), name("/section-%d.xml", "section")
    a_half, b_half = name("/a-%d.xml", "part"), name("/b-%d.xml", "part")
    in_a, in_b = (kind == 1) & ((k == 1) | (k % 2 == 0)), (kind == 1) & (k % 2 == 1)
    wp = name("/wp-sitemap.xml")
    later = (kind == 2) & (part > 0)
    # Every page names its file, its section and its root; the repeats of the upper levels fall together below.
    entries = listed.select(
        F.explode(
            F.filter(
                F.array(
                    entry(kind == 0, whole, "url", k, F.concat(F.lit("  "), "loc", F.lit(" "))),
                    entry(in_a, a_half, "url", k, F.col("loc")),
                    entry(in_b, b_half, "url", k, F.col("loc")),
                    entry((kind == 2) & (part == 0), wp, "url", k, F.col("loc")),
                    entry(later, whole, "url", k, F.col("loc")),
                    entry((kind == 0) | later, section, "sitemap", part, whole),
                    entry(in_a, section, "sitemap", part * 2, a_half),
                    entry(in_b, section, "sitemap", part * 2 + 1, b_half),
                    entry(kind == 0, name("/sitemap.xml"), "sitemap", F.col("section"), section),
                    entry(kind == 1, name("/sitemap_index.xml"), "sitemap", F.col("section"), section),
                    entry(kind == 2, wp, "url", F.lit(-2), name("/about-sitemap")),
                    entry(kind == 2, wp, "url", F.lit(-1), wp),
                    entry(later, wp, "url", F.col("section") + PART + 1, section),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("e")
    ).select("e.*")
    item = F.concat(F.lit("<"), "tag", F.lit("><loc>"), "loc", F.lit("</loc></"), "tag", F.lit(">"))
    docs = (
        entries.groupBy("url", "tag")
        .agg(F.array_sort(F.collect_set(F.struct("pos", item.alias("item")))).alias("items"))
        .select("url", "tag", F.array_join(F.col("items.item"), "").alias("items"))
    )
    outer = F.when(F.col("tag") == "url", "urlset").otherwise("sitemapindex")
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<'), outer, F.lit(">"), "items", F.lit("</"), outer, F.lit(">")
    )
    plain = listed.where((kind == 2) & (k == 1)).select(
        name("/sitemap.xml").alias("url"), F.lit("see the pages of this site").alias("body")
    )
    return docs.select("url", broken(F.col("url"), body).alias("body")).unionByName(plain)


def broken(url: Column, body: Column) -> Column:
    """The bodies of some files as crawls find them: without the last end tags, cut off in an entry, an end tag left out."""
    return (
        F.when(url.endswith("/wp-sitemap.xml"), F.regexp_replace(body, "</url></urlset>$", ""))
        .when(url.rlike("/section-[0-9]+[.]xml$"), F.regexp_replace(body, "</loc></sitemap></sitemapindex>$", ""))
        .when(url.rlike("/a-[0-9]+[.]xml$"), F.regexp_replace(body, r"\A([\s\S]*?)</url>", "$1"))
        .otherwise(body)
    )


HEAD = (
    '<meta name="description" content="About page {id} &amp; more"><meta name=author content="Author {mod}">'
    '<meta property="og:image" content="/img/{id}.png"><meta property=\'og:site_name\' content=\'Site {mod}\'>'
    '<meta property="article:published_time" content="2024-01-1{mod}"><link rel="shortcut icon" href="/icons/{mod}.ico">'
    '<script type="application/ld+json">{{"@type":"Article","author":{{"name":"Writer {mod}"}}}}</script>'
)
BODY = (
    '<p style="display: none">Hidden text of page {id}, not to be seen by anyone at all.</p>'
    '<div class="newsletter-signup"><p>Sign up for our newsletter, it is free of charge today.</p></div>'
    '<img src="/dot.gif" width="16" height="16" alt="dot"><img src="photo-{id}.jpg" width=640 height="480" alt="A photo">'
    '<h2>Code &lt;{mod}&gt;</h2><pre><code class="hl language-python">if x &lt; {id}:\n    print("x")\n</code></pre>'
    '<ul><li><a href="/one">one link only here</a></li><li><a href="two">another link only here</a></li></ul>'
    '<ol><li>First item, with <em>stress</em> and a <a href="../up?x=1">reference</a>.</li>'
    '<li>Second item, with <code>code</code>.</li></ol>'
    '<blockquote><p>To be quoted, or not to be quoted.</p></blockquote>'
    '<p>A note, of number {mod}<sup><a href="#fn{mod}" class="footnote-ref">{mod}</a></sup>, ends this '
    '<script type="math/tex">x^{mod}</script> and <span class="katex"><span class="katex-mathml"><math><semantics><mrow><mi>y</mi></mrow>'
    '<annotation encoding="application/x-tex">y_{mod} &lt; 9</annotation></semantics></math></span>'
    '<span class="katex-html" aria-hidden="true">y drawn</span></span> page.</p>'
)


def run_pages(pages: DataFrame) -> DataFrame:
    """Pages for whole runs: some have a menu and no text, some a name that no file system takes."""
    long_name = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"), F.repeat(F.lit("é"), 150))
    menu = F.format_string("<html><body><nav>Menu of %d</nav></body></html>", "page_id")
    return pages.select(
        "page_id",
        F.when(F.col("page_id") % 29 == 7, long_name).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 13 == 4, menu).otherwise(F.col("html")).alias("html"),
    )


def _filled(template: str) -> Column:
    """The template with ``{id}`` and ``{mod}`` of the page, as a column."""
    text = F.lit(template.replace("{{", "{").replace("}}", "}"))
    text = F.replace(text, F.lit("{id}"), F.col("page_id").cast("string"))
    return F.replace(text, F.lit("{mod}"), (F.col("page_id") % 10).cast("string"))


def rich_pages(pages: DataFrame) -> DataFrame:
    """All pages with metadata, images, code, lists and hidden parts."""
    og_title = F.when(F.col("page_id") % 2 == 0, _filled('<meta property="og:title" content="Title &quot;{id}&quot;">')).otherwise(F.lit(""))
    html = F.replace("html", F.lit("</head>"), F.concat(og_title, _filled(HEAD), F.lit("</head>")))
    html = F.replace(html, F.lit("</article>"), F.concat(_filled(BODY), F.lit("</article>")))
    return pages.select("page_id", "url", html.alias("html"))


def with_blank_copies(pages: DataFrame) -> DataFrame:
    """The pages, and a copy without text of every tenth under an id of its own."""
    blank = pages.where("page_id % 10 = 0").select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit("  \n ").alias("html"))
    return pages.unionByName(blank)


def run_one(pages: DataFrame) -> DataFrame:
    """A first run over all pages ``(page_id, url, content)``, in page order."""
    return pages.select(F.col("page_id").alias("seq"), "url", "content")


def run_two(pages: DataFrame) -> DataFrame:
    """A second run: renamed forms of known pages, and pages that meet them under the same path."""
    again = pages.where("page_id % 3 = 0").select(
        F.col("page_id").alias("seq"),
        F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/")))
        .otherwise(F.regexp_replace("url", "//www\\.", "//"))
        .alias("url"),
        F.concat(F.lit("New.\n\n"), "content").alias("content"),
    )
    other = F.when(F.col("url").startswith("https:"), F.regexp_replace("url", "^https:", "http:")).otherwise(
        F.regexp_replace("url", "^http:", "https:")
    )
    twins = pages.where("page_id % 10 = 1").select(
        (F.col("page_id") + 10_000_000_000).alias("seq"),
        other.alias("url"),
        F.concat(F.lit("Twin.\n\n"), "content").alias("content"),
    )
    return again.unionByName(twins)
