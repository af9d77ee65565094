"""Whole runs over small sites, and the ledger they keep."""

import pytest

from sitecorpus.operators import site_run
from sitecorpus.operators.site_run import Rules, run_sites

PAGE = "<html><head><title>T {0}</title></head><body><article><p>This is the text of page {0}, and it is long enough.</p>{1}</article></body></html>"
LONG = "é" * 150


def page(name, *links):
    return PAGE.format(name, "".join(f'<a href="{u}">x</a>' for u in links))


PAGES = [
    # a.com has a sitemap, which lists one page twice, one that robots deny, and one that is not stored.
    (1, "http://a.com/", page("home"), True),
    (2, "http://a.com/x", page("x"), True),
    (3, "http://a.com/x/", page("x again"), True),
    (4, "http://a.com/no/1", page("no"), True),
    (5, "http://a.com/menu", "<html><body><nav>Menu</nav></body></html>", True),
    (6, f"http://a.com/{LONG}", page("long"), True),
    (7, "http://a.com/down", "", False),
    (8, "https://www.a.com/x", page("secure x"), True),
    # b.com has none and is crawled, from a root with a fragment.
    (20, "http://b.com/start", page("start", "/one", "/no", "/start"), True),
    (21, "http://b.com/one", page("one", "/two", "/broken"), True),
    (22, "http://b.com/two", page("two"), True),
    (23, "http://b.com/no", page("no", "/hidden"), True),
    (24, "http://b.com/hidden", page("hidden"), True),
    (25, "http://b.com/broken", page("broken"), False),
    # c.com is not stored at all.
]
ROBOTS = [("http://a.com", 200, "User-agent: *\nDisallow: /no/\n"), ("http://b.com", 200, "User-agent: *\nDisallow: /no\n")]
LISTED = ["/x", "/no/1", "/menu", f"/{LONG}", "/down", "/gone", "/x", "/x/", "/"]
SITEMAPS = [("http://a.com/sitemap.xml", "<?xml version='1.0'?><urlset>" + "".join(f"<url><loc>http://a.com{u}</loc></url>" for u in LISTED) + "<url><loc>https://www.a.com/x</loc></url></urlset>")]
ROOTS = [("http://a.com/", "a.com"), ("http://b.com/start#top", "b.com"), ("http://c.com/", "c.com")]


@pytest.fixture(scope="module")
def inputs(spark):
    return (
        spark.createDataFrame(ROOTS, "root_url string, root_netloc string"),
        spark.createDataFrame(PAGES, "page_id long, url string, html string, ok boolean"),
        spark.createDataFrame(ROBOTS, "site string, status int, body string"),
        spark.createDataFrame(SITEMAPS, "url string, body string"),
    )


def ledger_of(run):
    rows = sorted(run.ledger.collect(), key=lambda r: (r.root_url, r.seq))
    return [(r.root_url.split("/")[2], r.seq, r.url and r.url.split("/", 3)[3], r.source, r.page_id, r.outcome, r.path) for r in rows]


def test_markdown_run(inputs):
    run = run_sites(*inputs, Rules("sitecorpus/1.0"), width=4)
    assert ledger_of(run) == [
        # Equal entries of a file are queued once; the page's other forms are pages of their own.
        ("a.com", 1, "x", "sitemap", 2, "saved", "a.com/x.md"),
        ("a.com", 2, "no/1", "sitemap", None, "disallowed", None),
        ("a.com", 3, "menu", "sitemap", 5, "no_content", None),
        ("a.com", 4, LONG, "sitemap", 6, "not_saved", None),
        ("a.com", 5, "down", "sitemap", None, "empty_body", None),
        ("a.com", 6, "gone", "sitemap", None, "empty_body", None),
        ("a.com", 7, "x/", "sitemap", 3, "saved", "a.com/x.md"),
        ("a.com", 8, "", "sitemap", 1, "saved", "a.com/index.md"),
        ("a.com", 9, "x", "sitemap", 8, "saved", "a.com/x_1.md"),
        ("b.com", 1, "start#top", "crawl", 20, "saved", "b.com/start.md"),
        ("b.com", 2, "one", "crawl", 21, "saved", "b.com/one.md"),
        ("b.com", 3, "start", "crawl", 20, "saved", "b.com/start_1.md"),
        ("b.com", 4, "two", "crawl", 22, "saved", "b.com/two.md"),
        ("c.com", 0, None, "none", None, "no_urls", None),
    ]
    files = {(r.root_url, r.path): r.document for r in run.files.collect()}
    assert len(files) == 7
    # Of one file's contents the last stays.
    assert 'source_url: "http://a.com/x/"' in files["http://a.com/", "a.com/x.md"] and "x again" in files["http://a.com/", "a.com/x.md"]
    assert 'source_url: "http://b.com/start#top"' in files["http://b.com/start#top", "b.com/start.md"]
    summary = {r.root_url: tuple(r)[1:] for r in site_run.run_summary(run.ledger).collect()}
    assert summary == {
        "http://a.com/": (4, 5, 1, 2, 1, 1, False),
        "http://b.com/start#top": (4, 0, 0, 0, 0, 0, False),
        "http://c.com/": (0, 0, 0, 0, 0, 0, True),
    }


def test_html_run_without_robots(inputs):
    run = run_sites(*inputs, Rules("sitecorpus/1.0", respect_robots=False, fmt="html"), width=4)
    rows = ledger_of(run)
    paths = [r[6] for r in rows if r[0] == "a.com"]
    # HTML has no same-page test: every repeat is numbered.
    # A menu alone still has its frame in HTML.
    assert paths == ["a.com/x.html", "a.com/no/1.html", "a.com/menu.html", None, None, None, "a.com/x_1.html", "a.com/index.html", "a.com/x_2.html"]
    assert {r[2] for r in rows if r[0] == "b.com"} == {"start#top", "start", "one", "two", "no", "hidden"}
    assert run.files.count() == sum(r[5] == "saved" for r in rows)


def test_sitemap_only(inputs):
    run = run_sites(*inputs, Rules("sitecorpus/1.0", sitemap_only=True, max_depth=2), width=4)
    assert {(r.root_url, r.outcome) for r in run.ledger.where("source = 'none'").collect()} == {("http://b.com/start#top", "no_urls"), ("http://c.com/", "no_urls")}


def test_no_roots(inputs):
    roots, *rest = inputs
    run = run_sites(roots.limit(0), *rest, Rules("sitecorpus/1.0"))
    assert run.ledger.collect() == [] and run.files.collect() == []
