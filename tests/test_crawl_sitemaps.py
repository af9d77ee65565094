import random
import re
from collections import deque

from sitecorpus.operators import crawl, links, sitemaps
from sitecorpus.sources.snapshots import with_sitemap_test


def brute_crawl(root, graph, depth):
    seen, queue, out = set(), deque([(root, 0)]), []
    while queue:
        url, d = queue.popleft()
        if url in seen or d > depth:
            continue
        seen.add(url)
        out.append((url, d))
        for link in graph.get(url, []):
            if link not in seen:
                queue.append((link, d + 1))
    return out


def test_crawl_equals_brute_force(spark):
    rng = random.Random(11)
    names = [f"http://h.example/{i}" for i in range(60)]
    graph = {u: [rng.choice(names) for _ in range(rng.randint(0, 4))] for u in names if rng.random() < 0.8}
    pages = [(i, u, "".join(f'<a href="{t}">x</a>' for t in ts), True) for i, (u, ts) in enumerate(graph.items())]
    pages += [(900, "http://bad.example/", "<a href='/x'>", False)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, ok boolean")
    roots = spark.createDataFrame(
        [(names[0], "h.example"), (names[7], "h.example"), ("http://bad.example/", "bad.example")],
        "root_url string, root_netloc string",
    )
    for depth in (0, 3, 5):
        got = crawl.crawl(roots, crawl.crawl_edges(df), depth, ordered=True, width=4).collect()
        for root in (names[0], names[7]):
            mine = sorted((r.ord, r.url, r.depth) for r in got if r.root_url == root)
            assert [(u, d) for _, u, d in mine] == brute_crawl(root, graph, depth)
            assert [o for o, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(r.url, r.depth) for r in got if "bad" in r.root_url] == [("http://bad.example/", 0)]
    out = crawl.with_outcome(crawl.crawl(roots, crawl.crawl_edges(df), 2), df)
    hist = crawl.depth_histogram(out).where("root_url = 'http://bad.example/'").collect()
    assert [(r.visited, r.fetched, r.failed) for r in hist] == [(1, 0, 1)]


def test_links(spark):
    html = (
        '<main><a href="/page2">a</a><a href="/page2#x">b</a><a href="javascript:void(0)">c</a><a href="#s">d</a>'
        '<!-- <a href="/no">n</a> --><script>"<a href=\'/no\'>"</script><A\nHREF=/bare>e</A><a href="">f</a><a name=x>g</a>'
        '<a title="x > y" href=\'/q?a=1&amp;b=2\'>h</a><a href="/d/?a=1&amp;b=2">i</a><area href="/area"><a href="https://o.com/">o</a>'
        '<a href="/x.pdf">p</a>'
    )
    df = spark.createDataFrame([(1, "https://example.com", html), (2, "https://example.com/e", "")], "page_id long, url string, html string")
    got = links.page_links(df)
    kept = [r.target for r in links.followed(got).orderBy("pos").collect()]
    assert kept == [
        "https://example.com/page2", "https://example.com/page2", "https://example.com/bare", "https://example.com/q",
        "https://example.com/d/?a=1&b=2"]
    loose = [r.target for r in links.followed(links.page_links(df, "regex")).orderBy("pos").collect()]
    assert loose == [
        "https://example.com/page2", "https://example.com/page2", "https://example.com/no", "https://example.com/no",
        "https://example.com/d/?a=1&amp;b=2", "https://example.com/area"]
    assert {r.page_id: r.n_links for r in links.links_per_page(df, got).collect()} == {1: 5, 2: 0}
    assert sorted((r.target_host, r.reason, r.n_links) for r in links.dropped_links(got).collect()) == [
        ("example.com", "not_a_page", 1), ("o.com", "external", 1)]


URLSET = '<?xml version="1.0"?><urlset xmlns="x">{}</urlset>'
INDEX = '<?xml version="1.0"?><sitemapindex>{}</sitemapindex>'


def urlset(*locs):
    return URLSET.format("".join(f"<url><loc>{u}</loc></url>" for u in locs))


def index(*locs):
    return INDEX.format("".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs))


def test_sitemap_parsing(spark):
    docs = [
        ("a", URLSET.format("<url>\n<loc>  https://e.com/p?a=1&amp;b=2 </loc><lastmod>1</lastmod></url><url></url>"
                            "<!-- <url><loc>no</loc></url> --><url><image:loc>i</image:loc><loc><![CDATA[https://e.com/c]]></loc></url>")),
        ("b", index("https://e.com/s1.xml", "https://e.com/s2")), ("c", "<urlset></urlset>"), ("d", "not valid xml"), ("e", ""), ("f", None),
    ]
    df = spark.createDataFrame(docs, "url string, body string")
    got = [(r.doc_url, r.kind, r.pos, r.loc, r.nested) for r in sitemaps.sitemap_locs(df).orderBy("doc_url", "pos").collect()]
    assert got == [
        ("a", "urlset", 0, "https://e.com/p?a=1&b=2", False), ("a", "urlset", 1, "https://e.com/c", False),
        ("b", "index", 0, "https://e.com/s1.xml", True), ("b", "index", 1, "https://e.com/s2", True)]
    assert [r.url for r in with_sitemap_test(df).where("valid").orderBy("url").collect()] == ["a", "b"]


class Recovering:
    """A parser that goes on: an end tag closes the innermost element, the end of the text all."""

    TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*(?:>|\Z)|</?[A-Za-z_:][^<>]*>|</?(?:[A-Za-z_:][^<>]*)?\Z|[^<]+|<", re.S)

    def __init__(self, text):
        self.all, stack = [], []
        if not text.lstrip().startswith("<"):
            return
        for t in self.TOKEN.findall(text.strip()):
            if t.startswith(("<?", "<!D")) or not t.strip() or re.fullmatch(r"</?(?:[A-Za-z_:][^<>]*)?", t):
                continue
            if re.match("<[A-Za-z_:]", t):
                node = (re.match(r"<([^\s/>]+)", t)[1], [])
                self.all.append((node, [*stack, node]))
                if stack:
                    stack[-1][1].append(node)
                if not t.endswith("/>"):
                    stack.append(node)
            elif t.startswith("</"):
                stack.pop()
                if not stack:
                    break
            elif stack:
                stack[-1][1].append(t if not t.startswith("<![") else t[9:].removesuffix("]]>"))

    def locs(self):
        kind = "sitemap" if any(n[0] == "sitemapindex" for n, _ in self.all) else "url"
        out = []
        for entry, _ in self.all:
            if entry[0] == kind:
                inner = [n for n, path in self.all if n[0] == "loc" and any(p is entry for p in path)]
                if inner and inner[0][1] and all(isinstance(c, str) and not c.startswith("<!--") for c in inner[0][1]):
                    text = "".join(inner[0][1]).strip().replace("&amp;", "&")
                    out += [text] if text else []
        return out


BROKEN = [
    "<urlset><url><loc>http://e/1</loc></url><url><loc>http://e/2</loc>",
    "<urlset><url><loc>http://e/1</loc></url><url><loc>http://e/2",
    "<urlset><url><loc>http://e/1</loc></url><url><loc>http://e/2</lo",
    "<urlset><url><loc>http://e/1</loc><url><loc>http://e/2</loc></url></urlset>",
    "<urlset><url><loc>http://e/1</url><url><loc>http://e/2</loc></url></urlset>",
    "<urlset><url><loc>http://e/1</loc></urlset><url><loc>http://e/2</loc></url>",
    "<urlset><url><loc>http://e/1</loc></url></urlset><url><loc>http://e/2</loc></url>",
    "junk <urlset><url><loc>http://e/1</loc></url></urlset>",
    "\ufeff \n<?xml version='1.0'?><!DOCTYPE x><urlset><url><loc/><loc>http://e/1</loc></url><url><loc>http://e/<!-- c -->2</loc></url></urlset>",
    "<sitemapindex><sitemap><loc>http://e/<![CDATA[3&amp;]]>.xml</loc></sitemap><sitemap><lastmod>1</lastmod><sitemap><loc>http://e/4.xml",
    "<urlset><url><a><loc>http://e/deep</loc></a></url><url><loc><b>x</b></loc></url><url><image:loc>i</image:loc></url></urlset>",
    "<urlset><url><url><url><loc>http://e/inner</loc></url></url></url></urlset>",
]


def test_broken_sitemaps_equal_a_recovering_parser(spark):
    rng = random.Random(3)
    parts = ["<url>", "</url>", "<loc>", "</loc>", "<loc>http://e/p</loc>", "<x/>", "http://e/q", " ", "<sitemap>", "</urlset>", "<!-- c -->", "<![CDATA[http://e/c]]>"]
    texts = BROKEN + ["<urlset>" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, body string")
    got = {}
    for r in sitemaps.sitemap_locs(df).orderBy("pos").collect():
        got.setdefault(int(r.doc_url), []).append(r.loc)
    for i, t in enumerate(texts):
        want = Recovering(t).locs() if "CDATA[3" not in t else ["http://e/3&amp;.xml", "http://e/4.xml", "http://e/4.xml"]
        assert got.get(i, []) == want, t
    assert got[0] == ["http://e/1", "http://e/2"] == got[1]


def brute_expand(start, docs):
    out, queue, handled = [], list(docs.get(start, [])), set()
    like = lambda u: u.endswith(".xml") or "sitemap" in u.lower()
    while queue:
        url = queue.pop(0)
        if url in handled:
            continue
        handled.add(url)
        if like(url):
            nested = docs.get(url, [])
            if any(like(u) for u in nested):
                queue.extend(nested)
            else:
                out.extend(nested)
        else:
            out.append(url)
    return out


def test_expansion_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"http://e/{i}" for i in range(8)] + [f"http://e/{i}.xml" for i in range(8)] + ["http://e/about-SiteMap"]
    docs = {u: [rng.choice(pool if rng.random() < 0.4 else pool[:8]) for _ in range(rng.randint(0, 5))] for u in pool[8:]}
    docs["http://e/sitemap.xml"] = ["http://e/0.xml", "http://e/1", "http://e/1", "http://e/5.xml", "http://e/sitemap.xml"]
    df = spark.createDataFrame([(u, urlset(*v)) for u, v in docs.items()], "url string, body string")
    roots = ["http://e/sitemap.xml", "http://e/3.xml", "http://e/none.xml"]
    chosen = spark.createDataFrame([(f"r{i}", u) for i, u in enumerate(roots)], "root_url string, url string")
    got = sitemaps.expand_sitemaps(chosen, sitemaps.sitemap_locs(df), width=2).collect()
    for i, u in enumerate(roots):
        mine = [r.url for r in sorted((r for r in got if r.root_url == f"r{i}"), key=lambda r: (r.ord, r.pos))]
        assert mine == brute_expand(u, docs)


def test_candidates_and_sources(spark):
    roots = spark.createDataFrame([("https://e.com/x/",), ("https://f.com",)], "root_url string")
    pol = spark.createDataFrame([("https://e.com", ["https://cdn/s.xml"])], "site string, sitemaps array<string>")
    cand = sitemaps.sitemap_candidates(roots, pol)
    mine = [r.url for r in cand.where("root_url like '%e.com%'").orderBy("priority").collect()]
    assert mine == ["https://cdn/s.xml"] + ["https://e.com" + p for p in sitemaps.SITEMAP_PATHS]
    assert sitemaps.sitemap_candidates(roots).count() == 14
    docs = with_sitemap_test(spark.createDataFrame(
        [("https://e.com/sitemap.xml", "plain"), ("https://e.com/wp-sitemap.xml", urlset("https://e.com/1"))], "url string, body string"))
    chosen = sitemaps.chosen_sitemaps(cand, docs)
    assert [tuple(r) for r in chosen.collect()] == [("https://e.com/x/", "https://e.com/wp-sitemap.xml")]
    expanded = sitemaps.expand_sitemaps(chosen, sitemaps.sitemap_locs(docs))
    walked = spark.createDataFrame([("https://f.com", "https://f.com", 1, True)], "root_url string, url string, ord long, ok boolean")
    full = sorted((r.root_url, r.url, r.source) for r in sitemaps.url_sources(roots, expanded, walked).collect())
    assert full == [("https://e.com/x/", "https://e.com/1", "sitemap"), ("https://f.com", "https://f.com", "crawl")]
    only = {r.root_url: r.source for r in sitemaps.url_sources(roots, expanded, walked, sitemap_only=True).collect()}
    assert only["https://f.com"] == "none"
