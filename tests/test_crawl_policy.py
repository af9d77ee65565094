"""The crawl with roots as users type them, under robots files, and the plan of its rounds."""

import re
from collections import deque

import pytest

from sitecorpus.checkpoints import cut_bucketed
from sitecorpus.operators import crawl, robots

HOST = "http://e.com"
GRAPH = {"/a": ["/b", "/no/1", "/c", "/b"], "/b": ["/d", "/a"], "/c": ["/e"], "/no/1": ["/hidden"], "/d": ["/no/2", "/f"], "/e": ["/f"], "/f": ["/g"], "/hidden": ["/b"]}
FAILED = {"/e"}


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, HOST + u, "".join(f'<a href="{t}#x">x</a>' for t in ts), u not in FAILED) for i, (u, ts) in enumerate(GRAPH.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string, ok boolean")


@pytest.fixture(scope="module")
def policies(spark):
    docs = [(HOST, 200, "User-agent: *\nDisallow: /no/\n"), ("http://denied.com", 200, "User-agent: *\nDisallow: /x\n")]
    return robots.site_policies(spark.createDataFrame(docs, "site string, status int, body string"), "sitecorpus/1.0")


def roots_of(spark, *urls):
    return spark.createDataFrame([(u, re.sub("^http://([^/]*).*", r"\1", u)) for u in urls], "root_url string, root_netloc string")


def walked(root, depth, under_robots):
    """The same walk with a queue; a root is itself, and the page of its key."""
    queue, seen, out = deque([(root, 0)]), set(), []
    while queue:
        url, d = queue.popleft()
        if url in seen or d > depth:
            continue
        seen.add(url)
        path = re.sub(r"[?#].*", "", url.removeprefix(HOST))
        allowed = not (under_robots and path.startswith("/no/"))
        ok = allowed and path in GRAPH and path not in FAILED
        out.append((url, d, allowed, ok))
        if ok:
            queue.extend((HOST + t, d + 1) for t in GRAPH[path])
    return out


@pytest.mark.parametrize("under_robots", [False, True])
def test_roots_as_given(spark, site, policies, under_robots):
    given = ["/a", "/a?utm=1", "/a#top", "/no/1", "/no/1?x=2#y", "/missing"]
    roots = roots_of(spark, *[HOST + g for g in given])
    for depth in (1, 4):
        visited = crawl.crawl(roots, crawl.crawl_edges(site), depth, ordered=True, width=4, policies=policies if under_robots else None)
        rows = crawl.with_outcome(visited, site).collect()
        for g in given:
            mine = sorted((r.ord, r.url, r.depth, r.allowed, r.ok) for r in rows if r.root_url == HOST + g)
            assert [r[1:] for r in mine] == walked(HOST + g, depth, under_robots), g
            assert [r[0] for r in mine] == list(range(1, len(mine) + 1))
    if not under_robots:
        reached = {g: {r.url for r in rows if r.root_url == HOST + g and r.depth} for g in given}
        assert reached["/a?utm=1"] == reached["/a#top"] == reached["/a"] | {HOST + "/a"}


def test_a_disallowed_page_is_visited_and_gives_nothing(spark, site, policies):
    visited = crawl.crawl(roots_of(spark, HOST + "/a"), crawl.crawl_edges(site), 5, policies=policies)
    rows = {r.url: r for r in crawl.with_outcome(visited, site).collect()}
    denied = rows[HOST + "/no/1"]
    assert (denied.allowed, denied.ok, denied.page_id, denied.depth) == (False, False, None, 1)
    assert HOST + "/hidden" not in rows
    hist = {r.depth: (r.visited, r.fetched, r.failed) for r in crawl.depth_histogram(crawl.with_outcome(visited, site)).collect()}
    assert hist[1] == (3, 2, 1)


def test_no_roots(spark, site):
    assert crawl.crawl(roots_of(spark, HOST + "/a").limit(0), crawl.crawl_edges(site), 3).collect() == []


def test_a_round_moves_the_frontier_only(spark, site):
    """Neither the edges nor the visited URLs are exchanged."""
    edges = cut_bucketed(crawl.crawl_edges(site).select("source", "target", "target_netloc", "pos"), "edges", ["source"])
    start = roots_of(spark, HOST + "/a").selectExpr("root_url", "root_netloc", "root_url AS url", "root_url AS url_key", "0 AS depth", "1L AS ord")
    frontier = crawl._round(start, None, "allow")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = crawl.found_links(frontier, edges).join(frontier.select("root_url", "url"), ["root_url", "url"], "left_anti")
        plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scans = [i for i, x in enumerate(lines) if "FileScan" in x]
    exchanged = []
    for i in scans:  # the operators above a scan, up to the join it feeds
        depth, above = lines[i].index("FileScan"), []
        for line in reversed(lines[:i]):
            at = re.search(r"[A-Za-z]", line)
            if at and at.start() < depth:
                depth = at.start()
                above.append(line.strip(" :+-"))
                if "Join" in line:
                    break
        exchanged.append(any("Exchange" in x for x in above))
    # The frontier's side is shuffled to the edges; edges and visited URLs are read where they lie.
    assert exchanged == [True, False, False], plan
    assert sum("Exchange" in x for x in lines) == 2, plan
    assert all("Bucketed: true" in lines[i] for i in scans[1:]), plan
