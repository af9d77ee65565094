import random
import re
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from sitecorpus.operators import pacing, robots

SAMPLE = "User-agent: *\nAllow: /\nDisallow: /attic\nDisallow: /cellar/\n"
LINES = [
    "User-agent: *", "User-agent: TestBot", "user-agent: other", "USER-AGENT : testbot/2", "Disallow: /a", "Allow: /a/b",
    "Disallow: /", "Disallow:", "Disallow: *", "Allow: /%61b?", "Disallow: /b;", "Crawl-delay: 3", "Crawl-delay: 1.5",
    "Crawl-delay: 0", "", "", "  ", "# c", "Disallow: /c # x", "junk", "Sitemap: https://s.example/x%20.xml", "Request-rate: 1/5",
]
PATHS = ["", "/", "/a", "/a/b/c", "/%61/x", "/ab?", "/ab?q=1", "/b;p", "/c", "/x", "/b", "/*", "/ü", "//a"]


def bodies():
    rng = random.Random(3)
    return [SAMPLE] + ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 12))) for _ in range(250)]


def test_rules_equal_stdlib(spark):
    rows, urls, want, delay, maps = [], [], {}, {}, {}
    for i, body in enumerate(bodies()):
        site = f"http://s{i}.example"
        rows.append((site, 200, body))
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        delay[site] = parser.crawl_delay("TestBot/1.0") or None
        maps[site] = parser.sitemaps
        for path in PATHS:
            urls.append((site + path,))
            want[site + path] = parser.can_fetch("TestBot/1.0", site + path) or path in ("", "/")
    docs = spark.createDataFrame(rows, "site string, status int, body string")
    policies = robots.site_policies(docs, "TestBot/1.0").cache()
    got = robots.with_decision(spark.createDataFrame(urls, "url string"), policies).select("url", "allowed").collect()
    wrong = [(r.url, r.allowed, rows[int(r.url.split("/")[2][1:-8])][2])
             for r in got if r.allowed != want[r.url]]
    assert wrong[:3] == []
    assert {r.site: r.crawl_delay for r in policies.collect()} == delay
    assert {r.site: list(r.sitemaps) for r in policies.collect()} == maps


def test_first_matching_rule_wins(spark):
    docs = spark.createDataFrame([("https://shop.example", 200, SAMPLE)], "site string, status int, body string")
    rules = robots.robots_rules(docs).orderBy("pos").collect()
    assert [(r.allow, r.path, r.agents) for r in rules] == [(True, "/", ["*"]), (False, "/attic", ["*"]), (False, "/cellar/", ["*"])]
    url = spark.createDataFrame([("https://shop.example/cellar/x",)], "url string")
    assert robots.with_decision(url, robots.site_policies(docs, "B/1")).first().allowed


def test_fetch_status(spark):
    docs = spark.createDataFrame(
        [("http://h", 403, ""), ("http://n", 404, ""), ("http://l", 401, ""), ("http://e", 500, ""), ("http://x", None, None)],
        "site string, status int, body string",
    )
    pol = robots.site_policies(docs, "B/1")
    assert {r.site: r.crawl_delay for r in pol.collect()} == {
        "http://h": 10.0, "http://n": None, "http://l": None, "http://e": None, "http://x": None}
    assert [r.sitemap for r in robots.listed_sitemaps(docs).orderBy("pos").collect()] == [
        "http://h/sitemap.xml", "http://h/wp-sitemap.xml", "http://h/sitemap_index.xml"]
    urls = spark.createDataFrame([(s + p,) for s in ("http://h", "http://n", "http://l", "http://e", "http://x", "http://u")
                                  for p in ("/", "/p", "/a/sitemap.xml")], "url string")
    got = {r.url: r.allowed for r in robots.with_decision(urls, pol).collect()}
    assert all(got.values())
    strict = {r.url: r.allowed for r in robots.with_decision(urls, pol, policy_403="conservative").collect()}
    assert strict["http://h/"] and not strict["http://h/p"] and not strict["http://h/a/sitemap.xml"]
    assert all(r.allowed for r in robots.with_decision(urls, pol, respect=False).collect())


def test_long_files_equal_short_ones(spark, monkeypatch):
    """Rules met by prefixes decide as rules tried one by one, and as the library does."""
    rng = random.Random(9)
    parts = ["/", "/a", "/b/", "a", "b/", "/c?x=1", "%61", "é"]
    site_rules, bodies = {}, []

    def path(n):
        return re.sub("/+", "/", "/" + "".join(rng.choice(parts) for _ in range(n)))

    for site, n in (("http://long", 300), ("http://longer", 900), ("http://short", 5)):
        rules = ["Disallow:" if rng.random() < 0.01 else f"{rng.choice(['Allow', 'Disallow'])}: {path(rng.randint(1, 5))}" for _ in range(n)]
        site_rules[site] = rules
        bodies.append((site, 200, "User-agent: *\n" + "\n".join(rules)))
    urls = [site + path(rng.randint(0, 6)) for site in site_rules for _ in range(150)] + ["http://other/x", "http://long"]
    frame = spark.createDataFrame([(u,) for u in urls + urls[:40]], "url string")
    policies = robots.site_policies(spark.createDataFrame(bodies, "site string, status int, body string"), "Bot/1")
    got = {}
    for few in (0, 64, 10**6):
        monkeypatch.setattr(robots, "FEW_RULES", few)
        rows = robots.with_decision(frame, policies).collect()
        assert len(rows) == len(urls) + 40
        got[few] = {r.url: (r.allowed, r.why) for r in rows}
    assert got[0] == got[64] == got[10**6]
    for site, rules in site_rules.items():
        parser = RobotFileParser()
        parser.parse(("User-agent: *\n" + "\n".join(rules)).splitlines())
        for u in urls:
            if u.startswith(site + "/") and u != site + "/":
                assert got[64][u][0] == parser.can_fetch("Bot/1", u), u


def test_long_files_are_met_by_an_equi_join(spark):
    long = spark.createDataFrame([("http://l", [(i, False, f"/{i}") for i in range(100)])], "site string, rules array<struct<pos: int, allow: boolean, path: string>>")
    urls_ = spark.createDataFrame([("http://l", "/17/x"), ("http://l", "/x")], "site string, text string")
    found = robots.first_long_rules(urls_, long)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [(r.text, r.allow) for r in found.collect()] == [("/17/x", False)]


def brute_schedule(rows, crawl_delay, delay, max_delay):
    start, clock = {}, {}
    for seq, url, status in sorted(rows):
        host, site = url.split("/")[2], "/".join(url.split("/")[:3])
        cd = crawl_delay.get(site) or 0.0
        if host not in clock:
            now = cd
        else:
            now = clock[host] + max(delay, cd)
        start[seq] = now
        clock[host] = now + (min(2 * delay, max_delay) if status and 500 <= status < 600 else 0)
    return start


def test_schedule_equals_brute_force(spark):
    rng = random.Random(5)
    hosts = ["big.example"] * 6 + ["a.example", "b.example"]
    rows = [(i * 3, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{i}", rng.choice([200, 503])) for i in range(400)]
    delays = {"http://big.example": 4.0, "https://a.example": 2.0}
    pol = spark.createDataFrame(list(delays.items()), "site string, crawl_delay double")
    req = spark.createDataFrame(rows, "seq long, url string, status int")
    got = pacing.fetch_schedule(req, pol, 1.0, max_delay=3.0, width=8).collect()
    assert {r.seq: r.start for r in got} == brute_schedule(rows, delays, 1.0, 3.0)
    off = pacing.fetch_schedule(req, pol, 1.0, respect=False)
    done = {r.netloc: (r.requests, r.finish) for r in pacing.finish_times(off).collect()}
    n = sum("big" in u for _, u, _ in rows)
    assert done["big.example"] == (n, n - 1.0)
    assert F is not None
