import random
from urllib.parse import unquote, urldefrag, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from sitecorpus.functions import urls as U


def expected_key(base, href):
    full = urldefrag(urljoin(base, href))[0]
    p = urlparse(full)
    if p.path.endswith(tuple(U.CONTENT_ENDINGS)) or not p.path or p.path.endswith("/"):
        return full
    return f"{p.scheme}://{p.netloc}{p.path}"


BASES = [
    "https://example.com", "https://example.com/", "https://example.com/path/",
    "http://example.com/a/b/c.html?x=1#f", "http://www.example.com:8080/a//b/",
    "HTTP://Example.com/a;p=1?q", "https://example.com/a/b;x/c;y?z=1",
]
PIECES = [
    "", "/", "//", "a", "b.html", "..", ".", "/..", "/.", "?q=1", "?", "#f", "#", ";p", ":", "http:",
    "https:", "https://example.com", "//other.com", "HTTPS://E.com/x", "mailto:a@b", " ", "\t", "ü", "%20", "x y",
]


def hrefs():
    rng = random.Random(7)
    made = {"".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5))) for _ in range(1500)}
    return sorted(made | {"/page", "page", "/page#section", "/page.html?id=123", "../../x", "./", "../", "a/../b/./"})


def usable(base, href):
    try:
        expected_key(base, href)
        return True
    except ValueError:
        return False


def test_crawl_key_equals_stdlib(spark):
    rows = [(b, h) for b in BASES for h in hrefs() if usable(b, h)]
    df = spark.createDataFrame(rows, "base string, href string")
    out = U.with_target(U.with_url_parts(df, "base", "b_"), "href", "b_").select("base", "href", "target").collect()
    wrong = [(r.base, r.href, r.target, expected_key(r.base, r.href)) for r in out
             if r.target != expected_key(r.base, r.href)]
    assert wrong[:25] == []


def test_parts_equal_stdlib(spark):
    rows = [(h,) for h in hrefs() if usable("", h)] + [(b,) for b in BASES]
    out = U.with_url_parts(spark.createDataFrame(rows, "u string"), "u", "p_").collect()
    for r in out:
        p = urlparse(r.u)
        if p.scheme in ("", "http", "https"):
            assert (r.p_scheme, r.p_netloc, r.p_path, r.p_params, r.p_query, r.p_fragment) == tuple(p), r.u


@pytest.mark.parametrize("url,ok", [
    ("http://shop.example/tea", True), ("https://shop.example/tea/green", True), ("gopher://shop.example/tea", False),
    ("tel:+4912345", False), ("https://shop.example/leaf.png", False),
    ("https://shop.example/prices.pdf", False), ("https://shop.example/LEAF.PNG", True),
    ("https://shop.example/all.tar.gz?v=2", False), ("https://shop.example/zip", True),
])
def test_crawlable(spark, url, ok):
    df = U.with_url_parts(spark.createDataFrame([(url,)], "u string"), "u", "p_")
    assert df.select(U.is_crawlable(F.col("p_scheme"), F.col("p_path"))).first()[0] is ok


def test_internal_is_exact(spark):
    rows = [("", True), ("example.com", True), ("sub.example.com", False), ("example.com:80", False), ("EXAMPLE.com", False)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    out = df.select("want", U.is_internal(F.col("n"), F.lit("example.com")).alias("got")).collect()
    assert all(r.got == r.want for r in out)


def test_document_key_and_output_root(spark):
    rows = [("https://www.example.com/page//", "https://example.com/page"), ("http://a.b", "http://a.b")]
    out = spark.createDataFrame(rows, "u string, k string").select("k", U.document_key(F.col("u")).alias("g")).collect()
    assert all(r.g == r.k for r in out)
    hosts = [("www.Example.com:8080", "example.com"), ("", "output"), ("u:p@Host", "host"), ("[::1]:80", "::1")]
    out = spark.createDataFrame(hosts, "n string, w string").select("w", U.output_root(F.col("n")).alias("g")).collect()
    assert all(r.g == r.w for r in out)


def test_percent_decoding_equals_stdlib(spark):
    texts = ["", "a%20b", "%C3%BC", "a+b", "100%", "%zz%41", "%", "%4", "x%2Fy%3f"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.percent_decoded(F.col("t")).alias("g"))
    assert {r.t: r.g for r in out.collect()} == {t: unquote(t) for t in texts}
