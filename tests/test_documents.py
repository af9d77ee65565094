import random
import re

import yaml
from pyspark.sql import functions as F

from sitecorpus.operators import documents as D


#: URLs and the paths that they get.
PATHS = {
    "https://tea.example/": "tea.example/index.md",
    "https://tea.example": "tea.example/index.md",
    "https://tea.example/green": "tea.example/green.md",
    "https://www.tea.example/a/b/green": "tea.example/a/b/green.md",
    "https://tea.example:81/p?id=123&x=aaaaaaaaaaaaaaaaaaaaaaaaa": "tea.example:81/p_id=123&x=aaaaaaaaaaa.md",
    "https://tea.example/a.md": "tea.example/a.md",
    "https://tea.example/x.html": "tea.example/x.html.md",
    "https://tea.example/für": "tea.example/für.md",
    "https://tea.example/" + "a" * 300: "tea.example/" + "a" * 200 + ".md",
    "https://tea.example/日本/語": "tea.example/日本/語.md",
}


def test_paths(spark):
    df = spark.createDataFrame([(n,) for n in PATHS], "url string")
    assert {r.url: r.path for r in D.with_path(df).collect()} == PATHS
    json_paths = {r.url: r.path for r in D.with_path(df, extension="json").collect()}
    assert json_paths["https://tea.example/green"] == "tea.example/green.json" and json_paths["https://tea.example/x.html"] == "tea.example/x.html.json"
    single = D.with_path(df.where("url like '%/a/b/green'"), single_site=True).first()
    assert single.path == "a/b/green.md"


def made_docs(rng, n, first=0):
    stems = ["a", "a_1", "a_1_1", "a_2", "b", "b_3", "c_01", "a_10"]
    out = []
    for i in range(n):
        host = rng.choice(["http://e.com", "https://e.com", "http://www.e.com"])
        tail = rng.choice(["", "/", "#x", f"#{rng.randint(0, 9)}"])
        out.append((first + i, f"{host}/{rng.choice(stems)}{tail}", f"text {first + i}"))
    return out


def check_files(rows, docs):
    """What holds of any assignment: a path each, the content of the last arrival, and numbers without gaps."""
    assert len(rows) == len({r.path for r in rows})
    contents = {c: u for _, u, c in docs}
    assert all(contents[r.content] == r.url for r in rows if r.content in contents)
    paths = {r.path for r in rows}
    for path in paths:
        if found := re.fullmatch(r"(.*)_([1-9][0-9]*)(\.\w+)", path):
            stem, number, ending = found.groups()
            before = stem + ending if number == "1" else f"{stem}_{int(number) - 1}{ending}"
            named = any(u.split("#")[0].rstrip("/").endswith(path.rsplit("/", 1)[1].removesuffix(ending)) for _, u, _ in docs)
            assert before in paths or named, path


def test_collisions(spark):
    for seed in range(3):
        docs = made_docs(random.Random(seed), 45)
        df = spark.createDataFrame(docs, "seq long, url string, content string")
        rows = D.assigned_paths(df, width=4).collect()
        check_files(rows, docs)
        first = D.with_path(df.orderBy("seq").limit(1)).first()
        assert any(r.path == first.path and r.url.split("#")[0].rstrip("/") for r in rows)
        every = D.assigned_paths(df, "json", width=4).collect()
        assert sorted(r.content for r in every) == sorted(c for _, _, c in docs)
        check_files(every, docs)


def test_twins_are_numbered_in_order(spark):
    docs = [(i, f"{s}://e.com/{p}", f"{i}") for i, (s, p) in enumerate([("http", "a"), ("https", "a"), ("http", "a_1"), ("https", "a_1"), ("http", "a")])]
    got = {r.path: r.content for r in D.assigned_paths(spark.createDataFrame(docs, "seq long, url string, content string"), width=4).collect()}
    assert got == {"e.com/a.md": "4", "e.com/a_1.md": "1", "e.com/a_1_1.md": "2", "e.com/a_1_2.md": "3"}


def test_many_taken_numbers_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(D, "cut", lambda df, name, real=D.cut: (written.append(name), real(df, name))[1])
    docs = [(i, f"http://e.com/p_{i}", f"{i}") for i in range(1, 2001)] + [(5000, "http://e.com/p", "a"), (5001, "https://e.com/p", "b")]
    got = {r.content: r.path for r in D.assigned_paths(spark.createDataFrame(docs, "seq long, url string, content string")).collect()}
    assert got["a"] == "e.com/p.md" and got["b"] == "e.com/p_2001.md" and len(set(got.values())) == len(docs)
    assert written.count("moving") <= 3


def test_merging_twice_changes_nothing(spark):
    rng = random.Random(100)
    one, two = made_docs(rng, 25), made_docs(rng, 30, 1000)
    schema = "seq long, url string, content string"
    stored = D.assigned_paths(spark.createDataFrame(one, schema), width=4).select("path", "url", "content")
    new = spark.createDataFrame(two, schema)
    once = D.merged_documents(stored, new, width=4).collect()
    assert len(once) == len({r.path for r in once})
    assert {r.path for r in stored.collect()} <= {r.path for r in once}
    again = D.merged_documents(spark.createDataFrame([(r.path, r.url, r.content) for r in once], "path string, url string, content string"), new, width=4).collect()
    assert {r.path: (r.url, r.content) for r in again} == {r.path: (r.url, r.content) for r in once}


def test_new_documents_fill_gaps(spark):
    schema = "path string, url string, content string"
    stored = spark.createDataFrame([("e.com/a_b_1.md", "http://e.com/a:b", "0"), ("e.com/a_b_3.md", "http://e.com/a*b", "1"), ("e.com/c.md", "http://e.com/c", "2")], schema)
    new = [(7, "http://e.com/a|b", "x"), (5, "http://e.com/a_b", "y"), (6, "https://e.com/c", "z"), (8, "http://e.com/d", "d")]
    merged = D.merged_documents(stored, spark.createDataFrame(new, "seq long, url string, content string"), width=4).collect()
    got = {r.content: r.path for r in merged}
    assert got == {"0": "e.com/a_b_1.md", "1": "e.com/a_b_3.md", "2": "e.com/c.md", "y": "e.com/a_b.md", "x": "e.com/a_b_2.md", "z": "e.com/c_1.md", "d": "e.com/d.md"}


def test_free_numbers(spark):
    rng = random.Random(5)
    held = {(w, rng.randint(0, 30)) for w in "pq" for _ in range(14)} | {("r", 2**40)}
    fresh = [(w, f"k{i}", i) for i, w in enumerate(rng.choices("pqrs", k=60))]
    frame = D._free_numbers(spark.createDataFrame(fresh, "want string, key string, arrival long"), spark.createDataFrame(sorted(held), "want string, number long"), 4)
    got = {r.key: r.number for r in frame.collect()}
    for w, key, _ in fresh:
        number = next(n for n in range(200) if (w, n) not in held)
        held.add((w, number))
        assert got[key] == number


def test_front_matter(spark):
    rows = [
        ("---\nkind: tea\n---\nGreen\n", {"kind": "tea"}, "Green\n"),
        ("Green tea\n---\nno header", None, "Green tea\n---\nno header"),
        ("---\na: b: c: d\n---\nx", None, "---\na: b: c: d\n---\nx"),
        ('---\ntitle: "A: \\"b\\""\nurl: http://x/y:1\n---\ntext\n---\nmore', {"title": 'A: "b"', "url": "http://x/y:1"}, "text\n---\nmore"),
        ("---\nnot closed", None, "---\nnot closed"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, content string")
    _, body = D.split_front_matter_sql("content")
    for r in df.select("i", D.front_matter("content").alias("f"), F.expr(body).alias("b")).collect():
        assert (r.f, r.b) == rows[r.i][1:], r.i


def test_written_header(spark):
    rows = [
        ("https://e.com/my-first_page/", "text\nmore", None, None), ("https://e.com/", "a\n# Extracted Title \nb", None, "Ann"),
        ("https://e.com", "x", None, ""), ("https://e.com/p", "---\nold: 1\n---\n\n\nbody", 'Say "hi": \\ now', "Ann\nB"),
    ]
    df = spark.createDataFrame(rows, "url string, content string, title string, author string")
    got = {r.url: r.document for r in D.with_front_matter(df, "2024-01-01T00:00:00", stored=True).collect()}
    heads = {}
    for url, doc in got.items():
        _, head, body = doc.split("---\n", 2)
        heads[url] = (yaml.safe_load(head), body)
    at = {"date_extracted": "2024-01-01T00:00:00"}
    assert heads["https://e.com/my-first_page/"] == ({"title": "My First Page", "source_url": "https://e.com/my-first_page/", **at}, "\ntext\nmore")
    assert heads["https://e.com/"][0] == {"title": "Extracted Title", "author": "Ann", "source_url": "https://e.com/", **at}
    assert heads["https://e.com"][0]["title"] == "Home page"
    assert heads["https://e.com/p"] == ({"title": 'Say "hi": \\ now', "author": "Ann B", "source_url": "https://e.com/p", **at}, "\nbody")
    plain = D.with_front_matter(df).where("url = 'https://e.com'").first().document
    assert "date_extracted" not in plain
    fresh = D.with_front_matter(df).where("url = 'https://e.com/p'").first().document
    assert fresh.endswith("---\n\n---\nold: 1\n---\n\n\nbody")
