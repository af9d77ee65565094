"""Properties of plans and helpers that matter for large inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sitecorpus import checkpoints
from sitecorpus.operators import links, render, robots
from sitecorpus.operators.running import numbered, running_sum
from sitecorpus.sources import fixtures, snapshots

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sum_in_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), i, rng.randint(0, 9)) for i in rng.sample(range(10**12), 300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    want, total = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    for width in (7, 10**9, 2**40):
        got = {r.i: r.s for r in running_sum(df, ["k"], "i", F.col("v"), "s", width).collect()}
        assert got == want
    place = {r.i: r.n for r in numbered(df, ["k"], "i", "n", 5).collect()}
    hot = sorted(i for k, i, _ in rows if k == "hot")
    assert [place[i] for i in hot] == list(range(1, len(hot) + 1))


def test_running_sum_over_all_longs(spark):
    rng = random.Random(2)
    values = sorted({rng.randint(-(2**63), 2**63 - 1) for _ in range(400)} | {0, -1, -(2**63), 2**63 - 1, 2**53, 2**53 + 1})
    got = {r.i: r.n for r in numbered(spark.createDataFrame([("k", i) for i in values], "k string, i long"), ["k"], "i", "n").collect()}
    assert got == {v: n for n, v in enumerate(values, 1)}


def test_no_window_holds_a_whole_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "k string, i long")
    text = plan(numbered(df, ["k"], "i", "n", 8))
    assert "__chunk2" in text and "__chunk1" in text
    for line in text.splitlines():
        if "Window [" in line and "row_number" not in line:
            assert "__chunk" in line


def test_rendering_shuffles_pages_once(spark):
    text = plan(render.rendered_pages(snapshots.read_pages(spark, SF)))
    # Written twice in the plan, the same exchange both times; no shuffle of tokens or blocks.
    assert text.count("Exchange hashpartitioning") == 2 and text.count("REPARTITION_BY_NUM") == 2
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_plans_without_pair_joins(spark):
    pages = snapshots.read_pages(spark, SF)
    policies = robots.site_policies(fixtures.robots_docs(pages), fixtures.AGENT)
    for df in (
        links.page_links(pages),
        links.url_profile(pages),
        snapshots.fetched_pages(pages),
        robots.with_decision(pages.select("page_id", "url"), policies),
        fixtures.sitemap_docs(pages),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def test_latest_pages_reads_no_html(spark):
    text = plan(snapshots.latest_pages(snapshots.read_pages(spark, SF)))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_latest_snapshot_per_key(spark):
    rows = [(i, "http://hot.example/p#" + str(i), "x" if i else "") for i in range(200)] + [(900, "http://e.example/", ""), (901, "http://n.example/", None)]
    got = {r.url_key: (r.page_id, r.ok) for r in snapshots.fetched_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"http://hot.example/p": (199, True), "http://e.example/": (900, False), "http://n.example/": (901, False)}


def test_cut_reads_back_the_same_rows(spark):
    df = spark.range(10).withColumn("s", F.array(F.lit("a")))
    again = checkpoints.cut(df, "test")
    assert sorted(again.collect()) == sorted(df.collect())
    assert checkpoints.checkpoint_root(spark) in plan(again)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        checkpoints.checkpoint_root(Session())
