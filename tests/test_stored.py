"""Runs merged into a stored table, bucket by bucket."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sitecorpus.operators import documents, stored

SCHEMA = "seq long, url string, content string"


def files(target):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(os.path.join(target, "data", "**", "*.parquet"), recursive=True)}


def rows_of(spark, target):
    return sorted((r.path, r.url, r.content) for r in stored.current(spark, target).collect())


@pytest.fixture(scope="module")
def first(spark):
    rng = random.Random(4)
    names = [f"p{i}" for i in range(600)] + [f"p{i}_1" for i in range(0, 40)] + [f"p{i}_1_2" for i in range(0, 10)]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.'])}e.com/{n}", f"text {i}") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_a_small_run_rewrites_its_buckets_only(spark, first, tmp_path):
    target = str(tmp_path / "t")
    stored.create(first, target, buckets=64)
    before, all_rows = files(target), rows_of(spark, target)
    assert len(all_rows) == 650
    # One page in a hundred: known ones, one under another scheme, and a new one.
    new = spark.createDataFrame([(1, "http://e.com/p7/", "new 7"), (2, "https://e.com/p8", "new 8"), (3, "http://e.com/p8", "other 8"), (4, "http://e.com/p0", "a"), (5, "https://e.com/p0", "b"), (6, "http://e.com/fresh", "c")], SCHEMA)
    whole = documents.merged_documents(first.sparkSession.createDataFrame(all_rows, "path string, url string, content string"), new)
    expected = sorted((r.path, r.url, r.content) for r in whole.collect())
    states = {r.path: r.state for r in stored.upsert(new, target).collect()}
    assert rows_of(spark, target) == expected
    after = files(target)
    assert {p: t for p, t in after.items() if p in before} == before
    wanted = documents.with_path(new, "url", "md", out="want").select(stored.bucket_of(F.col("want"), 64).alias("b")).distinct()
    touched = {r.b for r in wanted.collect()}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in set(after) - set(before)} == touched
    assert len(touched) <= 4 and "new" in states.values() and "replaced" in states.values()


def test_runs_one_after_another_equal_whole_merges(spark, first, tmp_path):
    rng = random.Random(6)
    target = str(tmp_path / "t")
    stored.create(first.where("seq % 2 = 0"), target, buckets=8)
    kept = rows_of(spark, target)
    for step in range(2):
        picked = [(1000 * step + i, r.url.replace("http:", "https:") if rng.random() < 0.5 else r.url + "/", f"step {step} {i}") for i, r in enumerate(rng.sample(first.collect(), 60))]
        new = spark.createDataFrame(picked, SCHEMA)
        whole = documents.merged_documents(spark.createDataFrame(kept, "path string, url string, content string"), new)
        kept = sorted((r.path, r.url, r.content) for r in whole.collect())
        stored.upsert(new, target)
        assert rows_of(spark, target) == kept
    assert len({p for p, _, _ in kept}) == len(kept)


def test_a_broken_run_is_not_seen(spark, first, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    stored.create(first, target, buckets=8)
    before = rows_of(spark, target)
    new = spark.createDataFrame([(1, "http://e.com/p7", "new")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(stored, "MANIFEST", "_manifest/nowhere")
        with pytest.raises(Exception):
            stored.upsert(new, target)
    leftover = new.select(F.lit("e.com/p7.md").alias("path"), "url", "content").withColumns({"run": F.lit("broken"), "bucket": F.lit(0)})
    leftover.write.mode("append").partitionBy("run", "bucket").parquet(f"{target}/data")
    assert rows_of(spark, target) == before
    stored.upsert(new, target)
    assert [u for _, u, c in rows_of(spark, target) if c == "new"] == ["http://e.com/p7"]


def test_empty_runs(spark, first, tmp_path):
    target = str(tmp_path / "t")
    stored.create(first.limit(0), target)
    assert rows_of(spark, target) == []
    assert stored.upsert(first.limit(0), target).collect() == []
    stored.upsert(first.where("seq < 3"), target)
    assert len(rows_of(spark, target)) == 3
