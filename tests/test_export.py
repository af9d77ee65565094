import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from sitecorpus.operators import export

PAGES = "root_url string, seq long, url string, path string, title string, content string"


def test_site_export_is_one_document_per_root(spark, tmp_path):
    rows = [("https://a.com", 5, "https://a.com/x", "a.com/x.json", 'T "q"', "<main>ü</main>"), ("https://a.com", 2, "https://a.com/", "a.com/index.json", None, "x\ny")]
    rows += [("https://b.com", i, f"https://b.com/{i}", f"b.com/{i}.json", "t", "c") for i in range(40)]
    df = export.site_export(spark.createDataFrame(rows, PAGES), "2024-01-01T00:00:00")
    docs = {}
    for root in ("https://a.com", "https://b.com"):
        lines = [r.line for r in df.where(F.col("root_url") == root).orderBy("seq").collect()]
        docs[root] = json.loads("\n".join(lines))
    a = docs["https://a.com"]
    assert list(a) == ["root_url", "generated_at", "total_pages", "pages"]
    assert (a["root_url"], a["generated_at"], a["total_pages"]) == ("https://a.com", "2024-01-01T00:00:00", 2)
    assert [p["url"] for p in a["pages"]] == ["https://a.com/", "https://a.com/x"]
    assert a["pages"][1]["title"] == 'T "q"' and a["pages"][1]["content"] == "<main>ü</main>" and a["pages"][1]["file"] == "a.com/x.json"
    assert len(docs["https://b.com"]["pages"]) == docs["https://b.com"]["total_pages"] == 40
    target = str(tmp_path / "site")
    export.write_site_export(df, target)
    back = export.committed(spark, target)
    roots = {r.root_url for r in back.select("root_url").collect()}
    read = [json.loads("\n".join(r.line for r in back.where(F.col("root_url") == u).orderBy("seq").collect())) for u in roots]
    assert sorted(d["total_pages"] for d in read) == [2, 40]
    assert {d["root_url"]: d for d in read} == docs


def test_time_of_export_is_escaped(spark):
    df = export.site_export(spark.createDataFrame([("https://a.com", 1, "u", "p", "t", "c")], PAGES), 'a "b" \\ c\'d')
    assert json.loads("".join(r.line for r in df.orderBy("seq").collect()))["generated_at"] == 'a "b" \\ c\'d'


def test_documents_are_written_by_bucket(spark, tmp_path):
    rows = [(f"s{i}.com", f"s{i}.com/a.md", f"text {i}") for i in range(60)] + [("b.com", "b.com/x.md", "y")]
    df = spark.createDataFrame(rows, "domain string, path string, document string")
    target = str(tmp_path / "docs")
    export.write_documents(df, target, buckets=4)
    export.write_documents(df.where("domain = 'b.com'").withColumn("path", F.lit("b.com/x.json")), target, "json", buckets=4)
    assert len(glob.glob(os.path.join(target, "run=first", "extension=md", "bucket=*"))) == 4
    back = spark.read.parquet(target)
    assert back.count() == 62
    one = back.where(export.in_domain("b.com", 4))
    assert sorted(r.path for r in one.collect()) == ["b.com/x.json", "b.com/x.md"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(domain,b.com)" in plan


def test_half_written_output_is_found(spark, tmp_path):
    target = str(tmp_path / "docs")
    rows = [(f"s{i}.com", f"s{i}.com/a.md", f"text {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "domain string, path string, document string")
    export.write_documents(df, target, buckets=4, run="a")
    export.write_documents(df.limit(5), target, buckets=4, run="b")
    # A run that broke off: its files are there, its manifest is not.
    placed = df.withColumns({"run": F.lit("c"), "extension": F.lit("md"), "bucket": export.bucket_of(F.col("domain"), 4)})
    placed.write.mode("append").partitionBy("run", "extension", "bucket").parquet(target)
    got = export.committed(spark, target)
    assert {r["run"]: r["count"] for r in got.groupBy("run").count().collect()} == {"a": 30, "b": 5}
    assert sorted(r.document for r in got.where("run = 'a'").collect()) == sorted(d for _, _, d in rows)
    # The same number of rows, but other ones.
    placed.where("path = 's1.com/a.md'").withColumns({"run": F.lit("b"), "document": F.lit("other")}).write.mode("append").partitionBy("run", "extension", "bucket").parquet(target)
    with pytest.raises(ValueError, match="differ from the manifest"):
        export.committed(spark, target)
    assert export.committed(spark, target, verify=False).count() == 36
    missing = glob.glob(os.path.join(target, "run=a", "extension=md", "bucket=0", "*.parquet"))
    other = str(tmp_path / "other")
    export.write_documents(df, other, buckets=4)
    os.remove(glob.glob(os.path.join(other, "run=first", "extension=md", "bucket=*", "*.parquet"))[0])
    assert missing
    with pytest.raises(ValueError, match="differ from the manifest"):
        export.committed(spark, other)
