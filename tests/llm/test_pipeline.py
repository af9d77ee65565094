"""The pipeline's stages, each against what its operator decides."""

import pyspark.sql.functions as F

import corpus_pipeline
from sitecorpus.llm import secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.count()
        if name != "encoding":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert 0 < kept["quality"] <= 200 and kept["secrets"] == kept["decontamination"] <= kept["near_duplicates"] <= kept["quality"]
    clean = spark.read.parquet(f"{tmp_path}/secrets")
    assert clean.where(F.size(secrets.base_spans(F.col("text"))) > 0).count() == 0
    assert docs.where("not exact").count() == 0


def test_stages_take_clashing_columns_and_nulls(spark):
    rows = [(1, None, "a", 1), (None, "word " * 60, "b", 2), (2, "", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string, kept_id long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 3, name
