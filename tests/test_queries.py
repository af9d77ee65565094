"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitecorpus.plans.oracles import ORACLES
from sitecorpus.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["url_keys", "page_links", "internal_edges", "robots_decisions", "element_spans", "removed_exact", "document_paths", "path_collisions", "front_matter", "page_documents"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = [tuple(row[columns.index(n)] for n in names) for row in result.fetchall()]
    assert sorted(columns) == names
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "path", "document"]
    assert df.where("document like '---%'").count() == 50
