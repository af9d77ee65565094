"""Cutting lineage between the rounds of an iterated job.

Each round is written as a parquet table in the shared checkpoint folder and
read back.  The files survive the loss of executors, they are columnar, and
their size on disk gives the planner a true bound for its broadcast decision.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark removes the shuffle files of a query as it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without it; there a temporary folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sitecorpus-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table.

    All tables of one application lie in one folder named after it, which can
    go once the results are stored.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/sitecorpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """As ``cut``, in buckets by ``keys``, as many as the session has shuffle partitions.

    Joins and groupings by these keys read the table where it lies: only the other side is shuffled.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"sitecorpus_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/sitecorpus-{spark.sparkContext.applicationId}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Queries that run in it leave no shuffle files; meant for tables that are written and read back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_passing(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, without the shuffle files that led to the table."""
    with passing(df.sparkSession):
        return cut(df, name)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once nothing reads them any more."""
    for table in tables:
        folder = table.inputFiles()[0].rsplit("/", 1)[0]
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
