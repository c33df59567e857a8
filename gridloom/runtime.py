"""Session helpers shared by every operator: shared scratch space and code shipping."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Scratch folders made since `recorded` began, while it runs.
_MADE: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application.

    Workers import the functions of Python stages by name; with this they can
    do so whatever their working directory or PYTHONPATH is.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="gridloom-src-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that start later fetch it too
    path = os.path.join(folder, "gridloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, dirs, files in os.walk(os.path.join(root, "gridloom")):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path in the shared scratch space that the cluster names.

    ``spark.checkpoint.dir`` of the session wins; only where it is unset (tests
    on one machine) a folder below the warehouse directory serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch folders that are made meanwhile, so that they can be deleted when their results have been written."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts the lineage on shared storage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, column: str) -> DataFrame:
    """``df`` written in buckets of a column, as many as shuffles have partitions, and read back: joins on it don't shuffle it."""
    spark = df.sparkSession
    name = f"gridloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    try:
        return spark.table(name).select("*")
    finally:
        spark.sql(f"drop table {name}")  # only its name: the files are outside the warehouse


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``place``, from 1 in the given order, and its number of rows; no task sorts all rows.

    Rows are dealt into sorted ranges and written; a row's place is that in its
    range after the sizes of the ranges before, which are a row a partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), scratch_dir(spark))
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    before, n = [], 0
    for k in sorted(sizes):
        before.append((k, n))
        n += sizes[k]
    start = spark.createDataFrame(before, "_range int, _before long")
    rows = rows.join(F.broadcast(start), "_range")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.withColumn("place", place).drop("_range", "_before"), n


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stages that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
