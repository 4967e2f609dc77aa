"""Spark session and checkpoint location."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pageloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster the job is submitted with its own settings; only the time zone matters to the
    results and every operator is written against a UTC session.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder(prefix: str) -> str:
    """A folder on this machine that goes when the program ends."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for ``DataFrame.checkpoint``: the one the cluster names, shared by all executors.

    Only a local session without a setting gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        named = _own_folder("pageloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark can reach it; a missing one is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once."""
    sc = spark.sparkContext
    if getattr(sc, "_pageloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(_own_folder("pageloom-"), "pageloom")
    sc.addPyFile(shutil.make_archive(target, "zip", root.parent, root.name))
    sc._pageloom_shipped = True


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but computes the rows once, keeps them columnar and
    gives the planner their real size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pageloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._pageloom_folder = path
    return stored


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """Write an intermediate result clustered by ``key``, so that joins on the key move the other side only.

    There are as many buckets as the session has shuffle partitions; the table is external, in the checkpoint folder. ``discard``
    removes it. Rows that are ``dealt`` have each key's in one partition already and are not moved.
    """
    spark = df.sparkSession
    name = f"pageloom_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    stored._pageloom_folder, stored._pageloom_table = path, name
    return stored


@contextlib.contextmanager
def shuffles_forgotten(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here has its shuffle files deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` or ``bucketed`` wrote for this frame; it can't be read any more."""
    if getattr(df, "_pageloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._pageloom_table}")
    remove(df.sparkSession, df._pageloom_folder)
