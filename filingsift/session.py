"""Session defaults and the shared scratch folder.

A cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset (tests, a
laptop) a temporary folder of this process takes its place.
"""
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir = None
_paths = []


def build_session(app="filingsift", master=None, **conf):
    """A session with the settings the jobs are written for; the caller's settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # a hot join key is split at run time instead of landing in one task
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # the points of a sweep share the cores
        "spark.scheduler.mode": "FAIR",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Root of the shared scratch folder; a cluster without one is an error."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "unknown").startswith("local"):  # a remote session may not name its master
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _own_dir is None:
        _own_dir = tempfile.TemporaryDirectory(prefix="filingsift-")
    return _own_dir.name


def scratch_path(spark, name):
    """A fresh path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _paths.append(path)
    return path


@contextmanager
def scratch(spark):
    """Delete, on leaving, what jobs wrote below the shared folder since entering.

    Write a job's result inside: ``with scratch(spark): score_chunks(chunks).write.parquet(path)``.
    """
    before = len(_paths)
    try:
        yield
    finally:
        release_scratch(spark, before)


def release_scratch(spark, keep=0):
    """Delete what this process wrote below the shared folder (all but the ``keep`` oldest), once no result reads it."""
    while len(_paths) > keep:
        _delete(spark, _paths.pop())


def drop_scratch(spark, path):
    """Delete one path of :func:`scratch_path` before the rest."""
    if path in _paths:
        _paths.remove(path)
    _delete(spark, path)


def scratch_mark():
    """A point in time for :func:`release_since`."""
    return len(_paths)


def release_since(spark, mark, keep=0):
    """Delete what was written since ``mark`` but the ``keep`` youngest tables, and the shuffles nothing refers to any more."""
    while len(_paths) > mark + keep:
        _delete(spark, _paths.pop(mark))
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name="table", partition_by=()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and lets several
    later jobs read a compact columnar copy instead of repeating the work above it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
