"""Intermediate tables of one job, in the shared folder, deleted as soon as nothing reads them."""
import gc
import time

from pyspark.sql import DataFrame, functions as F

from filingsift.session import scratch_path


class Tables:
    """Write a step's rows as Parquet and read them back: cuts the lineage, and a lost executor costs a re-read."""

    def __init__(self, spark, job):
        self.spark, self.job, self.paths = spark, job, {}

    def write(self, name, df: DataFrame) -> DataFrame:
        """Replaces an earlier table of the same name once the new one is whole."""
        path = scratch_path(self.spark, f"{self.job}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        time.sleep(0.5)  # listeners still hold the finished query for a moment
        gc.collect()
        self.spark._jvm.System.gc()  # the cleaner removes the shuffle files of steps that nothing refers to
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names):
        for name in names:
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def _delete(self, path):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def packed(df: DataFrame, text):
    """(row, text): the text and a struct of all other columns, so that no name can clash with a result's."""
    other = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(F.struct(*(other or [F.lit(0).alias("none")])).alias("row"), F.col(f"`{text}`").alias("text"))


def unpacked(df: DataFrame, names, text):
    """The columns ``names`` of a packed table, in order."""
    return df.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])
