"""Reading inputs, writing results, document manifests and cached feature tables."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(scan: DataFrame, *key) -> DataFrame:
    """Distribute a scan over the cores when its files give fewer splits than there are cores.

    Text work is bound by the processor, and one small file is one task. A table of cluster size has far
    more splits than cores and is left as it is. ``scan`` must be a plain table scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *key)


def read_delimited(spark: SparkSession, path, schema, sep=";", columns=None, multiline=False) -> DataFrame:
    """A delimited file with a header. ``multiline`` is for quoted line feeds; such a file cannot be split, so it
    is one task however large it is."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"') \
        .option("multiLine", multiline).csv(path)
    return df.select(*columns) if columns else df


def read_csv(spark, path, schema, keep_empty=False, columns=None, multiline=False) -> DataFrame:
    """CSV with one of two null conventions.

    By default an empty field is null; with ``keep_empty`` no text is ever null and a missing value
    is the empty string. ``columns`` prunes the scan.
    """
    df = read_delimited(spark, path, schema, ",", columns, multiline)
    return df.fillna("") if keep_empty else df


def read_json_records(spark, path, schema, single_array=False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", single_array).json(path)


def write_table(df: DataFrame, path, fmt="parquet", partition_by=(), sep=","):
    """Write results; Parquet is the format of record, CSV the exchange format."""
    writer = df.write.mode("overwrite")
    if partition_by:
        # rows of one value meet in few tasks, so a run writes few files per folder; adaptive execution splits
        # the partition of a dominant value by its bytes
        writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_record(spark, record: dict, path, fmt="json"):
    """One run-configuration or metric record as a one-row table."""
    df = spark.createDataFrame([tuple(record.values())], list(record.keys()))
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)


def read_documents(spark: SparkSession, path) -> DataFrame:
    """Raw document files as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


# What a complete filing document must start with, and what an access refusal says.
MARKUP_OPENINGS = ["<html", "<!doctype", "<?xml", "<document"]
REFUSALS = ["access denied", "request rate threshold exceeded"]


def document_manifest(docs: DataFrame, id_col, content, path=None, min_bytes=1000, head_chars=5000) -> DataFrame:
    """Id, status, size and SHA-256 of every raw document, and where it lies if a ``path`` column says so.

    ``content`` is a text column or the ``content`` column of the ``binaryFile`` source. A failed
    document reports size 0, no digest, no path and the reason.
    """
    place = F.lit("") if path is None else F.coalesce(F.col(path), F.lit(""))
    raw = F.col(content).cast("binary")
    head = F.lower(F.substring(F.decode(F.substring(raw, 1, head_chars), "ISO-8859-1"), 1, head_chars))
    opens = F.lit(False)
    for mark in MARKUP_OPENINGS:
        opens = opens | F.contains(head, F.lit(mark))
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | F.contains(head, F.lit(phrase))
    size = F.coalesce(F.octet_length(raw), F.lit(0))
    error = (F.when((size < min_bytes) | ~F.coalesce(opens, F.lit(False)),
                    F.lit("Unexpected or suspiciously small filing document"))
             .when(refused, F.lit("Access restriction in response body")).otherwise(F.lit("")))
    return (docs.select(F.col(id_col), raw.alias("_raw"), size.alias("_size"), place.alias("_path"), error.alias("error"))
            .select(id_col,
                    F.when(F.col("error") == "", "downloaded").otherwise("failed").alias("status"),
                    F.when(F.col("error") == "", F.col("_size")).otherwise(0).cast("bigint").alias("bytes"),
                    F.when(F.col("error") == "", F.sha2("_raw", 256)).otherwise("").alias("sha256"),
                    F.when(F.col("error") == "", F.col("_path")).otherwise("").alias("raw_path"),
                    "error"))


def table_exists(spark, path) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"))


def cached_features(keys: DataFrame, key, path, build) -> DataFrame:
    """Reuse the feature table at ``path`` or build it, then check it covers exactly ``keys``.

    ``build`` maps the key table to features carrying ``key``. A stored table that misses a key or
    has other rows raises instead of being silently misaligned.
    """
    spark = keys.sparkSession
    if not table_exists(spark, path):
        build(keys).write.mode("overwrite").parquet(path)
    features = spark.read.parquet(path)
    wanted, stored = keys.count(), features.count()
    if wanted != stored:
        raise ValueError(f"cached features hold {stored} rows, {wanted} expected: {path}")
    if not keys.select(key).join(features.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"cached features miss keys: {path}")
    return features


def require_columns(df: DataFrame, names) -> DataFrame:
    """The table itself, or an error naming every missing column before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("Required columns are missing: " + ", ".join(missing))
    return df


def text_column(c) -> Column:
    return F.coalesce(F.col(c), F.lit(""))
