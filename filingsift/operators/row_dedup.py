"""Exact duplicates of whole rows without moving their texts.

Rows are read from Parquet, so each has a place: its file and its index in it. The first pass sends only a 256-bit key
of the row and its place to the tasks that compare keys; of equal rows the one at the first place stays. The places of the
others, two numbers each, are what the second pass needs to leave them out. It reads the files again and
drops rows where they lie: no exchange carries a text.

Places are broadcast, in blocks of at most ``MOST_PLACES``. A block covers some of the files (or rows of one large
file) and its pass reads only those, so all blocks together read the table once.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.session import materialize, scratch_path

MOST_PLACES = 4_000_000


def row_key(df: DataFrame):
    """SHA-256 over all columns; null differs from every value, and no two rows share a spelling."""
    spelled = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "string":
            value = F.sha2(value, 256)
        elif field.dataType.simpleString() == "binary":
            value = F.sha2(value, 256)
        else:
            value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        spelled.append(F.coalesce(F.concat(F.lit("="), value), F.lit("null")))
    return F.sha2(F.concat_ws("|", *spelled), 256)


def _placed(spark, path, files=None) -> DataFrame:
    scan = spark.read.parquet(path)
    place = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return place if files is None else place.filter(F.col("_metadata.file_path").isin(files))


def repeated_places(spark, path) -> DataFrame:
    """(_file, _row) of every row that an equal row precedes."""
    keyed = _placed(spark, path).select(F.unhex(row_key(spark.read.parquet(path))).alias("key"), "_file", "_row")
    first = F.min(F.struct("_file", "_row"))
    firsts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1").select("key", "first"), "repeated-keys")
    return (keyed.join(firsts, "key").filter((F.col("_file") != F.col("first._file")) | (F.col("_row") != F.col("first._row")))
            .select("_file", "_row"))


def _blocks(counts, most):
    """(files, first row, end row) with at most ``most`` places each; ``counts``: (file, places, last row)."""
    files, held = [], 0
    for file, n, last in counts:
        if n > most:
            parts = -(-n // most)
            # a row holds one place at most, so ranges of ``most`` rows are within the bound
            parts = max(parts, -(-(last + 1) // most))
            step = -(-(last + 1) // parts)
            for i in range(parts):
                yield [file], i * step, None if i == parts - 1 else (i + 1) * step
            continue
        if held + n > most and files:
            yield files, 0, None
            files, held = [], 0
        files, held = [*files, file], held + n
    if files:
        yield files, 0, None


def drop_repeated_rows(spark, path, most=MOST_PLACES) -> DataFrame:
    """The distinct rows of a Parquet table, each where its first occurrence (by file name and row) stands."""
    places = materialize(repeated_places(spark, path), "repeated-places")
    counts = places.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.max("_row").alias("last")).orderBy("_file").collect()  # a row per file
    blocks = list(_blocks([tuple(r) for r in counts], most))
    if len(blocks) <= 1:
        return _without(_placed(spark, path), places)
    touched = {r["_file"] for r in counts}
    out, schema = scratch_path(spark, "distinct-rows"), spark.read.parquet(path).schema
    rest = _placed(spark, path).filter(~F.col("_file").isin(list(touched))).drop("_file", "_row")
    rest.write.mode("append").parquet(out)
    for files, first, end in blocks:
        inside = F.col("_row") >= first
        if end is not None:
            inside = inside & (F.col("_row") < end)
        _without(_placed(spark, path, files).filter(inside), places.filter(F.col("_file").isin(files) & inside)).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _without(rows: DataFrame, places: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(places), ["_file", "_row"], "left_anti").drop("_file", "_row")
