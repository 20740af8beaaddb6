"""Identity hashes, keyed pseudo-random order, and unrolling of arrays."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(*cols) -> Column:
    """256-bit identity of a tuple of columns; null equals null.

    Each value is written with its length in front, so different tuples never share an encoding.
    Shuffles then move 64 characters instead of whole texts.
    """
    parts = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def draw_key(seed, id_col) -> Column:
    """Uniform key of a row: depends on seed and id only, never on partitioning or task."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def draw_fraction(seed, id_col) -> Column:
    """The draw key as a number in [0, 1), from its first 13 hex digits."""
    digits = F.substring(draw_key(seed, id_col), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


def unroll(df: DataFrame, keep, array: Column, value, position=None) -> DataFrame:
    """One row per array element, with its 0-based position if asked for.

    The outer form with a filter behind it is used on purpose: for the inner form the optimiser derives a
    size filter from the array expression and pushes it down, which evaluates that expression twice.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias("_at", value)).filter(F.col("_at").isNotNull())
    return out.withColumnRenamed("_at", position) if position else out.drop("_at")
