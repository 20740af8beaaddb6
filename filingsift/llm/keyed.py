"""Joining a table with one row per key to rows of which any share may have the same key."""
from pyspark.sql import DataFrame, functions as F

from filingsift.operators.ranks import all_of, null_safe_join

HOT_KEYS = 1000


def attach(rows: DataFrame, per_key: DataFrame, keys, n="n_rows") -> DataFrame:
    """Inner join on ``keys``, null equal to null; ``per_key`` says in ``n`` how many rows have each key.

    A key with more than 1 in ``HOT_KEYS`` of all rows is hot. There are at most ``HOT_KEYS`` such keys, so they are
    broadcast, and their rows stay where they are; the rows of the other keys are shuffled, and no key has many.
    Both tables are read twice, so they should be written ones.
    """
    total = per_key.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * HOT_KEYS > F.lit(total)
    hot, cold = per_key.filter(is_hot), per_key.filter(~is_hot)
    names = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = all_of([F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    near = null_safe_join(rows, F.broadcast(hot), keys, "inner")
    far = null_safe_join(rows.join(F.broadcast(names), same, "left_anti"), cold, keys, "inner")
    return near.unionByName(far)
