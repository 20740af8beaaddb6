"""Stored sketches of large audits: quantiles and distinct counts of any set of groups without reading the rows again.

A pass over the rows leaves one state per group (a year, say): the exact number of rows, a KLL sketch of each measure
and a HyperLogLog sketch of each key. States are a few kilobytes whatever the group's size, they are built by
partial aggregation in the tasks, and they merge: the state of several groups is the union of theirs. A stored table of
states grows by groups; a group that is built again replaces its own state only.

Error bounds, each with a confidence of 99 % or more: the share of rows below a quantile is off by at most
:func:`rank_error`, a distinct count by the factor :func:`count_error`.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, LG_SIZE = 1000, 16


def rank_error(size=SIZE) -> float:
    """Two-sided normalised rank error of a KLL sketch of this size."""
    return 2.446 / size ** 0.9433


def count_error(lg_size=LG_SIZE) -> float:
    """Three standard errors of a HyperLogLog sketch with 2 ** lg_size registers."""
    return 3 * 1.04 / 2 ** (lg_size / 2)


def build_states(df: DataFrame, by, measures=(), keys=(), size=SIZE, lg_size=LG_SIZE) -> DataFrame:
    """One row per group: by columns, ``n_rows``, ``q_<measure>`` and ``d_<key>``. Nulls take no part in a sketch."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.expr(f"kll_sketch_agg_double(cast(`{m}` as double), {int(size)})").alias(f"q_{m}") for m in measures],
        *[F.expr(f"hll_sketch_agg(cast(`{k}` as string), {int(lg_size)})").alias(f"d_{k}") for k in keys])


def store_states(states: DataFrame, path, by) -> DataFrame:
    """Add the groups of ``states`` to the table at ``path``; groups that are there already are replaced."""
    spark = states.sparkSession
    (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    return stored_states(spark, path, states.schema)


def stored_states(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def merge_states(states: DataFrame, by=()) -> DataFrame:
    """States of larger groups, one row per value of ``by`` (one row in all without it)."""
    merged = {"q_": "kll_merge_agg_double", "d_": "hll_union_agg"}
    columns = [c for c in states.columns if c[:2] in merged and c not in by]
    return states.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[F.expr(f"{merged[c[:2]]}(`{c}`)").alias(c) for c in columns])


def estimates(states: DataFrame, probs=(0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)) -> DataFrame:
    """What states say: ``n_<measure>`` values and their quantiles ``p<percent>_<measure>``, and ``distinct_<key>``."""
    out = []
    for c in states.columns:
        if c.startswith("q_"):
            n = F.expr(f"kll_sketch_get_n_double(`{c}`)")
            some = F.when(n > 0, F.col(c))
            out.append(n.alias(f"n_{c[2:]}"))
            out += [F.call_function("kll_sketch_get_quantile_double", some, F.lit(float(p))).alias(f"p{round(p * 100)}_{c[2:]}") for p in probs]
        elif c.startswith("d_"):
            out.append(F.expr(f"hll_sketch_estimate(`{c}`)").alias(f"distinct_{c[2:]}"))
        else:
            out.append(F.col(c))
    return states.select(*out)
