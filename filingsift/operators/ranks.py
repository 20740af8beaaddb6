"""Global order statistics without a single-task sort.

A running total over a whole table is done in two steps: rows are cut into value ranges, each range
is ordered by its own task, and the (few) range totals become offsets. Values are aggregated first,
so ties of any size are one row.
"""
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingsift.functions.keys import draw_key
from filingsift.session import materialize

VALUES_PER_RANGE = 200_000
MOST_RANGES = 4096


def all_of(conds):
    return reduce(lambda a, b: a & b, conds)


def null_safe_join(left: DataFrame, right: DataFrame, cols, how="left") -> DataFrame:
    """Equi-join on columns where null equals null; the right copies of the keys are dropped."""
    renamed = right
    for c in cols:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    cond = all_of([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


def scalar_row(row: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery: its fields are constants of a later plan."""
    return row.select(F.struct(*[F.col(c) for c in row.columns])).scalar()


def beside(base: DataFrame, *rows: DataFrame) -> DataFrame:
    """Append the columns of one-row tables as constants."""
    for i, row in enumerate(rows):
        base = base.withColumn(f"_one{i}", scalar_row(row))
    taken = [F.col(f"_one{i}").getField(c).alias(c) for i, row in enumerate(rows) for c in row.columns]
    return base.select("*", *taken).drop(*[f"_one{i}" for i in range(len(rows))])


def _range_column(values: DataFrame, col) -> DataFrame:
    """Add ``_range``: an equal-frequency range number over the distinct values.

    The number of ranges follows the number of distinct values, so a range stays a task-sized piece.
    """
    ranges = min(MOST_RANGES, values.count() // VALUES_PER_RANGE + 1)
    bounds = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        # at most MOST_RANGES numbers reach the driver
        points = values.agg(F.percentile_approx(col, F.lit(cuts), F.lit(20 * ranges)).alias("p")).first()["p"]
        bounds = sorted({float(p) for p in points or [] if p is not None})
    splits = [float("-inf")] + (bounds or [0.0]) + [float("inf")]
    placed = values.withColumn("_as_double", F.col(col).cast("double"))  # equal doubles share a range, so order is kept
    return Bucketizer(splits=splits, inputCol="_as_double", outputCol="_range", handleInvalid="keep").transform(placed).drop("_as_double")


def value_table(df: DataFrame, value, sums: dict[str, Column], by=()) -> DataFrame:
    """Sums per distinct non-null ``value`` (and group), written once: the source is read a single time.

    Large integers and decimals keep their type, so values that are equal only as doubles stay apart.
    """
    kind = df.select(value).schema[0].dataType
    exact = isinstance(kind, (T.LongType, T.DecimalType))
    own = (df.filter(F.col(value).isNotNull())
           .groupBy(*by, (F.col(value) if exact else F.col(value).cast("double")).alias("value"))
           .agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    return materialize(own, "values")


def prefix_counts(df: DataFrame, value, sums: dict[str, Column], by=(), descending=False) -> DataFrame:
    """Per distinct value: own sums, and the same sums over this value and all before it.

    Output: by columns, ``value``, and per sum ``name`` (own), ``cum_name`` (inclusive) and
    ``total_name``; plus ``next_name`` (own sum of the following value, null at the end).
    """
    return _running(value_table(df, value, sums, by), list(sums), list(by), descending)


def _running(own: DataFrame, sums, by, descending=False) -> DataFrame:
    own = _range_column(own, "value")
    if descending:
        own = own.withColumn("_range", -F.col("_range"))
    order = F.col("value").desc() if descending else F.col("value").asc()
    edge = F.max_by if descending else F.min_by
    totals = own.groupBy(*by, "_range").agg(
        *[F.sum(n).alias(f"_sum_{n}") for n in sums],
        *[edge(n, "value").alias(f"_first_{n}") for n in sums])
    # one row per (group, range), at most MOST_RANGES + 1 rows in a group
    ranges = Window.partitionBy(*by).orderBy("_range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"total_{n}") for n in sums],
        *[F.lead(f"_first_{n}").over(ranges).alias(f"_lead_{n}") for n in sums])
    within = Window.partitionBy(*by, "_range").orderBy(order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(own, F.broadcast(offsets) if not by else offsets, by + ["_range"], "inner")
    return joined.select(
        *by, "value", *sums,
        *[(F.sum(n).over(running) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in sums],
        *[F.col(f"total_{n}") for n in sums],
        *[F.coalesce(F.lead(n).over(within), F.col(f"_lead_{n}")).alias(f"next_{n}") for n in sums])


def exact_quantiles(df: DataFrame, value, probs, by=(), names=None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per probability.

    Also returns ``n``, the count of non-null values.
    """
    return table_quantiles(value_table(df, value, {"n": F.lit(1)}, by), probs, by, names)


def table_quantiles(own: DataFrame, probs, by=(), names=None) -> DataFrame:
    """:func:`exact_quantiles` from a value table with counts ``n``."""
    by = list(by)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    curve = _running(own, ["n"], by)
    first = F.col("cum_n") - F.col("n")
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total_n") - 1)
        for edge, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((first <= at) & (at < F.col("cum_n")), F.col("value"))).alias(f"_{edge}{i}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_w{i}"))
    row = curve.groupBy(*by).agg(F.max("total_n").alias("n"), *picks)
    out = [(F.col(f"_lo{i}").cast("double") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")).cast("double") * F.col(f"_w{i}")).alias(name)
           for i, name in enumerate(names)]
    return row.select(*by, "n", *out)


def rank_by_draw(df: DataFrame, id_col, seed, strata=(), digits=3, rank="draw_rank", size="stratum_size"):
    """Exact 1-based rank of every row in the pseudo-random order of its stratum.

    The draw key is uniform, so its leading hex digits are balanced ranges: no sampling pass is
    needed and a stratum of any size is spread over ``16 ** digits`` tasks. The size of each stratum
    comes along.
    """
    strata = list(strata)
    keyed = df.withColumn("_draw", draw_key(seed, id_col)).withColumn("_slot", F.substring("_draw", 1, digits))
    slots = keyed.groupBy(*strata, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*strata).orderBy("_slot")
    offsets = slots.select(
        *strata, "_slot",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias(size))
    inside = Window.partitionBy(*strata, "_slot").orderBy("_draw", id_col)
    joined = null_safe_join(keyed, offsets, strata + ["_slot"], "inner")
    return (joined.withColumn(rank, F.col("_off") + F.row_number().over(inside))
            .drop("_draw", "_slot", "_off"))
