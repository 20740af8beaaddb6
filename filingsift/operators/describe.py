"""Descriptive statistics of a labelled corpus."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingsift.operators.audit import unfold
from filingsift.operators.ranks import beside, exact_quantiles, null_safe_join, table_quantiles, value_table
from filingsift.session import materialize


def value_counts(df: DataFrame, col) -> DataFrame:
    """Count and share of every non-null value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (beside(counts, total)
            .select(col, "n", (F.col("n") / F.col("_total")).alias("share")))


def extreme(df: DataFrame, by, k, tie, bottom=False) -> DataFrame:
    """Top or bottom k rows by a measure, ties broken by name: a per-task heap, then a merge."""
    first = F.col(by).asc() if bottom else F.col(by).desc()
    return df.orderBy(first, F.col(tie).asc_nulls_last()).limit(k)


def summary_stats(df: DataFrame, col, by=()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    by = list(by)
    own = value_table(df, col, {"n": F.lit(1)}, by)
    quarts = table_quantiles(own, (0.25, 0.5, 0.75), by, ["q25", "q50", "q75"]).drop("n")
    n, v = F.col("n"), F.col("value")
    base = own.groupBy(*by).agg(F.sum(n).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"),
                                F.max(v).alias("max"))

    def join(left, right):
        return null_safe_join(left, right, by, "inner") if by else beside(left, right)
    off = v - F.col("mean")
    spread = join(own, base.select(*by, "mean")).groupBy(*by).agg(
        F.when(F.sum(n) > 1, F.sqrt(F.sum(off * off * n) / (F.sum(n) - 1))).alias("std"))
    joined = join(join(base, spread), quarts)
    return joined.select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def by_dimension(df: DataFrame, dimensions, keep=()) -> DataFrame:
    """One row per row and non-null dimension: (dimension, value, kept columns).

    Several reports over several dimensions then need one scan and one shuffle of partial sums.
    """
    items = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    long = df.select(*keep, F.explode(items).alias("_d"))
    return long.select("_d.dimension", "_d.value", *keep).filter("value is not null")


def top_per_dimension(df: DataFrame, by, k) -> DataFrame:
    """The k largest per dimension, ties by value; tasks pass on k rows per dimension."""
    order = Window.partitionBy("dimension").orderBy(F.col(by).desc(), F.col("value").asc())
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def distinct_companies(df: DataFrame, dimensions, company="cik", approximate=False) -> DataFrame:
    """Companies per value of every dimension; exact, or from a sketch."""
    count = F.approx_count_distinct(company, 0.01) if approximate else F.countDistinct(company)
    return by_dimension(df, dimensions, [company]).groupBy("dimension", "value").agg(count.alias("companies"))


def group_size_summary(df: DataFrame, dimensions) -> DataFrame:
    """Summary of the group sizes of every dimension: groups, max, min, mean, std, median."""
    sizes = by_dimension(df, dimensions).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes, "sizes")
    medians = exact_quantiles(sizes, "size", (0.5,), ["dimension"], ["median"]).drop("n")
    base = sizes.groupBy("dimension").agg(
        F.count("size").alias("groups"), F.max("size").alias("max"), F.min("size").alias("min"),
        F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"))
    return base.join(medians, "dimension")


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """Distinct values of several columns in one aggregate."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def label_rates(df: DataFrame, dimensions, label="fraudulent", min_total=0) -> DataFrame:
    """Positives, labelled rows and rate per value of every dimension, with a minimum support."""
    rates = (by_dimension(df, dimensions, [label]).groupBy("dimension", "value")
             .agg(F.sum(label).alias("fraud_count"), F.count(label).alias("total_count"))
             .withColumn("fraud_rate", F.try_divide("fraud_count", "total_count")))
    return rates.filter(F.col("total_count") >= min_total)


def yearly_volume(df: DataFrame, date, label, words) -> DataFrame:
    """Per year: positives, filings, mean and median word count."""
    dated = df.withColumn("year", F.year(date)).filter(F.col("year").isNotNull())
    base = dated.groupBy("year").agg(F.sum(label).alias("fraudulent_count"), F.count(label).alias("total_count"),
                                     F.avg(words).alias("mean_word_count"))
    medians = exact_quantiles(dated, words, (0.5,), ["year"], ["median_word_count"]).drop("n")
    return base.join(medians, "year", "left")


def label_pivot(df: DataFrame, key, label="fraudulent") -> DataFrame:
    """Rows per key and label, zero filled, and the ratio of positives."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"))
            .withColumn("fraud_ratio", F.try_divide("label_1", F.col("label_0") + F.col("label_1"))))


def drop_early_releases(enforcement: DataFrame, released="release_date", end="fraud_end") -> DataFrame:
    """Only releases on or after the end of the period they concern."""
    return enforcement.filter(F.datediff(released, end) >= 0)


def indicator_totals(df: DataFrame, indicators) -> DataFrame:
    """Column sums of 0/1 indicators, one row each."""
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{i}_total")
                   for i, c in enumerate(indicators)])
    return unfold(row, list(indicators), ["total"], "indicator")


def flag_overlap(df: DataFrame, flags) -> DataFrame:
    """Size of every non-empty region of overlapping 0/1 flags."""
    flags = list(flags)
    on = [F.coalesce(F.col(f) == 1, F.lit(False)).cast("int").alias(f) for f in flags]
    none = " and ".join(f"{f} = 0" for f in flags)
    return df.select(*on).groupBy(*flags).agg(F.count(F.lit(1)).alias("n")).filter(f"not ({none})")


def certainty_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per named 0/1 column: uncertain and certain rows."""
    aggs = []
    for i, c in enumerate(columns.values()):
        aggs += [F.count_if(F.col(c) == 0).alias(f"{i}_uncertain"), F.count_if(F.col(c) == 1).alias(f"{i}_certain")]
    return unfold(df.agg(*aggs), list(columns), ["uncertain", "certain"], "bound")


def rows_at_maximum(df: DataFrame, col) -> DataFrame:
    """Every row that holds the largest value."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


def crosstab(df: DataFrame, rows, columns, values) -> DataFrame:
    """Counts of a row category against the listed column categories, zero filled."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in values])


def histogram(df: DataFrame, col, bins=30) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin.

    Empty bins are reported with 0.
    """
    x = F.col(col).cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    # numpy widens a single-valued range by one half on either side
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                         F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor((x - F.col("lo")) / step), F.lit(bins - 1)).cast("int")
    counts = (beside(df.filter(x.isNotNull()).select(x.alias(col)), edges).select(slot.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    frame = edges.select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (frame.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def box_summary(df: DataFrame, col, reach=1.5) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 IQR, and the outliers beyond."""
    x = F.col(col).cast("double")
    quarts = exact_quantiles(df, col, (0.25, 0.5, 0.75), names=["q25", "median", "q75"])
    spread = F.col("q75") - F.col("q25")
    low, high = F.col("q25") - reach * spread, F.col("q75") + reach * spread
    inside = x.between(low, high)
    whiskers = (beside(df.filter(x.isNotNull()).select(x.alias(col)), quarts)
                .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
                     F.count_if(~inside).alias("outliers")))
    return beside(quarts.drop("n"), whiskers)


def class_weights(df: DataFrame, label) -> DataFrame:
    """Balanced weight of every class: rows / (classes x rows of the class)."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = sizes.agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return (beside(sizes, whole)
            .select(label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight")))


def with_class_weights(df: DataFrame, label, weight="weight") -> DataFrame:
    """Rows with the balanced weight of their class; the class table has one row per label."""
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(weight))), label, "left")


def status_counts(df: DataFrame, status) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def novelty_summary(scores: DataFrame) -> DataFrame:
    """Per filing: chunks, scored chunks, mean similarity and novelty, chunks per category."""
    from filingsift.operators.novelty import CATEGORIES
    filing = ["company", "filing_id", "filing_date"]
    base = scores.groupBy(*filing).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count("max_similarity").alias("scored_chunks"),
        F.avg("max_similarity").alias("mean_similarity"), F.avg("novelty_score").alias("mean_novelty"))
    return attach_one_to_one(base, crosstab(scores, "filing_id", "boilerplate_category", CATEGORIES), "filing_id")


def attach_one_to_one(summary: DataFrame, counts: DataFrame, key) -> DataFrame:
    """Left join that must not multiply rows: either side repeating a key is an error."""
    from filingsift.operators.dedup import require_unique
    require_unique(summary, [key])
    require_unique(counts, [key])
    return summary.join(counts, key, "left")


def chunk_quality(chunks: DataFrame, low=50, high=220) -> DataFrame:
    """Short and long chunks, missing text, repeated ids and the spread over companies and filings."""
    slim = materialize(chunks.select("company", "filing_id", "chunk_id", "word_count", F.col("chunk_text").isNull().alias("missing")),
                       "chunk-quality")
    repeats = (slim.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
               .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids")))
    per_filing = slim.groupBy("company", "filing_id").agg(F.count(F.lit(1)).alias("n"))
    filings = per_filing.agg(F.count(F.lit(1)).alias("filings"), F.max("n").alias("most_per_filing"), F.avg("n").alias("mean_per_filing"))
    companies = (per_filing.groupBy("company").agg(F.sum("n").alias("n"))
                 .agg(F.count(F.lit(1)).alias("companies"), F.max("n").alias("most_per_company")))
    base = slim.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("word_count") < low).alias("under_low"),
                    F.count_if(F.col("word_count") > high).alias("over_high"), F.count_if("missing").alias("missing_text"))
    return beside(base, repeats, filings, companies)
