"""Joins of filings with enforcement records, reviews and other corpora."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.fields import add_year
from filingsift.functions.keys import row_key
from filingsift.operators.ranks import null_safe_join


FILINGS_PER_RANGE = 10_000


def attach_enforcement(filings: DataFrame, enforcement: DataFrame, key="cik") -> DataFrame:
    """Left join: a filing appears once per release of its firm, or once without any.

    Adaptive execution broadcasts the records while their bytes are below its threshold; beyond it the join
    shuffles, and the partitions of hot firms are split.
    """
    return filings.join(enforcement, key, "left")


def label_filings(joined: DataFrame, reported="reporting_date", start="fraud_start", end="fraud_end") -> DataFrame:
    """1 where the report lies in [start, end + 1 year], else 0; missing bounds give 0.

    A projection over the equi-join, so releases that do not cover the report survive as 0 rows.
    """
    inside = F.col(reported).between(F.col(start), add_year(end))
    return joined.withColumn("fraudulent", F.coalesce(inside, F.lit(False)).cast("int"))


def drop_known(general: DataFrame, labelled: DataFrame, keys) -> DataFrame:
    """Rows of ``general`` whose identity does not occur in ``labelled``; null equals null."""
    known = labelled.select(row_key(*keys).alias("_key")).distinct()
    return general.withColumn("_key", row_key(*keys)).join(known, "_key", "left_anti").drop("_key")


def append_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom, allowMissingColumns=True)


def accepted_sections(candidates: DataFrame, reviews: DataFrame, key="filing_id", text="section_text") -> DataFrame:
    """Candidates a reviewer accepted on every question and that have text.

    A key that repeats in the reviews is an error.
    """
    from filingsift.operators.dedup import require_unique
    require_unique(reviews, [key])
    require_unique(candidates, [key])

    def says(column, word):
        return F.lower(F.trim(column)) == word
    merged = candidates.join(reviews.select(
        key, "correct_start", "correct_end", "toc_contamination", "review_decision", "review_notes"), key, "left")
    return merged.filter(
        says("review_decision", "accept") & says("correct_start", "yes") & says("correct_end", "yes")
        & says("toc_contamination", "no") & (F.trim(text) != "")
    ).withColumn("verification_status", F.lit("manually_accepted"))


def company_overlap(df: DataFrame, company, is_train, is_test) -> DataFrame:
    """Distinct companies in train, in test and in both."""
    per_company = (df.filter(F.col(company).isNotNull()).groupBy(company)
                   .agg(F.max(is_train.cast("int")).alias("tr"), F.max(is_test.cast("int")).alias("te")))
    return per_company.agg(
        F.coalesce(F.sum("tr"), F.lit(0)).cast("bigint").alias("train_companies"),
        F.coalesce(F.sum("te"), F.lit(0)).cast("bigint").alias("test_companies"),
        F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("both_companies"))


def previous_filings(filings: DataFrame, company="company", filing_id="filing_id", filing_date="filing_date") -> DataFrame:
    """Each filing with the one of its company just before it by (date, id); null for the first.

    Three steps, so a company holding a large share of all filings is spread over its dates and a crowded day
    over ranges of ids: order within one (company, date, range), hand over the last filing of the range before,
    and at the start of a day the last filing of the day before. The later windows see one row per range and one
    per day. A day of up to ``FILINGS_PER_RANGE`` filings is one range.
    """
    distinct = filings.select(company, filing_id, filing_date).distinct()
    day = [company, filing_date]
    # ranges of ids with about FILINGS_PER_RANGE filings each; the cut points of a day are a short array
    cuts = distinct.groupBy(*day).agg(F.count(F.lit(1)).alias("_n"))
    crowded = cuts.filter(F.col("_n") > FILINGS_PER_RANGE).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(day)], "_n")
    marks = (distinct.join(crowded, distinct[company].eqNullSafe(crowded["_0"]) & distinct[filing_date].eqNullSafe(crowded["_1"]))
             .filter(F.pmod(F.xxhash64(filing_id), F.lit(FILINGS_PER_RANGE)) == 0)
             .groupBy(*day).agg(F.sort_array(F.collect_set(filing_id)).alias("_marks")))
    placed = null_safe_join(distinct, marks, day)
    at = F.when(F.col("_marks").isNull(), 0).otherwise(F.size(F.filter("_marks", lambda m: m <= F.col(filing_id))))
    placed = placed.withColumn("_range", at).drop("_marks")
    ranges = placed.groupBy(*day, "_range").agg(F.max(filing_id).alias("_last"))
    ranges = ranges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*day).orderBy("_range")))
    days = ranges.groupBy(*day).agg(F.max("_last").alias("_last"))
    days = days.withColumn("_prev", F.lag(F.struct("_last", filing_date)).over(Window.partitionBy(company).orderBy(filing_date))).drop("_last")
    stepped = placed.withColumn("_same", F.lag(filing_id).over(Window.partitionBy(*day, "_range").orderBy(filing_id)))
    joined = null_safe_join(null_safe_join(stepped, ranges.drop("_last"), [*day, "_range"]), days, day)
    same = F.coalesce("_same", "_before")
    return joined.select(
        company, filing_id, filing_date, F.coalesce(same, F.col("_prev._last")).alias("reference_filing_id"),
        F.when(same.isNotNull(), F.col(filing_date)).otherwise(F.col(f"_prev.{filing_date}")).alias("reference_filing_date"))


def align_years(left: DataFrame, right: DataFrame, year="year") -> DataFrame:
    """Two yearly summaries side by side on their common years."""
    a = left.select(year, *[F.col(c).alias(f"{c}_all") for c in left.columns if c != year])
    b = right.select(year, *[F.col(c).alias(f"{c}_filtered") for c in right.columns if c != year])
    return a.join(b, year)


def compare_windows(metrics: DataFrame, metric="metric", window="window", value="value") -> DataFrame:
    """Per metric, every pair of windows: own value on the diagonal, else earlier minus later.

    The input is a metrics table (one row per metric and evaluation window), and the matrix is its
    result by definition.
    """
    a = metrics.select(F.col(metric), F.col(window).alias("i"), F.col(value).alias("_a"))
    b = metrics.select(F.col(metric), F.col(window).alias("j"), F.col(value).alias("_b"))
    diff = (F.when(F.col("i") == F.col("j"), F.col("_a"))
            .when(F.col("i") < F.col("j"), F.col("_a") - F.col("_b")).otherwise(F.col("_b") - F.col("_a")))
    return a.join(b, metric).select(metric, "i", "j", F.round(diff, 4).alias("diff"))
