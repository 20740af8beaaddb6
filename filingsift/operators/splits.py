"""Leakage-safe splits and reproducible draws.

Draws depend on a seed and a row key only, so a lost executor or another partitioning gives the same
sample.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.keys import draw_fraction, draw_key
from filingsift.operators.ranks import beside, exact_quantiles, rank_by_draw


def _round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def temporal_split(date, train_end=2017, test_start=2018, test_end=2023) -> Column:
    y = F.year(date)
    return (F.when(y <= train_end, "train").when(y.between(test_start, test_end), "test").otherwise("excluded"))


# Fixed values: (first, last) years of train, validation and test pools; None leaves a side open.
DELAY_SPLITS = {
    "until_2008": {"train": (None, 2008), "validation": None, "test": (2011, 2011)},
    "from_2004": {"train": (2004, 2008), "validation": None, "test": (2011, 2011)},
    "only_2003": {"train": (2003, 2003), "validation": (2004, 2008), "test": (2011, 2011)},
    "only_2008": {"train": (2008, 2008), "validation": (2004, 2007), "test": (2011, 2011)},
    "fixed_validation": {"train": (2003, 2008), "validation": (1997, 2002), "test": (2011, 2011)},
}


def _in_years(year: Column, bounds) -> Column:
    if bounds is None:
        return F.lit(False)
    low, high = bounds
    cond = F.lit(True)
    if low is not None:
        cond = cond & (year >= low)
    if high is not None:
        cond = cond & (year <= high)
    return cond


def delay_split(date, variant="until_2008") -> Column:
    """Train years and a test year set apart by the time detection takes."""
    pools = DELAY_SPLITS[variant] if isinstance(variant, str) else variant
    y = F.year(date)
    return (F.when(_in_years(y, pools["train"]), "train").when(_in_years(y, pools["validation"]), "validation")
            .when(_in_years(y, pools["test"]), "test").otherwise("excluded"))


def stratified_split(df: DataFrame, id_col, label, fraction=0.2, seed=42, names=("train", "validation"),
                     exact=True) -> DataFrame:
    """Hold out a fixed fraction of every class.

    ``exact`` cuts at the rounded class size; otherwise a hash threshold decides row by row, with no
    shuffle at all.
    """
    rest, held = names
    if not exact:
        return df.withColumn("split", F.when(draw_fraction(seed, id_col) < fraction, held).otherwise(rest))
    ranked = rank_by_draw(df, id_col, seed, [label])
    cut = _round_half_up(F.col("stratum_size") * fraction)
    return (ranked.withColumn("split", F.when(F.col("draw_rank") <= cut, held).otherwise(rest))
            .drop("draw_rank", "stratum_size"))


def above_train_quantile(df: DataFrame, words, split="split", prob=0.25) -> DataFrame:
    """Drop train rows at or below the train quantile of a measure; other rows stay."""
    threshold = exact_quantiles(df.filter(F.col(split) == "train"), words, (prob,), names=["cut"])
    return df.filter((F.col(split) != "train") | (F.col(words) > threshold.select("cut").scalar()))


def expanding_windows(df: DataFrame, date, base=2003, last=2014, gap=3) -> DataFrame:
    """Rows of every expanding window: train base..Y, test Y + gap, for Y = base..last.

    A row is repeated only for the windows it belongs to.
    """
    y = F.year(date)
    windows = F.sequence(F.lit(base), F.lit(last))
    used = F.filter(windows, lambda w: y.between(F.lit(base), w) | (y == w + gap))
    return (df.withColumn("window_end", F.explode(used))
            .withColumn("split", F.when(y == F.col("window_end") + gap, "test").otherwise("train")))


def split_window_train(windowed: DataFrame, id_col, label, fraction=0.2, seed=42) -> DataFrame:
    """Stratified validation part inside the train rows of every window."""
    train = windowed.filter("split = 'train'")
    ranked = rank_by_draw(train, id_col, seed, ["window_end", label])
    cut = _round_half_up(F.col("stratum_size") * fraction)
    split = (ranked.withColumn("split", F.when(F.col("draw_rank") <= cut, "validation").otherwise("train"))
             .drop("draw_rank", "stratum_size"))
    return split.unionByName(windowed.filter("split <> 'train'"))


def ratio_pool(df: DataFrame, id_col, label, date, train_year=2003, seed=42) -> DataFrame:
    """Draw a later pool twice the train size per half, at the base rate, and halve it by class.

    Positives per half: floor(2 n rate + 1); the rest of 2 n are negatives (n train rows, rate over
    the whole table).
    """
    y = F.year(date)
    sizes = df.agg(F.count_if(y == train_year).alias("_n"), F.avg(label).alias("_rate"))
    sizes = sizes.select((2 * F.col("_n")).alias("_half"),
                         F.floor(2 * F.col("_n") * F.col("_rate") + 1).alias("_pos"))
    ranked = rank_by_draw(df.filter(y > train_year), id_col, seed, [label])
    want = F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.col("_half") - F.col("_pos"))
    take = F.least(2 * want, F.col("stratum_size"))
    drawn = (beside(ranked, sizes).withColumn("_take", take)
             .filter(F.col("draw_rank") <= F.col("_take")))
    return (drawn.withColumn("split", F.when(F.col("draw_rank") <= F.floor(F.col("_take") / 2), "validation")
                             .otherwise("test"))
            .drop("_half", "_pos", "_take", "draw_rank", "stratum_size"))


REVIEW_FIELDS = ["manual_category", "match_relevance", "review_confidence", "review_notes"]


def review_sample(scores: DataFrame, size=5, seed=42):
    """A blind review sheet and, apart from it, the predictions of the sampled chunks.

    Up to ``size`` chunks per company and category; the sheet order hides the category. The per
    stratum rank filter is pushed below the shuffle.
    """
    from filingsift.operators.novelty import SCORED_CATEGORIES
    scored = scores.filter(F.col("boilerplate_category").isin(SCORED_CATEGORIES) & F.col("max_similarity").isNotNull())
    order = Window.partitionBy("company", "boilerplate_category").orderBy(draw_key(seed, "chunk_id"), "chunk_id")
    drawn = scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size).drop("_r")
    ranked = rank_by_draw(drawn, "chunk_id", f"{seed}:sheet", rank="_pos").drop("stratum_size")
    digits = F.greatest(F.lit(3), F.length(F.col("_pos").cast("string")))
    ranked = ranked.withColumn("review_id", F.concat(F.lit("BR_"), F.lpad(F.col("_pos").cast("string"), digits, F.lit("0"))))
    sheet = ranked.select("review_id", "company", "filing_date", "reference_filing_date", "chunk_id", "chunk_text",
                          "matched_chunk_text", *[F.lit("").alias(f) for f in REVIEW_FIELDS])
    predictions = ranked.select("review_id", "chunk_id", "matched_chunk_id", "max_similarity", "novelty_score",
                                "boilerplate_category")
    return sheet, predictions


def hide_positives(df: DataFrame, id_col, label, hidden, seed=42, out="pu_label") -> DataFrame:
    """Mark ``hidden`` positives as unlabelled (0) in a new column; the true label stays.

    The cut is an exact draw rank, so hiding more always extends what hiding less hides.
    """
    ranked = rank_by_draw(df, id_col, seed, [label])
    kept = (F.col(label) == 1) & (F.col("draw_rank") > hidden)
    return ranked.withColumn(out, kept.cast("int")).drop("draw_rank", "stratum_size")


def shuffled_split(df: DataFrame, id_col, seed=42, exact=True, train_part=2.0 / 3.0) -> DataFrame:
    """A random two-thirds for training; exact size by draw rank, or a hash threshold."""
    if not exact:
        part = F.when(draw_fraction(seed, id_col) < train_part, "train").otherwise("validation")
        return df.withColumn("split", part)
    ranked = rank_by_draw(df, id_col, seed)
    cut = F.floor(F.lit(2) * F.col("stratum_size") / 3) if train_part == 2.0 / 3.0 else \
        F.floor(F.col("stratum_size") * train_part)
    return (ranked.withColumn("split", F.when(F.col("draw_rank") <= cut, "train").otherwise("validation"))
            .drop("draw_rank", "stratum_size"))


def split_summary(df: DataFrame, label, split="split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"),
                                 F.avg(label).alias("positive_ratio"))


def sample_fraction(df: DataFrame, id_col, fraction, seed=42) -> DataFrame:
    """A reproducible share of the rows, chosen by draw key without a shuffle."""
    return df.filter(draw_fraction(seed, id_col) < fraction)
