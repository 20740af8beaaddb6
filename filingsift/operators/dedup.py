"""Duplicates, uniqueness and conservation checks.

Identity is a 256-bit hash, so no shuffle carries long texts for comparison. Copies are counted with
map-side partial aggregation before any join, and the joins that bring counts back are equi-joins
whose hot partitions AQE splits.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.keys import row_key
from filingsift.functions.text import normalize_for_duplicates


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def drop_repeated_negatives(df: DataFrame, keys, label="fraudulent") -> DataFrame:
    """Remove every negative row whose identity occurs more than once, positives counted too."""
    keyed = df.withColumn("_key", row_key(*keys))
    repeated = _repeated(keyed, "_key").select("_key", F.lit(True).alias("_repeated"))
    return (keyed.join(repeated, "_key", "left")
            .filter((F.col(label) != 0) | F.col(label).isNull() | F.col("_repeated").isNull())
            .drop("_key", "_repeated"))


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """All rows that agree with another row on every column, with the number of copies."""
    keyed = df.withColumn("_key", row_key(*(cols or df.columns)))
    return keyed.join(_repeated(keyed, "_key"), "_key").drop("_key")


def duplicate_share(df: DataFrame, cols=None) -> DataFrame:
    """Rows in exact duplicates and their percentage: one aggregate over the identity hash."""
    groups = df.groupBy(row_key(*(cols or df.columns)).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("rows")) \
        .withColumn("percent", F.when(F.col("rows") > 0, F.col("duplicate_rows") * 100.0 / F.col("rows"))
                    .otherwise(F.lit(0.0)))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; null equals null. Grouped by the columns themselves, with nothing carried."""
    return df.dropDuplicates()


def with_text_key(df: DataFrame, text, key="text_key") -> DataFrame:
    """Hash of the normalised text; null where nothing is left of it."""
    norm = normalize_for_duplicates(text)
    return df.withColumn("_norm", norm).withColumn(
        key, F.when(F.col("_norm") != "", F.sha2("_norm", 256))).drop("_norm")


def duplicate_text_rows(keyed: DataFrame, key="text_key") -> DataFrame:
    """Rows whose non-empty normalised text occurs in another row."""
    present = keyed.filter(F.col(key).isNotNull())
    return present.join(_repeated(present, key), key)


def conflicting_label_rows(keyed: DataFrame, label="fraudulent", key="text_key") -> DataFrame:
    """Rows whose normalised text carries more than one label."""
    present = keyed.filter(F.col(key).isNotNull())
    conflicts = (present.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
                 .filter(F.col("_lo") != F.col("_hi")).select(key))
    return present.join(conflicts, key, "left_semi")


def leaked_rows(keyed: DataFrame, is_train: Column, is_test: Column, key="text_key") -> DataFrame:
    """Test rows whose normalised text occurs in train."""
    train = keyed.filter(is_train & F.col(key).isNotNull()).select(key).distinct()
    return keyed.filter(is_test & F.col(key).isNotNull()).join(train, key, "left_semi")


def leak_share(keyed: DataFrame, is_train: Column, is_test: Column, key="text_key") -> DataFrame:
    """Leaked test rows, test rows and the percentage; a single aggregation per text."""
    groups = keyed.groupBy(key).agg(F.max(is_train.cast("int")).alias("seen"),
                                    F.count_if(is_test).alias("n_test"))
    leaked = F.when((F.col("seen") == 1) & F.col(key).isNotNull(), F.col("n_test")).otherwise(0)
    return groups.agg(F.coalesce(F.sum(leaked), F.lit(0)).alias("leaked_rows"),
                      F.coalesce(F.sum("n_test"), F.lit(0)).alias("test_rows")) \
        .withColumn("percent", F.when(F.col("test_rows") > 0, F.col("leaked_rows") * 100.0 / F.col("test_rows"))
                    .otherwise(F.lit(0.0)))


def earliest_filings(filings: DataFrame, company, accession, filing_date, form, years, limit,
                     wanted_form="10-K") -> DataFrame:
    """The first ``limit`` filings of a form per company within a range of years.

    An accession number counts once. Both rank filters are pushed below their shuffle, so each task
    passes on at most ``limit`` rows per company and a dominant company never meets in one task.
    """
    low, high = years
    kept = (filings.filter(F.col(form) == wanted_form)
            .filter(F.col(filing_date).between(F.make_date(F.lit(low), F.lit(1), F.lit(1)),
                                               F.make_date(F.lit(high), F.lit(12), F.lit(31)))))
    copies = Window.partitionBy(company, accession).orderBy(filing_date)
    kept = kept.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= 1).drop("_copy")
    order = Window.partitionBy(company).orderBy(filing_date, accession)
    return kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def key_offenders(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, keys) -> DataFrame:
    if not key_offenders(df, keys).isEmpty():
        raise ValueError(f"duplicate values in {', '.join(keys)}")
    return df


def conservation_report(inputs: DataFrame, outputs: DataFrame, key, in_words: Column, out_words: Column) -> DataFrame:
    """Do the outputs represent every input key, and were any words lost?"""
    a = inputs.groupBy(key).agg(F.sum(in_words).alias("wi"))
    b = outputs.groupBy(key).agg(F.sum(out_words).alias("wo"), F.count(F.lit(1)).alias("pieces"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("wi").isNotNull()).alias("input_keys"),
        F.count_if(F.col("wo").isNotNull()).alias("output_keys"),
        F.count_if(F.col("wo").isNull()).alias("missing_keys"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("output_rows"),
        F.coalesce(F.sum("wi"), F.lit(0)).alias("input_words"),
        F.coalesce(F.sum("wo"), F.lit(0)).alias("output_words")) \
        .withColumn("words_lost", F.col("input_words") - F.col("output_words"))
