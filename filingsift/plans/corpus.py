"""Build the labelled corpus: filings of enforced firms, labelled, joined with the general filings."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.functions import fields, text as tx
from filingsift.operators import dedup, joins

# The identity of a filing row.
IDENTITY = ["cik", "name", "city", "state", "sic", "incorp_state", "filing_type", "fye", "filing_date",
            "reporting_date", "url", "mda"]


def label_rows(filings: DataFrame, enforcement: DataFrame, identity=None) -> DataFrame:
    """Filings of enforced firms with flags, releases and label; repeated negatives dropped."""
    flagged = filings.withColumns(fields.filing_flags())
    labelled = joins.label_filings(joins.attach_enforcement(flagged, enforcement))
    return dedup.drop_repeated_negatives(labelled, identity or [c for c in IDENTITY if c in filings.columns])


def add_general(labelled: DataFrame, general: DataFrame, identity=None) -> DataFrame:
    """Append the general filings that are not among the labelled ones, with label 0."""
    identity = identity or [c for c in IDENTITY if c in general.columns]
    flagged = general.withColumns(fields.filing_flags()).withColumn("fraudulent", F.lit(0))
    return joins.append_rows(labelled, joins.drop_known(flagged, labelled, identity))


def text_columns(df: DataFrame, text="mda", fixed_order=False) -> DataFrame:
    """Normalised text and its three length measures."""
    clean = df.withColumn(text, tx.normalize_mda(text, fixed_order))
    return clean.withColumns({"char_count": tx.char_count(text), "word_count": tx.word_count(text),
                              "word_density": tx.word_density(text)})


def analysis_rows(df: DataFrame, words="word_count", more_than=200) -> DataFrame:
    return df.filter((F.col(words) > more_than) & (F.col("amend_filing") == 0))


def valid_rows(df: DataFrame, text="mda", date="filing_date", label="fraudulent") -> DataFrame:
    """Rows with text, a date that parses and a label of 0 or 1 (converted to int)."""
    y = F.col(label).try_cast("double")
    day = F.col(date) if dict(df.dtypes)[date] == "date" else fields.parse_date(date)
    return (df.withColumn(date, day).withColumn(label, y)
            .filter(F.col(text).isNotNull() & F.col(date).isNotNull() & F.col(label).isin(0.0, 1.0))
            .withColumn(label, F.col(label).cast("int")))


def long_enough(df: DataFrame, text="mda", words="word_count", least=200) -> DataFrame:
    """Rows of at least ``least`` words, by the stored count if there is one."""
    if words in df.columns:
        return df.filter(F.col(words).try_cast("double") >= least)
    return df.filter(tx.word_count(text) >= least)


def build_corpus(labelled_filings, general_filings, enforcement, rewrites=None, overrides=None, key=None):
    """(whole corpus, analysis rows)."""
    rows = add_general(label_rows(labelled_filings, enforcement), general_filings)
    rows = text_columns(rows)
    if rewrites or overrides is not None:
        rows = fields.correct_industry(rows, rewrites or {}, overrides, key)
    return rows, analysis_rows(rows)
