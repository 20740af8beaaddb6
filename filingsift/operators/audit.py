"""Data-quality reports. Each report is one pass over the table, whatever the number of columns or
patterns it checks."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions import text as tx
from filingsift.operators.dedup import with_text_key
from filingsift.operators.ranks import exact_quantiles

# Patterns of text that extraction should not have left behind.
ARTIFACT_PATTERNS = {
    "html_tags": r"<[^>]+>",
    "html_entities": r"&(?:amp|lt|gt|quot|nbsp|#\d+);",
    "urls": rf"https?://{tx.NON_SPACE}+|www\.{tx.NON_SPACE}+",
    "markdown_links": r"\[[^\]]+\]\([^)]+\)",
    "markdown_headers": rf"(?m)^{tx.SPACE}*#{{1,6}}{tx.SPACE}+",
    "possible_logs": r"(?iU)\b(?:error|exception|traceback|stack trace)\b",
    "mojibake": r"(?:Ã.|Â.|â€|â€™|â€œ|â€|ï¿½)",
    "replacement_character": "�",
}

# Terms that would give the label away if a later event put them into the text.
LEAKAGE_TERMS = {
    "fraud": r"\bfraud(?:ulent)?\b",
    "sec_enforcement": r"\benforcement action\b",
    "aaer": r"\bAAER\b",
    "restatement": r"\brestatement\b|\brestated\b",
    "investigation": r"\binvestigation\b|\binvestigated\b",
    "securities_exchange_commission": r"\bsecurities and exchange commission\b",
    "accounting_irregularity": r"\baccounting irregularit(?:y|ies)\b",
}


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def unfold(row: DataFrame, names, fields, key) -> DataFrame:
    """One wide aggregate row to one row per name; column ``i_field`` holds field of names[i]."""
    items = [F.struct(F.lit(n).alias(key), *[F.col(f"{i}_{f}").alias(f) for f in fields])
             for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def missingness(df: DataFrame, cols=None) -> DataFrame:
    """Per column: nulls, empty strings (nulls included), white-space-only strings, null percent."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs.append(F.count_if(v.isNull()).alias(f"{i}_null_nan"))
        if types[c] == "string":
            aggs.append(F.count_if(v.isNull() | (v == "")).alias(f"{i}_empty_string"))
            aggs.append(F.count_if(v.rlike(f"^{tx.SPACE}+$")).alias(f"{i}_whitespace_only"))
        else:
            aggs += [F.lit(0).cast("bigint").alias(f"{i}_empty_string"),
                     F.lit(0).cast("bigint").alias(f"{i}_whitespace_only")]
        aggs.append(percent(F.count_if(v.isNull()), F.count(F.lit(1))).alias(f"{i}_null_percent"))
    return unfold(df.agg(*aggs), cols, ["null_nan", "empty_string", "whitespace_only", "null_percent"], "column")


def critical_missingness(df: DataFrame, cols) -> DataFrame:
    return missingness(df.select(*cols), cols).select("column", F.col("null_nan").alias("missing"), "null_percent")


def class_distribution(df: DataFrame, label="fraudulent", warn_at=10.0) -> DataFrame:
    y = F.col(label).try_cast("double")
    row = df.agg(F.count_if(y.isin(0.0, 1.0)).alias("valid_labels"),
                 F.count_if(y == 0).alias("class_0"), F.count_if(y == 1).alias("class_1"))
    ratio = F.when(F.col("class_1") > 0, F.col("class_0") / F.col("class_1"))
    return (row.withColumn("percent_0", percent(F.col("class_0"), F.col("valid_labels")))
            .withColumn("percent_1", percent(F.col("class_1"), F.col("valid_labels")))
            .withColumn("imbalance_ratio", ratio)
            .withColumn("strong_imbalance", F.coalesce(ratio >= warn_at, F.lit(False)).cast("int")))


def length_percentiles(df: DataFrame, words, probs=(0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99), approximate=False) -> DataFrame:
    """Percentiles of the non-empty lengths; exact, or from a sketch in a single pass."""
    names = [f"p{int(round(p * 100))}" for p in probs]
    if approximate:
        row = df.filter(F.col(words) > 0).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(words, list(probs), 10000).alias("p"))
        return row.select("n", *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return exact_quantiles(df.filter(F.col(words) > 0), words, probs, names=names)


def short_documents(df: DataFrame, words, under=200) -> DataFrame:
    return df.filter((F.col(words) > 0) & (F.col(words) < under))


def long_documents(df: DataFrame, words, over=20000) -> DataFrame:
    return df.filter(F.col(words) > over)


def short_long_counts(df: DataFrame, words, under=200, over=20000) -> DataFrame:
    w = F.col(words)
    return df.agg(F.count_if((w > 0) & (w < under)).alias("short_documents"),
                  F.count_if(w > over).alias("long_documents"))


def artifact_report(df: DataFrame, text, patterns=None) -> DataFrame:
    """Documents that match each pattern, and their percentage."""
    patterns = patterns or ARTIFACT_PATTERNS
    t = F.col(text)
    aggs = []
    for i, p in enumerate(patterns.values()):
        aggs.append(F.count_if(t.rlike(p)).alias(f"{i}_documents"))
        aggs.append(percent(F.count_if(t.rlike(p)), F.count(F.lit(1))).alias(f"{i}_percentage"))
    return unfold(df.agg(*aggs), list(patterns), ["documents", "percentage"], "artifact")


def leakage_report(df: DataFrame, text, label="fraudulent", terms=None) -> DataFrame:
    """Per term: documents that contain it, in total and per label. Matching ignores case."""
    terms = terms or LEAKAGE_TERMS
    y = F.col(label).try_cast("double")
    # every pattern is matched once per document, then counted under three conditions
    flagged = df.select(y.alias("_y"), *[
        F.coalesce(F.col(text).rlike("(?iU)" + p), F.lit(False)).alias(f"_m{i}") for i, p in enumerate(terms.values())])
    aggs = []
    for i in range(len(terms)):
        m = F.col(f"_m{i}")
        aggs += [F.count_if(m).alias(f"{i}_total_documents"),
                 F.count_if(m & (F.col("_y") == 1)).alias(f"{i}_fraud_documents"),
                 F.count_if(m & (F.col("_y") == 0)).alias(f"{i}_nonfraud_documents")]
    return unfold(flagged.agg(*aggs), list(terms),
                  ["total_documents", "fraud_documents", "nonfraud_documents"], "term")


def encoding_report(df: DataFrame, text, over=0.01) -> DataFrame:
    r = df.select(tx.non_ascii_ratio(text).alias("r"))
    return r.agg(F.count_if(F.col("r") > 0).alias("any_non_ascii"),
                 F.count_if(F.col("r") > over).alias("many_non_ascii"))


def language_suspects(df: DataFrame, text, min_words=50, below=0.005, markers=tx.ENGLISH_MARKERS,
                      max_words=None) -> DataFrame:
    """Documents long enough to judge with hardly any English marker words, and their indicator."""
    return (df.withColumn("english_indicator", tx.english_indicator(text, markers, max_words))
            .filter((tx.word_count(text) >= min_words) & (F.col("english_indicator") < below)))


def yearly_labels(df: DataFrame, date, label="fraudulent", digits=None) -> DataFrame:
    """Per year: non-null labels, positives and their rate."""
    rate = F.avg(label)
    return (df.withColumn("year", F.year(date)).filter(F.col("year").isNotNull()).groupBy("year")
            .agg(F.count(label).alias("total"), F.sum(label).alias("fraud"),
                 (F.round(rate, digits) if digits is not None else rate).alias("fraud_rate")))


def audit_summary(df: DataFrame, text, label, is_train: Column, is_test: Column,
                  short=200, long=20000, markers=tx.ENGLISH_MARKERS, columns=None) -> DataFrame:
    """Twelve checks of one corpus.

    Two aggregations cover them: one scan for the per-row checks, and the identity hashes grouped
    once for rows and once for texts. Nothing but counts meets in the end.
    """
    from filingsift.functions.keys import row_key
    from filingsift.session import materialize
    words = tx.word_count(text)
    indicator = tx.english_indicator(text, markers)
    y = F.col(label).try_cast("double")
    columns = list(columns or df.columns)
    slim = with_text_key(df, text).select(
        row_key(*columns).alias("row_key"), "text_key", F.col(label).alias("_label"), y.alias("_y"),
        F.col(text).isNull().alias("_missing"), words.alias("_words"),
        (is_train).alias("_train"), (is_test).alias("_test"),
        ((words >= 50) & (indicator < 0.005)).alias("_suspect"))
    # hashes and flags only: the texts are read and normalised once
    slim = materialize(slim, "audit")
    w = F.col("_words")
    rows = slim.agg(
        F.count(F.lit(1)).alias("dataset_rows"), F.lit(len(columns)).cast("bigint").alias("dataset_columns"),
        F.count_if("_missing").alias("missing_mda"),
        F.count_if(F.col("_y") == 1).alias("fraud_count"), F.count_if(F.col("_y") == 0).alias("nonfraud_count"),
        F.count_if((w > 0) & (w < short)).alias("short_documents"),
        F.count_if(w > long).alias("very_long_documents"),
        F.count_if("_suspect").alias("possible_language_issues"))
    repeated = F.when(F.col("n") > 1, F.col("n"))
    exact = (slim.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
             .agg(F.coalesce(F.sum(repeated), F.lit(0)).alias("exact_duplicate_rows")))
    texts = (slim.filter("text_key is not null").groupBy("text_key")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_label").alias("lo"), F.max("_label").alias("hi"),
                  F.max("_train").alias("seen"), F.count_if("_test").alias("n_test"))
             .agg(F.coalesce(F.sum(repeated), F.lit(0)).alias("duplicate_text_rows"),
                  F.coalesce(F.sum(F.when(F.col("lo") != F.col("hi"), F.col("n"))), F.lit(0))
                  .alias("conflicting_label_duplicate_rows"),
                  F.coalesce(F.sum(F.when(F.col("seen"), F.col("n_test"))), F.lit(0))
                  .alias("train_test_duplicate_text_rows")))
    checks = []
    for part in (rows, exact, texts):
        items = [F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("value")) for c in part.columns]
        checks.append(part.select(F.explode(F.array(*items)).alias("r")).select("r.*"))
    return checks[0].unionByName(checks[1]).unionByName(checks[2])
