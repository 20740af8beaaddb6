"""Metadata columns: filing types, dates, industry codes, identifiers, durations."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Industry divisions by two-digit group, inclusive bounds.
DIVISIONS = [
    (1, 9, "Division A"), (10, 14, "Division B"), (15, 17, "Division C"), (20, 39, "Division D"),
    (40, 49, "Division E"), (50, 51, "Division F"), (52, 59, "Division G"), (60, 67, "Division H"),
    (70, 89, "Division I"), (91, 97, "Division J"), (99, 99, "Division K"),
]


def filing_flags(filing_type="filing_type") -> dict[str, Column]:
    t = F.col(filing_type)
    return {
        "late_filing": (t == "10-K405").cast("int"),
        "transition_filing": t.startswith("10-KT").cast("int"),
        "amend_filing": t.endswith("/A").cast("int"),
    }


def fill_flags(df: DataFrame, cols) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def unknown_flags(df: DataFrame, id_col, ids, cols) -> DataFrame:
    """For the listed ids a flag of 0 means "not recorded": turn it back to null.

    ``ids`` is a short list of values, or a DataFrame holding ``id_col`` when the list is long.
    """
    if isinstance(ids, DataFrame):
        marked = df.join(ids.select(id_col).distinct().withColumn("_listed", F.lit(True)), id_col, "left")
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    else:
        marked, listed = df, F.col(id_col).isin(list(ids))
    return marked.withColumns(
        {c: F.when(F.coalesce(listed & (F.col(c) == 0), F.lit(False)), None).otherwise(F.col(c)) for c in cols}
    ).drop("_listed")


def parse_date(c, fmt="yyyy-MM-dd") -> Column:
    """Date in a known format, null when it does not parse."""
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, fmt)


def parse_timestamp_day(c) -> Column:
    """Day part of an ISO date-time text, null when it does not parse."""
    return parse_date(F.substring_index(c, "T", 1))


def month_start(c) -> Column:
    """``MM-yyyy`` text to the first day of the month."""
    return parse_date(F.concat(F.lit("01-"), F.col(c) if isinstance(c, str) else c), "dd-MM-yyyy")


def month_end(c) -> Column:
    return F.last_day(month_start(c))


def fiscal_year_end(c) -> Column:
    """``dd-MM`` text to a date in 1900, the year given to dates that have none."""
    return parse_date(F.concat(F.col(c) if isinstance(c, str) else c, F.lit("-1900")), "dd-MM-yyyy")


def add_year(c) -> Column:
    """Same calendar day one year later; 29 February becomes 28 February."""
    return F.add_months(c, 12)


def correct_industry(df: DataFrame, rewrites: dict, overrides: DataFrame, key, sic="sic") -> DataFrame:
    """Rewrite wrong industry codes by value, then by row key.

    ``overrides`` (None for none) holds (key, sic) for single rows; it wins over the rewrite. It is a curated list
    of corrections, yet nothing here assumes its size.
    """
    fixed = F.col(sic)
    for old, new in rewrites.items():
        fixed = F.when(F.col(sic) == old, F.lit(new)).otherwise(fixed)
    if overrides is None:
        return df.withColumn(sic, fixed)
    fix = overrides.select(F.col(key), F.col(sic).alias("_fix"))
    return (df.withColumn(sic, fixed).join(fix, key, "left")
            .withColumn(sic, F.coalesce("_fix", sic)).drop("_fix"))


def industry_group(sic="sic") -> Column:
    return F.substring(F.col(sic), 1, 2)


def industry_division(sic="sic") -> Column:
    group = industry_group(sic).try_cast("int")
    out = F.lit("Unknown")
    for low, high, name in reversed(DIVISIONS):
        out = F.when(group.between(low, high), F.lit(name)).otherwise(out)
    return out


def is_region_code(c) -> Column:
    """Two capital letters: a domestic state or territory code."""
    return F.col(c).rlike("^[A-Z]{2}$")


def differs(a, b) -> Column:
    """Not equal, where two nulls also count as different."""
    return ~F.col(a).eqNullSafe(F.col(b)) | (F.col(a).isNull() & F.col(b).isNull())


def enforcement_durations(start="fraud_start", end="fraud_end", released="release_date") -> dict[str, Column]:
    return {
        "fraud_duration": F.datediff(end, start),
        "detection_delay": F.datediff(released, start),
        "post_fraud_delay": F.datediff(released, end),
    }


def date_parts(df: DataFrame, cols, drop=()) -> DataFrame:
    """Replace each date by its year, month and day."""
    parts = {}
    for c in cols:
        parts[f"{c}_year"] = F.year(c)
        parts[f"{c}_month"] = F.month(c)
        parts[f"{c}_day"] = F.dayofmonth(c)
    return df.withColumns(parts).drop(*cols, *drop)


def filing_identifiers(cik="cik", accession="accession_number", document="primary_document",
                       filing_date="filing_date") -> dict[str, Column]:
    """Dashless accession number, composite id, archive address and year."""
    clean = F.replace(F.col(accession), F.lit("-"), F.lit(""))
    number = F.col(cik).try_cast("bigint").cast("string")
    return {
        "accession_clean": clean,
        "filing_key": F.concat_ws("_", F.col(cik), clean),
        "source_url": F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), number, F.lit("/"), clean,
                               F.lit("/"), F.col(document)),
        "year": F.substring(F.col(filing_date).cast("string"), 1, 4),
    }


def lookup_listed(df: DataFrame, listed: DataFrame, company, year: Column, listed_year) -> DataFrame:
    """Rows of the listed (company, year) pairs; the list may be long."""
    pairs = listed.select(F.col(company), F.col(listed_year).alias("_y")).distinct()
    return df.withColumn("_y", year).join(pairs, [company, "_y"], "left_semi").drop("_y")
