"""Aggregations, audit reports and descriptive statistics."""
import re

from pyspark.sql import functions as F

from filingsift.catalog.cleaning import DIVISION_SQL
from filingsift.catalog.joining import LABELLED_SQL, TEXT_SQL, is_test, is_train, labelled
from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import fields, text as tx
from filingsift.operators import audit, describe, sections

WORDS_SQL = "len(regexp_extract_all({c}, '[^\\s]+'))"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def v3_words(spark, sf):
    return view(spark, sf, "v3").withColumn("word_count", tx.word_count("mda"))


V3W = ", w as (select *, " + WORDS_SQL.format(c="mda") + " as word_count from v3)\n"


@query("e1_label_rate_by_year", LABELLED_SQL + """
select cast(year(reporting_date) as int) as year, count(fraudulent) as total, cast(sum(fraudulent) as bigint) as fraud,
  round(avg(fraudulent), 3) as fraud_rate from kept group by 1""", ["v1", "v2"])
def e1(spark, sf):
    return audit.yearly_labels(labelled(spark, sf), "reporting_date", digits=3)


@query("e2_value_counts", LABELLED_SQL + """
select state, count(*) as n, round(count(*) / (select count(*) from kept where state is not null), 6) as share from kept
where state is not null group by state""", ["v1", "v2"])
def e2(spark, sf):
    return rounded(describe.value_counts(labelled(spark, sf), "state"), "share")


@query("e2_top_and_bottom", LABELLED_SQL + """
, c as (select sic, count(*) as n from kept where sic is not null group by sic)
select * from (select 'top' as side, sic, n from c order by n desc, sic limit 20)
union all select * from (select 'bottom' as side, sic, n from c order by n, sic limit 20)""", ["v1", "v2"])
def e2_extremes(spark, sf):
    counts = describe.value_counts(labelled(spark, sf), "sic").select("sic", "n")
    return describe.extreme(counts, "n", 20, "sic").withColumn("side", F.lit("top")).unionByName(
        describe.extreme(counts, "n", 20, "sic", bottom=True).withColumn("side", F.lit("bottom")))


def gappy(spark, sf):
    i = F.col("filing_id")
    return view(spark, sf, "v1").select(
        "cik", F.when(i % 7 == 0, "").when(i % 7 == 1, "  \t").otherwise(F.col("city")).alias("city"), "sic",
        F.when(i % 5 != 0, F.col("amount")).alias("amount"))


GAPPY = """, g as (select cik, case when filing_id % 7 = 0 then '' when filing_id % 7 = 1 then '  ' || chr(9) else city end as city, sic,
  case when filing_id % 5 <> 0 then amount end as amount from v1)
"""


@query("e3_missingness", GAPPY + " union all ".join(f"""
select '{c}' as "column", count(*) filter ({c} is null) as null_nan, {e} as empty_string, {b} as whitespace_only,
  round(count(*) filter ({c} is null) * 100.0 / count(*), 6) as null_percent from g""" for c, e, b in [
    ("cik", "0", "0"), ("amount", "0", "0")] + [
    (c, f"count(*) filter ({c} is null or {c} = '')", f"count(*) filter (regexp_full_match({c}, '\\s+'))") for c in ("city", "sic")]), ["v1"])
def e3(spark, sf):
    return rounded(audit.missingness(gappy(spark, sf)), "null_percent")


@query("e4_critical_missingness", GAPPY + " union all ".join(
    f"""select '{c}' as "column", count(*) filter ({c} is null) as missing, round(count(*) filter ({c} is null) * 100.0 / count(*), 6) as null_percent from g
""" for c in ("cik", "sic", "amount")), ["v1"])
def e4(spark, sf):
    return rounded(audit.critical_missingness(gappy(spark, sf), ["cik", "sic", "amount"]), "null_percent")


@query("e5_class_distribution", """
, n as (select count(*) filter (fraudulent in (0, 1)) as valid_labels, count(*) filter (fraudulent = 0) as class_0,
  count(*) filter (fraudulent = 1) as class_1 from v3)
select *, round(class_0 * 100.0 / valid_labels, 6) as percent_0, round(class_1 * 100.0 / valid_labels, 6) as percent_1,
  round(class_0 / class_1, 6) as imbalance_ratio, cast(class_0 / class_1 >= 10 as int) as strong_imbalance from n""", ["v3"])
def e5(spark, sf):
    return rounded(audit.class_distribution(view(spark, sf, "v3")), "percent_0", "percent_1", "imbalance_ratio")


def stats_sql(col, source, by=""):
    keep = f"{by}, " if by else ""
    return f"""select {keep}count({col}) as "count", round(avg({col}), 6) as mean, round(stddev_samp({col}), 6) as std,
  round(min({col}), 6) as min, round(quantile_cont({col}, 0.25), 6) as q25, round(quantile_cont({col}, 0.5), 6) as q50,
  round(quantile_cont({col}, 0.75), 6) as q75, round(max({col}), 6) as max from {source} {'group by ' + by if by else ''}"""


STATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("e6_summary_stats", V3W + stats_sql("cast(word_count as double)", "w"), ["v3"])
def e6(spark, sf):
    return rounded(describe.summary_stats(v3_words(spark, sf), "word_count"), *STATS)


@query("e6_summary_stats_by_state", stats_sql("amount", "v1", "state"), ["v1"])
def e6_by(spark, sf):
    return rounded(describe.summary_stats(view(spark, sf, "v1"), "amount", ["state"]), *STATS)


@query("e7_length_percentiles", V3W + "select count(*) as n, " + ", ".join(
    f"round(quantile_cont(word_count, {p / 100}), 6) as p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " from w where word_count > 0", ["v3"])
def e7(spark, sf):
    out = audit.length_percentiles(v3_words(spark, sf), "word_count")
    return rounded(out, *[c for c in out.columns if c != "n"])


@query("e8_short_long_counts", V3W + """select count(*) filter (word_count > 0 and word_count < 200) as short_documents,
  count(*) filter (word_count > 2000) as long_documents from w""", ["v3"])
def e8(spark, sf):
    return audit.short_long_counts(v3_words(spark, sf), "word_count", 200, 2000)


@query("e8_short_and_long_documents", V3W + """
select 'short' as kind, doc_id, word_count from w where word_count > 0 and word_count < 200
union all select 'long' as kind, doc_id, word_count from w where word_count > 2000""", ["v3"])
def e8_rows(spark, sf):
    rows = v3_words(spark, sf).select("doc_id", "word_count")
    return (audit.short_documents(rows, "word_count").withColumn("kind", F.lit("short"))
            .unionByName(audit.long_documents(rows, "word_count", 2000).withColumn("kind", F.lit("long"))))


def unicode_words(pattern):
    """The pattern with word boundaries spelled out: RE2 knows them for ASCII only."""
    letters = r"\p{L}\p{N}_"
    opened = re.sub(r"\\b(?=[A-Za-z(])", lambda _: rf"(?:^|[^{letters}])", pattern)
    return opened.replace(r"\b", rf"(?:[^{letters}]|$)")


def report_sql(name, patterns, source, text, fields_sql):
    quoted = {n: p.replace("'", "''") for n, p in patterns.items()}
    return " union all ".join(f"select '{n}' as {name}, " + fields_sql.format(m=f"regexp_matches({text}, '{p}')") + f" from {source}"
                              for n, p in quoted.items())


@query("e9_artifact_report", report_sql("artifact", {k: unicode_words(p.replace("(?iU)", "(?i)")) for k, p in audit.ARTIFACT_PATTERNS.items()}, "pages", "html",
                                        "count(*) filter ({m}) as documents, round(count(*) filter ({m}) * 100.0 / count(*), 6) as percentage"))
def e9(spark, sf):
    return rounded(audit.artifact_report(table(spark, sf, "pages"), "html"), "percentage")


RATIO_SQL = "(length({c}) - length(regexp_replace({c}, '{p}', '', 'g')))"


@query("e10_encoding_report", """
, r as (select case when length(mda) > 0 then """ + RATIO_SQL.format(c="mda", p="[^\\x00-\\x7F]") + """ / length(mda) else 0 end as r from v3)
select count(*) filter (r > 0) as any_non_ascii, count(*) filter (r > 0.01) as many_non_ascii from r""", ["v3"])
def e10(spark, sf):
    return audit.encoding_report(view(spark, sf, "v3"), "mda")


@query("e11_uppercase_ratio", """
, r as (select doc_id, """ + RATIO_SQL.format(c="mda", p="\\p{Lu}") + " as u, " + RATIO_SQL.format(c="mda", p="\\p{L}") + """ as l from v3)
select doc_id, round(case when l > 0 then u / l else 0 end, 6) as ratio, cast(l > 0 and u > 0.5 * l as int) as shouting from r""", ["v3"])
def e11(spark, sf):
    r = tx.uppercase_ratio("mda")
    return view(spark, sf, "v3").select("doc_id", F.round(r, 6).alias("ratio"), (r > 0.5).cast("int").alias("shouting"))


MARKER_LIST = ", ".join(f"'{w}'" for w in tx.ENGLISH_MARKERS)
ENGLISH_SQL = (""", x as (select *, regexp_extract_all(lower(mda), '[a-z]+') as ws, """ + WORDS_SQL.format(c="mda") + """ as word_count from v3),
i as (select *, case when len(ws) > 0 then len(list_filter(ws, lambda q: q in (""" + MARKER_LIST + """))) / len(ws) else 0 end as r from x)
""")


@query("e12_english_indicator", ENGLISH_SQL + """
select doc_id, round(r, 6) as english_indicator, cast(word_count >= 50 and r < 0.005 as int) as suspect from i""", ["v3"])
def e12(spark, sf):
    r = tx.english_indicator("mda")
    return view(spark, sf, "v3").select("doc_id", F.round(r, 6).alias("english_indicator"),
                                        ((tx.word_count("mda") >= 50) & (r < 0.005)).cast("int").alias("suspect"))


@query("e12_language_suspects", ENGLISH_SQL + "select doc_id, round(r, 6) as english_indicator from i where word_count >= 50 and r < 0.005", ["v3"])
def e12_rows(spark, sf):
    return rounded(audit.language_suspects(view(spark, sf, "v3"), "mda").select("doc_id", "english_indicator"), "english_indicator")


# words of the fixture languages in the role of the leakage terms
FIXTURE_TERMS = {"the": r"\bthe\b", "der": r"\bder\b|\bdie\b", "que": r"\bque\b", "ing": r"\bing(?:and|the)?\b", "absent": r"\brestated\b"}


@query("e13_leakage_report", report_sql("term", {k: "(?i)" + unicode_words(p) for k, p in FIXTURE_TERMS.items()}, "v3", "mda",
                                        "count(*) filter ({m}) as total_documents, count(*) filter ({m} and fraudulent = 1) as fraud_documents, "
                                        "count(*) filter ({m} and fraudulent = 0) as nonfraud_documents"), ["v3"])
def e13(spark, sf):
    return audit.leakage_report(view(spark, sf, "v3"), "mda", terms=FIXTURE_TERMS)


@query("e13_leakage_report_default_terms", report_sql("term", {k: "(?i)" + unicode_words(p) for k, p in audit.LEAKAGE_TERMS.items()}, "v3", "mda",
                                                      "count(*) filter ({m}) as total_documents, count(*) filter ({m} and fraudulent = 1) as fraud_documents, "
                                                      "count(*) filter ({m} and fraudulent = 0) as nonfraud_documents"), ["v3"])
def e13_default(spark, sf):
    return audit.leakage_report(view(spark, sf, "v3"), "mda")


@query("e14_audit_summary", TEXT_SQL.rstrip() + """,
x as (select *, len(regexp_extract_all(mda, '[^\\s]+')) as wc, regexp_extract_all(lower(mda), '[a-z]+') as ws from t),
d as (select *, count(*) over (partition by cik, state, mda, fraudulent) as same from t),
dup as (select norm, count(*) as n, count(distinct fraudulent) as k, max(cast(y <= 2017 as int)) as seen,
  count(*) filter (y between 2018 and 2023) as n_test from t where norm <> '' group by norm)
select 'dataset_rows' as "check", count(*) as value from t union all select 'dataset_columns', 4
union all select 'missing_mda', count(*) from t where mda is null
union all select 'fraud_count', count(*) from t where fraudulent = 1 union all select 'nonfraud_count', count(*) from t where fraudulent = 0
union all select 'exact_duplicate_rows', count(*) from d where same > 1
union all select 'duplicate_text_rows', coalesce(sum(n), 0) from dup where n > 1
union all select 'conflicting_label_duplicate_rows', coalesce(sum(n), 0) from dup where k > 1
union all select 'short_documents', count(*) from x where wc > 0 and wc < 200
union all select 'very_long_documents', count(*) from x where wc > 20000
union all select 'possible_language_issues', count(*) from x where wc >= 50 and
  case when len(ws) > 0 then len(list_filter(ws, lambda q: q in (""" + MARKER_LIST + """))) / len(ws) else 0 end < 0.005
union all select 'train_test_duplicate_text_rows', coalesce(sum(n_test), 0) from dup where seen = 1""", ["v3"])
def e14(spark, sf):
    rows = view(spark, sf, "v3").withColumn("y", F.year("filing_date")).select("cik", "state", "mda", "fraudulent", "y")
    # the year only serves the split and is not a column of the corpus
    year = F.col("y")
    return audit.audit_summary(rows, "mda", "fraudulent", year <= 2017, year.between(2018, 2023),
                               columns=["cik", "state", "mda", "fraudulent"])


DIMENSIONS = ["city", "state", "incorp_state", "sic", "sic2", "division"]
DIMS_SQL = LABELLED_SQL + f", dims as (select *, left(sic, 2) as sic2, {DIVISION_SQL} as division from kept)\n"


def dims(spark, sf):
    return labelled(spark, sf).withColumns({"sic2": fields.industry_group(), "division": fields.industry_division()})


@query("e15_distinct_companies", DIMS_SQL + " union all ".join(f"""select * from (select '{d}' as dimension, {d} as value,
  count(distinct cik) as companies from dims where {d} is not null group by {d} order by companies desc, value limit 20)""" for d in DIMENSIONS),
       ["v1", "v2"])
def e15(spark, sf):
    return describe.top_per_dimension(describe.distinct_companies(dims(spark, sf), DIMENSIONS), "companies", 20)


@query("e16_group_sizes", DIMS_SQL + " union all ".join(f"""select '{d}' as dimension, count(*) as groups, max(n) as max, min(n) as min,
  round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, round(quantile_cont(n, 0.5), 6) as median
  from (select {d}, count(*) as n from dims where {d} is not null group by {d})""" for d in ("cik", "sic", "sic2")), ["v1", "v2"])
def e16(spark, sf):
    return rounded(describe.group_size_summary(dims(spark, sf), ["cik", "sic", "sic2"]), "mean", "std", "median")


@query("e17_distinct_counts", LABELLED_SQL + """
select count(distinct cik) as n_cik, count(distinct city) as n_city, count(distinct state) as n_state from kept""", ["v1", "v2"])
def e17(spark, sf):
    return describe.distinct_counts(labelled(spark, sf), ["cik", "city", "state"])


@query("e18_label_rate_by_dimension", DIMS_SQL + " union all ".join(f"""select '{d}' as dimension, {d} as value,
  cast(sum(fraudulent) as bigint) as fraud_count, count(fraudulent) as total_count, round(sum(fraudulent) / count(fraudulent), 6) as fraud_rate
  from dims where {d} is not null group by {d} having count(fraudulent) >= 10""" for d in DIMENSIONS), ["v1", "v2"])
def e18(spark, sf):
    return rounded(describe.label_rates(dims(spark, sf), DIMENSIONS, min_total=10), "fraud_rate")


@query("e18_top_rates_and_counts", DIMS_SQL + """
, r as (select sic, cast(sum(fraudulent) as bigint) as fraud_count, count(fraudulent) as total_count,
  sum(fraudulent) / count(fraudulent) as fraud_rate from dims where sic is not null group by sic)
select * from (select 'rate' as by_what, sic, fraud_count, total_count, round(fraud_rate, 6) as fraud_rate from r where total_count >= 10
  order by r.fraud_rate desc, sic limit 10)
union all select * from (select 'count' as by_what, sic, fraud_count, total_count, round(fraud_rate, 6) as fraud_rate from r
  order by fraud_count desc, sic limit 10)""", ["v1", "v2"])
def e18_top(spark, sf):
    rates = describe.label_rates(dims(spark, sf), ["sic"])
    by_rate = describe.top_per_dimension(rates.filter("total_count >= 10"), "fraud_rate", 10).withColumn("by_what", F.lit("rate"))
    by_count = describe.top_per_dimension(rates, "fraud_count", 10).withColumn("by_what", F.lit("count"))
    out = by_rate.unionByName(by_count).drop("dimension").withColumnRenamed("value", "sic")
    return rounded(out, "fraud_rate")


@query("e19_yearly_volume", V3W + """
select cast(year(filing_date) as int) as year, cast(sum(fraudulent) as bigint) as fraudulent_count, count(fraudulent) as total_count,
  round(avg(word_count), 6) as mean_word_count, round(quantile_cont(word_count, 0.5), 6) as median_word_count from w group by 1""", ["v3"])
def e19(spark, sf):
    return rounded(describe.yearly_volume(v3_words(spark, sf), "filing_date", "fraudulent", "word_count"), "mean_word_count", "median_word_count")


@query("e20_label_pivot", LABELLED_SQL + """
select cast(year(reporting_date) as int) as year, count(*) filter (fraudulent = 0) as label_0, count(*) filter (fraudulent = 1) as label_1,
  round(count(*) filter (fraudulent = 1) / count(*), 6) as fraud_ratio from kept group by 1""", ["v1", "v2"])
def e20(spark, sf):
    return rounded(describe.label_pivot(labelled(spark, sf).withColumn("year", F.year("reporting_date")), "year"), "fraud_ratio")


FLAGS = ["v_10b", "v_13a", "v_17a", "corruption", "amis", "fsf"]
EARLY = ", e as (select * from v2 where release_date - fraud_end >= 0)\n"


def on_time(spark, sf):
    return describe.drop_early_releases(view(spark, sf, "v2"))


@query("e21_indicator_totals", EARLY + " union all ".join(
    f"select '{f}' as indicator, cast(sum({f}) as bigint) as total from e" for f in FLAGS), ["v2"])
def e21(spark, sf):
    return describe.indicator_totals(on_time(spark, sf), FLAGS)


@query("e22_flag_overlap", EARLY + """select corruption, amis, fsf, count(*) as n from e
where corruption + amis + fsf > 0 group by 1, 2, 3""", ["v2"])
def e22(spark, sf):
    return describe.flag_overlap(on_time(spark, sf), ["corruption", "amis", "fsf"])


@query("e23_certainty_counts", EARLY + " union all ".join(
    f"select '{n}' as bound, count(*) filter ({c} = 0) as uncertain, count(*) filter ({c} = 1) as certain from e"
    for n, c in (("start", "certainty_start"), ("end", "certainty_end"))), ["v2"])
def e23(spark, sf):
    return describe.certainty_counts(on_time(spark, sf), {"start": "certainty_start", "end": "certainty_end"})


@query("e24_rows_at_maximum", """
select aaer_id, cast(fraud_end - fraud_start as int) as fraud_duration from v2
where fraud_end - fraud_start = (select max(fraud_end - fraud_start) from v2)""", ["v2"])
def e24(spark, sf):
    rows = view(spark, sf, "v2").withColumns(fields.enforcement_durations())
    return describe.rows_at_maximum(rows, "fraud_duration").select("aaer_id", "fraud_duration")


@query("e25_crosstab", LABELLED_SQL + """
select state, """ + ", ".join(f"""count(*) filter (city = '{c}') as "{c}" """ for c in
                              ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + "from kept group by state", ["v1", "v2"])
def e25(spark, sf):
    return describe.crosstab(labelled(spark, sf), "state", "city", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("e28_histogram", V3W + """
, m as (select min(word_count) as lo, max(word_count) as hi from w), s as (select lo, hi, (hi - lo) / 30 as step from m),
c as (select least(floor((word_count - lo) / step), 29) as b, count(*) as n from w, s group by 1)
select cast(b as int) as bin, round(lo + b * step, 6) as low, round(lo + (b + 1) * step, 6) as high, coalesce(c.n, 0) as n
from s, range(30) r(b) left join c using (b)""", ["v3"])
def e28(spark, sf):
    return rounded(describe.histogram(v3_words(spark, sf), "word_count", 30), "low", "high")


@query("e29_box_summary", """
, d as (select cast(release_date - fraud_start as double) as x from v2),
q as (select quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q75 from d),
b as (select *, q25 - 1.5 * (q75 - q25) as lo, q75 + 1.5 * (q75 - q25) as hi from q)
select q25, median, q75, min(x) filter (x between lo and hi) as whisker_low, max(x) filter (x between lo and hi) as whisker_high,
  count(*) filter (not (x between lo and hi)) as outliers from b, d group by q25, median, q75""", ["v2"])
def e29(spark, sf):
    return describe.box_summary(view(spark, sf, "v2").withColumns(fields.enforcement_durations()), "detection_delay")


@query("e30_class_weights", """
select fraudulent, count(*) as n_class, round((select count(*) from v3) / (2.0 * count(*)), 6) as weight from v3 group by fraudulent""", ["v3"])
def e30(spark, sf):
    return rounded(describe.class_weights(view(spark, sf, "v3"), "fraudulent"), "weight")


@query("e30_row_weights", """
, c as (select fraudulent, (select count(*) from v3) / (2.0 * count(*)) as weight from v3 group by fraudulent)
select doc_id, round(weight, 6) as weight from v3 join c using (fraudulent)""", ["v3"])
def e30_rows(spark, sf):
    return rounded(describe.with_class_weights(view(spark, sf, "v3"), "fraudulent").select("doc_id", "weight"), "weight")
