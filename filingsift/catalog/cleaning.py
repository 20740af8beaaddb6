"""Projection, cleaning, predicates."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import fields, text as tx
from filingsift.operators import vectors
from filingsift.plans import corpus
from filingsift.sources import tables as src

# the markup rules of the library in a form RE2 accepts (no possessive quantifiers, no back references)
STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
  '<[A-Za-z/!?](?:[^"''>]|"[^"]*"|''[^'']*'')*>', '', 'g')"""
DECODED = """replace(replace(replace(replace(replace({c}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', chr(1)),
  chr(1), '&')"""
VISIBLE = DECODED.format(c=STRIPPED.format(c="{c}"))


def v1(spark, sf):
    return view(spark, sf, "v1")


@query("b1_filing_type_flags", """
select filing_id, cast(filing_type = '10-K405' as int) as late_filing, cast(filing_type like '10-KT%' as int) as transition_filing,
  cast(filing_type like '%/A' as int) as amend_filing from v1""", ["v1"])
def b1(spark, sf):
    return v1(spark, sf).select("filing_id", *[c.alias(n) for n, c in fields.filing_flags().items()])


HOLES = """select aaer_id, case when aaer_id % 4 = 0 then null else v_10b end as v_10b,
  case when aaer_id % 3 = 0 then null else v_13a end as v_13a, corruption from v2"""


def with_holes(spark, sf):
    i = F.col("aaer_id")
    return view(spark, sf, "v2").select("aaer_id", F.when(i % 4 != 0, F.col("v_10b")).alias("v_10b"),
                                        F.when(i % 3 != 0, F.col("v_13a")).alias("v_13a"), "corruption")


@query("b2_fill_flags", f""", h as ({HOLES})
select aaer_id, cast(coalesce(v_10b, 0) as int) as v_10b, cast(coalesce(v_13a, 0) as int) as v_13a, corruption from h""", ["v2"])
def b2(spark, sf):
    return fields.fill_flags(with_holes(spark, sf), ["v_10b", "v_13a"])


@query("b3_unknown_flags", """
select aaer_id, case when aaer_id % 5 = 0 and v_10b = 0 then null else v_10b end as v_10b,
  case when aaer_id % 5 = 0 and v_17a = 0 then null else v_17a end as v_17a, corruption from v2""", ["v2"])
def b3(spark, sf):
    rows = view(spark, sf, "v2").select("aaer_id", "v_10b", "v_17a", "corruption")
    listed = rows.filter(F.col("aaer_id") % 5 == 0).select("aaer_id")
    return fields.unknown_flags(rows, "aaer_id", listed, ["v_10b", "v_17a"])


@query("b4_parse_dates", """
, t as (select filing_id, case when filing_id % 10 = 0 then 'unknown' when filing_id % 10 = 1 then '31-02-2004'
    else strftime(filing_date, '%d-%m-%Y') end as day_text,
  case when filing_id % 10 = 2 then 'n/a' else strftime(reporting_date, '%Y-%m-%d') || 'T10:30:00' end as stamp from v1)
select filing_id, cast(try_strptime(day_text, '%d-%m-%Y') as date) as filing_date,
  cast(try_strptime(split_part(stamp, 'T', 1), '%Y-%m-%d') as date) as released from t""", ["v1"])
def b4(spark, sf):
    i = F.col("filing_id")
    rows = v1(spark, sf).select(
        "filing_id", F.when(i % 10 == 0, "unknown").when(i % 10 == 1, "31-02-2004")
        .otherwise(F.date_format("filing_date", "dd-MM-yyyy")).alias("day_text"),
        F.when(i % 10 == 2, "n/a").otherwise(F.concat(F.date_format("reporting_date", "yyyy-MM-dd"), F.lit("T10:30:00")))
        .alias("stamp"))
    return rows.select("filing_id", fields.parse_date("day_text", "dd-MM-yyyy").alias("filing_date"),
                       fields.parse_timestamp_day("stamp").alias("released"))


@query("b5_month_bounds", """
select aaer_id, cast(strptime('01-' || strftime(fraud_start, '%m-%Y'), '%d-%m-%Y') as date) as first_day,
  last_day(cast(strptime('01-' || strftime(fraud_start, '%m-%Y'), '%d-%m-%Y') as date)) as last_day from v2""", ["v2"])
def b5(spark, sf):
    rows = view(spark, sf, "v2").select("aaer_id", F.date_format("fraud_start", "MM-yyyy").alias("m"))
    return rows.select("aaer_id", fields.month_start("m").alias("first_day"), fields.month_end("m").alias("last_day"))


@query("b6_fiscal_year_end", """
select filing_id, cast(try_strptime(strftime(reporting_date, '%d-%m') || '-1900', '%d-%m-%Y') as date) as fye from v1""", ["v1"])
def b6(spark, sf):
    rows = v1(spark, sf).select("filing_id", F.date_format("reporting_date", "dd-MM").alias("t"))
    return rows.select("filing_id", fields.fiscal_year_end("t").alias("fye"))


@query("b7_strip_markup", "select page_id, " + VISIBLE.format(c="html") + " as visible from pages")
def b7(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_markup("html").alias("visible"))


CHAIN = """, s as (select page_id, {v} as t from pages),
a as (select page_id, regexp_replace(t, '[\\n\\t\\\\''"]+', ' ', 'g') as t from s),
b as (select page_id, regexp_replace(t, '[^\\p{{L}}\\p{{N}}_{sp}]', ' ', 'g') as t from a),
n as (select page_id, regexp_replace(t, '[{sp}]+', ' ', 'g') as mda from b)
""".format(v=VISIBLE.format(c="lower(html)"), sp=tx.SPACE_CHARS).replace(", s as", "with s as", 1)


@query("b8_normalize_mda", CHAIN + "select page_id, mda from n")
def b8(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.normalize_mda("html").alias("mda"))


@query("b9_remove_urls", """
select page_id, regexp_replace(html, 'https?://[^\\s]+', '', 'g') as without_urls,
  length(regexp_replace('see ' || url || ' for ' || cast(page_id as varchar), 'https?://[^\\s]+', '', 'g')) as rest from pages""")
def b9(spark, sf):
    sentence = F.concat(F.lit("see "), F.col("url"), F.lit(" for "), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", tx.remove_urls("html").alias("without_urls"),
                                            F.length(tx.remove_urls(sentence)).alias("rest"))


@query("b10_text_metrics", """
, w as (select doc_id, length(mda) as c, len(regexp_extract_all(mda, '[^\\s]+')) as w from v3)
select doc_id, c as char_count, w as word_count, round(case when w > 0 then c / w else 0 end, 6) as word_density from w""", ["v3"])
def b10(spark, sf):
    return view(spark, sf, "v3").select("doc_id", tx.char_count("mda").alias("char_count"), tx.word_count("mda").alias("word_count"),
                                        F.round(tx.word_density("mda"), 6).alias("word_density"))


@query("b11_correct_industry", """
select filing_id, case when filing_id % 50 = 0 then '1311' when sic = '0097' then '0079' else sic end as sic from v1""", ["v1"])
def b11(spark, sf):
    rows = v1(spark, sf).select("filing_id", "sic")
    fixes = rows.filter(F.col("filing_id") % 50 == 0).select("filing_id", F.lit("1311").alias("sic"))
    return fields.correct_industry(rows, {"0097": "0079"}, fixes, "filing_id")


@query("b12_analysis_filter", """
, w as (select f.filing_id, f.filing_type, len(regexp_extract_all(d.text, '[^\\s]+')) as word_count
  from v1 f join documents d on f.filing_id = d.doc_id)
select filing_id, word_count from w where word_count > 200 and not filing_type like '%/A'""", ["v1"])
def b12(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("filing_id"), tx.word_count("text").alias("word_count"))
    rows = v1(spark, sf).join(docs, "filing_id").withColumns(fields.filing_flags())
    return corpus.analysis_rows(rows).select("filing_id", "word_count")


@query("b13_prefix_projection", "select aaer_id, v_10b, v_13a, v_17a from v2", ["v2"])
def b13(spark, sf):
    return vectors.select_prefix(view(spark, sf, "v2"), "v_", ["aaer_id"])


RAW_LABELS = """select doc_id, case when doc_id % 17 = 0 then null else mda end as mda,
  case when doc_id % 13 = 0 then 'soon' else cast(filing_date as varchar) end as filing_date,
  case when doc_id % 11 = 0 then '2' when doc_id % 19 = 0 then 'x' else cast(fraudulent as varchar) end as fraudulent from v3"""


@query("b14_valid_rows", f""", r as ({RAW_LABELS})
select doc_id, cast(filing_date as date) as filing_date, cast(fraudulent as int) as fraudulent from r
where mda is not null and try_cast(filing_date as date) is not null and try_cast(fraudulent as double) in (0, 1)""", ["v3"])
def b14(spark, sf):
    d = F.col("doc_id")
    raw = view(spark, sf, "v3").select(
        "doc_id", F.when(d % 17 != 0, F.col("mda")).alias("mda"),
        F.when(d % 13 == 0, "soon").otherwise(F.col("filing_date").cast("string")).alias("filing_date"),
        F.when(d % 11 == 0, "2").when(d % 19 == 0, "x").otherwise(F.col("fraudulent").cast("string")).alias("fraudulent"))
    return corpus.valid_rows(raw).select("doc_id", "filing_date", "fraudulent")


@query("b15_collapse_whitespace", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from documents")
def b15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.collapse("text").alias("text"))


@query("b16_minimum_length", """
with w as (select doc_id, len(regexp_extract_all(text, '[^\\s]+')) as w from documents)
select 'counted' as mode, doc_id from w where w >= 200 union all select 'stored' as mode, doc_id from w where w >= 200 and doc_id % 9 <> 0""")
def b16(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("mda"))
    counted = corpus.long_enough(docs).select(F.lit("counted").alias("mode"), "doc_id")
    stored = docs.withColumn("word_count", F.when(F.col("doc_id") % 9 != 0, tx.word_count("mda").cast("string")))
    return counted.unionByName(corpus.long_enough(stored).select(F.lit("stored").alias("mode"), "doc_id"))


@query("b17_preview", """
select doc_id, left(text, 1000) as preview, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 300) as collapsed from documents""")
def b17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.preview("text").alias("preview"),
                                                tx.collapsed_preview("text").alias("collapsed"))


@query("b18_date_parts", """
select filing_id, cast(year(filing_date) as int) as filing_date_year, cast(month(filing_date) as int) as filing_date_month,
  cast(day(filing_date) as int) as filing_date_day, cast(month(reporting_date) as int) as fye_month,
  cast(day(reporting_date) as int) as fye_day from v1""", ["v1"])
def b18(spark, sf):
    rows = v1(spark, sf).select("filing_id", "filing_date", F.col("reporting_date").alias("fye"))
    return fields.date_parts(rows, ["filing_date", "fye"], drop=["fye_year"])


@query("b19_one_hot", """
select filing_id, cast(coalesce(city = 'BUILDING', false) as int) as city_BUILDING,
  cast(coalesce(city = 'FURNITURE', false) as int) as city_FURNITURE,
  cast(coalesce(city = 'HOUSEHOLD', false) as int) as city_HOUSEHOLD,
  cast(coalesce(city = 'MACHINERY', false) as int) as city_MACHINERY,
  cast(filing_type = '10-K/A' as int) as "filing_type_10-K/A", cast(filing_type = '10-K405' as int) as "filing_type_10-K405",
  cast(filing_type = '10-KT' as int) as "filing_type_10-KT", cast(filing_type = '10-KT/A' as int) as "filing_type_10-KT/A"
from (select filing_id, case when filing_id % 23 = 0 then null else city end as city, filing_type from v1)""", ["v1"])
def b19(spark, sf):
    rows = v1(spark, sf).select("filing_id", F.when(F.col("filing_id") % 23 != 0, F.col("city")).alias("city"), "filing_type")
    return vectors.one_hot(rows, ["city", "filing_type"])


@query("b19_one_hot_sparse", """
, l as (select distinct sic from v1 where sic is not null), n as (select sic, row_number() over (order by sic) - 2 as slot from l)
select v1.filing_id, cast(case when n.slot >= 0 then n.slot end as bigint) as slot, cast(coalesce(n.slot >= 0, false) as int) as ones
from v1 left join n on v1.sic = n.sic""", ["v1"])
def b19_sparse(spark, sf):
    coded = vectors.one_hot_sparse(v1(spark, sf).select("filing_id", "sic"), "sic", "v")
    # the stored places and values of the sparse vector: a dense array would be as wide as there are levels
    a = coded.select("filing_id", F.unwrap_udt("v").alias("a"))
    return a.select("filing_id", F.get("a.indices", F.lit(0)).cast("long").alias("slot"),
                    F.aggregate("a.values", F.lit(0.0), lambda s, x: s + x).cast("int").alias("ones"))


@query("b20_drop_leakage", "select filing_id, city, filing_type, late from (select *, cast(filing_type = '10-K405' as int) as late from v1)",
       ["v1"])
def b20(spark, sf):
    rows = v1(spark, sf).select("filing_id", "cik", "name", "city", "filing_type",
                                (F.col("filing_type") == "10-K405").cast("int").alias("late"), F.lit(1).alias("word_count"),
                                F.lit(0).alias("fsf"))
    return vectors.drop_leakage(rows)


@query("b21_required_columns", "select doc_id, cik from v3", ["v3"])
def b21(spark, sf):
    return src.require_columns(view(spark, sf, "v3"), ["mda", "fraudulent", "cik", "filing_date"]).select("doc_id", "cik")


DIVISION_SQL = "case " + " ".join(
    f"when try_cast(left(sic, 2) as int) between {a} and {b} then '{n}'" for a, b, n in fields.DIVISIONS) + " else 'Unknown' end"


@query("b22_industry_division", f"select filing_id, {DIVISION_SQL} as division from v1", ["v1"])
def b22(spark, sf):
    return v1(spark, sf).select("filing_id", fields.industry_division().alias("division"))


@query("b23_industry_group", "select filing_id, left(sic, 2) as sic2 from v1", ["v1"])
def b23(spark, sf):
    return v1(spark, sf).select("filing_id", fields.industry_group().alias("sic2"))


@query("b24_region_codes", """
with c as (select distinct case when n_nationkey % 2 = 0 then upper(left(n_name, 1)) || chr(65 + cast(n_nationkey as int)) else n_name end as code
  from nation join customer on n_nationkey = c_nationkey)
select count(*) filter (regexp_full_match(code, '[A-Z]{2}')) as domestic, count(*) filter (not regexp_full_match(code, '[A-Z]{2}')) as foreign_codes
from c""")
def b24(spark, sf):
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    code = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.upper(F.substring("n_name", 1, 1)), F.char(F.col("n_nationkey") + 65))) \
        .otherwise(F.col("n_name"))
    return rows.select(code.alias("code")).distinct().agg(
        F.count_if(fields.is_region_code("code")).alias("domestic"), F.count_if(~fields.is_region_code("code")).alias("foreign_codes"))


@query("b25_state_mismatch", """
, t as (select case when filing_id % 31 = 0 then null else state end as state,
  case when filing_id % 62 = 0 then null else incorp_state end as incorp_state from v1)
select count(*) filter (state is distinct from incorp_state or (state is null and incorp_state is null)) as n from t""", ["v1"])
def b25(spark, sf):
    i = F.col("filing_id")
    rows = v1(spark, sf).select(F.when(i % 31 != 0, F.col("state")).alias("state"),
                                F.when(i % 62 != 0, F.col("incorp_state")).alias("incorp_state"))
    return rows.agg(F.count_if(fields.differs("state", "incorp_state")).alias("n"))


@query("b26_durations", """
select aaer_id, cast(fraud_end - fraud_start as int) as fraud_duration, cast(release_date - fraud_start as int) as detection_delay,
  cast(release_date - fraud_end as int) as post_fraud_delay from v2 where release_date - fraud_end >= 0""", ["v2"])
def b26(spark, sf):
    from filingsift.operators.describe import drop_early_releases
    rows = drop_early_releases(view(spark, sf, "v2"))
    return rows.select("aaer_id", *[c.alias(n) for n, c in fields.enforcement_durations().items()])


@query("b27_duplicate_normalization", """
select doc_id, trim(regexp_replace(lower(mda), '\\s+', ' ', 'g')) as norm from v3""", ["v3"])
def b27(spark, sf):
    return view(spark, sf, "v3").select("doc_id", tx.normalize_for_duplicates("mda").alias("norm"))


@query("b28_identifiers", """
, a as (select *, lpad(cast(cik as varchar), 10, '0') as cik10, lpad(cast(filing_id as varchar), 10, '0') || '-' ||
  right(cast(year(filing_date) as varchar), 2) || '-' || lpad(cast(cik as varchar), 6, '0') as acc from v1)
select filing_id, replace(acc, '-', '') as accession_clean, cik10 || '_' || replace(acc, '-', '') as filing_key,
  'https://www.sec.gov/Archives/edgar/data/' || cast(cik as varchar) || '/' || replace(acc, '-', '') || '/main.htm' as source_url,
  cast(year(filing_date) as varchar) as year from a""", ["v1"])
def b28(spark, sf):
    rows = v1(spark, sf).select(
        "filing_id", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "filing_date", F.lit("main.htm").alias("primary_document"),
        F.concat(F.lpad(F.col("filing_id").cast("string"), 10, "0"), F.lit("-"), F.date_format("filing_date", "yy"), F.lit("-"),
                 F.lpad(F.col("cik").cast("string"), 6, "0")).alias("accession_number"))
    return rows.select("filing_id", *[c.alias(n) for n, c in fields.filing_identifiers().items()])


@query("b29_lookup", """
, listed as (select cik, min(year(filing_date)) as y from v1 group by cik)
select 'firm' as kind, filing_id from v1 where cik = 1 union all select 'industry' as kind, filing_id from v1 where sic = '0097'
union all select 'no industry' as kind, filing_id from v1 where sic is null
union all select 'listed' as kind, v.filing_id from v1 v join listed l on v.cik = l.cik and year(v.filing_date) = l.y""", ["v1"])
def b29(spark, sf):
    rows = v1(spark, sf)
    listed = rows.groupBy("cik").agg(F.min(F.year("filing_date")).alias("y"))

    def pick(kind, found):
        return found.select(F.lit(kind).alias("kind"), "filing_id")
    return (pick("firm", rows.filter(F.col("cik") == 1)).unionByName(pick("industry", rows.filter(F.col("sic") == "0097")))
            .unionByName(pick("no industry", rows.filter(F.col("sic").isNull())))
            .unionByName(pick("listed", fields.lookup_listed(rows, listed, "cik", F.year("filing_date"), "y"))))
