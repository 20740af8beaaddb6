"""Joins, duplicates and constraints."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import fields, text as tx
from filingsift.operators import dedup, describe, evaluate, joins, row_dedup, sections
from filingsift.plans import corpus
from filingsift.session import materialize, scratch_path

# the filing id stands for the address of the filing
IDENTITY = ["filing_id", "cik", "name", "city", "state", "sic", "incorp_state", "filing_type", "filing_date", "reporting_date"]

# joined filings with the interval label; "kept" drops repeated negatives
LABELLED_SQL = """
, joined as (select f.*, e.aaer_id, e.fraud_start, e.fraud_end, e.release_date,
    case when f.reporting_date >= e.fraud_start
      and f.reporting_date <= cast(e.fraud_end + interval '1' year as date) then 1 else 0 end as fraudulent
  from v1 f left join v2 e on f.cik = e.cik),
counted as (select *, count(*) over (partition by filing_id, cik, name, city, state, sic, incorp_state, filing_type,
    filing_date, reporting_date) as copies from joined),
kept as (select * from counted where not (fraudulent = 0 and copies > 1))
"""


def joined_rows(spark, sf):
    return joins.label_filings(joins.attach_enforcement(view(spark, sf, "v1"), view(spark, sf, "v2")))


def labelled(spark, sf):
    """The labelled filings most reports read."""
    return dedup.drop_repeated_negatives(joined_rows(spark, sf), IDENTITY)


TEXT_SQL = """
, t as (select *, trim(regexp_replace(lower(mda), '\\s+', ' ', 'g')) as norm, year(filing_date) as y from v3)
"""


def keyed(spark, sf):
    """Text hashes without the texts, written once: the checks below read them more than once."""
    rows = dedup.with_text_key(view(spark, sf, "v3"), "mda")
    return materialize(rows.select("doc_id", "cik", "fraudulent", F.year("filing_date").alias("y"), "text_key"), "keys")


def is_train():
    return F.col("y") <= 2017


def is_test():
    return F.col("y").between(2018, 2023)


@query("c1_attach_enforcement", """
select f.filing_id, f.cik, e.aaer_id, e.fraud_start, e.fraud_end from v1 f left join v2 e on f.cik = e.cik""", ["v1", "v2"])
def c1(spark, sf):
    return joins.attach_enforcement(view(spark, sf, "v1"), view(spark, sf, "v2")).select(
        "filing_id", "cik", "aaer_id", "fraud_start", "fraud_end")


@query("c2_interval_label", LABELLED_SQL + """
select filing_id, aaer_id, reporting_date, cast(fraudulent as int) as fraudulent from joined""", ["v1", "v2"])
def c2(spark, sf):
    return joined_rows(spark, sf).select("filing_id", "aaer_id", "reporting_date", "fraudulent")


@query("c3_drop_known", """
, lab as (select v1.* from v1 where cik in (select cik from v2))
select g.filing_id, g.cik from v1 g where not exists (select 1 from lab l where
  l.filing_id = g.filing_id and l.cik is not distinct from g.cik and l.name is not distinct from g.name and l.city is not distinct from g.city
  and l.state is not distinct from g.state and l.sic is not distinct from g.sic
  and l.incorp_state is not distinct from g.incorp_state and l.filing_type is not distinct from g.filing_type
  and l.filing_date is not distinct from g.filing_date and l.reporting_date is not distinct from g.reporting_date)
""", ["v1", "v2"])
def c3(spark, sf):
    general = view(spark, sf, "v1")
    known = general.join(view(spark, sf, "v2").select("cik").distinct(), "cik", "left_semi")
    return joins.drop_known(general, known, IDENTITY).select("filing_id", "cik")


@query("c4_append_rows", LABELLED_SQL + """
, general as (select g.* from v1 g where g.cik not in (select cik from v2))
select filing_id, aaer_id, fraud_start, cast(fraudulent as int) as fraudulent from kept where cik in (select cik from v2)
union all select filing_id, null as aaer_id, null as fraud_start, 0 as fraudulent from general""", ["v1", "v2"])
def c4(spark, sf):
    filings, enforcement = view(spark, sf, "v1"), view(spark, sf, "v2")
    firms = enforcement.select("cik").distinct()
    top = corpus.label_rows(filings.join(firms, "cik", "left_semi"), enforcement, IDENTITY)
    bottom = filings.join(firms, "cik", "left_anti").withColumn("fraudulent", F.lit(0))
    return joins.append_rows(top, bottom).select("filing_id", "aaer_id", "fraud_start", "fraudulent")


@query("corpus_build", LABELLED_SQL + """
, lab as (select * from kept where cik in (select cik from v2)),
general as (select g.* from v1 g where not exists (select 1 from lab l where l.filing_id = g.filing_id
  and l.sic is not distinct from g.sic and l.filing_type = g.filing_type and l.filing_date = g.filing_date
  and l.reporting_date = g.reporting_date))
, whole as (select filing_id, sic, filing_type, fraudulent from lab
  union all select filing_id, sic, filing_type, 0 from general)
select filing_id, sic, cast(filing_type like '%/A' as int) as amend_filing, cast(fraudulent as int) as fraudulent from whole
""", ["v1", "v2"])
def corpus_build(spark, sf):
    filings, enforcement = view(spark, sf, "v1"), view(spark, sf, "v2")
    firms = enforcement.select("cik").distinct()
    rows = corpus.add_general(corpus.label_rows(filings.join(firms, "cik", "left_semi"), enforcement, IDENTITY),
                              filings, IDENTITY)
    return rows.select("filing_id", "sic", "amend_filing", "fraudulent")


@query("corpus_build_with_texts", """
, f as (select v1.*, d.text as mda from v1 join documents d on v1.filing_id = d.doc_id),
joined as (select f.*, case when f.reporting_date >= e.fraud_start and f.reporting_date <= cast(e.fraud_end + interval '1' year as date)
  then 1 else 0 end as fraudulent from f join v2 e on f.cik = e.cik),
counted as (select *, count(*) over (partition by cik, name, city, state, sic, incorp_state, filing_type, filing_date, reporting_date, mda) as copies from joined),
lab as (select * from counted where not (fraudulent = 0 and copies > 1)),
general as (select f.* from f where not exists (select 1 from lab l where l.cik = f.cik and l.name = f.name and l.sic is not distinct from f.sic
  and l.filing_type = f.filing_type and l.filing_date = f.filing_date and l.reporting_date = f.reporting_date and l.mda = f.mda)),
whole as (select filing_id, sic, filing_type, mda, fraudulent from lab union all select filing_id, sic, filing_type, mda, 0 from general),
""" + r"""
a as (select *, regexp_replace(trim_text, '[\n\t\\''"]+', ' ', 'g') as t from (select *, lower(mda) as trim_text from whole)),
b as (select *, regexp_replace(t, '[^\p{L}\p{N}_{sp}]', ' ', 'g') as u from a),
n as (select *, regexp_replace(u, '[{sp}]+', ' ', 'g') as clean from b),
m as (select *, length(clean) as c, len(regexp_extract_all(clean, '[^{sp}]+')) as w from n)
select filing_id, case when sic = '0097' then '0079' else sic end as sic, cast(fraudulent as int) as fraudulent, c as char_count, w as word_count,
  round(c / w, 6) as word_density, md5(clean) as digest from m where w > 200 and not filing_type like '%/A'
""".replace("{sp}", tx.SPACE_CHARS), ["v1", "v2"])
def corpus_build_with_texts(spark, sf):
    """The whole build: labels, appended general filings, clean texts, length measures, industry rewrites, analysis filter."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("filing_id"), F.col("text").alias("mda"))
    filings, enforcement = view(spark, sf, "v1").join(texts, "filing_id"), view(spark, sf, "v2")
    firms = enforcement.select("cik").distinct()
    _, analysis = corpus.build_corpus(filings.join(firms, "cik", "left_semi"), filings, enforcement, {"0097": "0079"})
    return analysis.select("filing_id", "sic", "fraudulent", "char_count", "word_count", F.round("word_density", 6).alias("word_density"),
                           F.md5("mda").alias("digest"))


@query("c5_accepted_sections", """
, cand as (select doc_id as filing_id, text as section_text from documents),
rev as (select doc_id as filing_id, case when doc_id % 4 = 0 then 'reject' else ' Accept ' end as review_decision,
  case when doc_id % 5 = 0 then 'no' else 'YES' end as correct_start, 'yes' as correct_end,
  case when doc_id % 7 = 0 then 'yes' else 'No' end as toc_contamination from documents)
select c.filing_id, 'manually_accepted' as verification_status from cand c left join rev r on c.filing_id = r.filing_id
where lower(trim(r.review_decision)) = 'accept' and lower(trim(r.correct_start)) = 'yes'
  and lower(trim(r.correct_end)) = 'yes' and lower(trim(r.toc_contamination)) = 'no' and trim(c.section_text) <> ''
""".replace(", cand as", "with cand as", 1))
def c5(spark, sf):
    docs = table(spark, sf, "documents")
    cand = docs.select(F.col("doc_id").alias("filing_id"), F.col("text").alias("section_text"))
    d = F.col("doc_id")
    sheet = sections.review_sheet(cand.select("filing_id").withColumnRenamed("filing_id", "doc_id")).drop(*sections.REVIEW_FIELDS)
    reviews = sheet.select(
        d.alias("filing_id"), F.when(d % 4 == 0, "reject").otherwise(" Accept ").alias("review_decision"),
        F.when(d % 5 == 0, "no").otherwise("YES").alias("correct_start"), F.lit("yes").alias("correct_end"),
        F.when(d % 7 == 0, "yes").otherwise("No").alias("toc_contamination"), F.lit("").alias("review_notes"))
    return joins.accepted_sections(cand, reviews).select("filing_id", "verification_status")


@query("c7_leaked_rows", TEXT_SQL + """
select doc_id from t where y between 2018 and 2023 and norm <> '' and norm in (select norm from t where y <= 2017)""", ["v3"])
def c7(spark, sf):
    return dedup.leaked_rows(keyed(spark, sf), is_train(), is_test()).select("doc_id")


@query("c7_leak_share", TEXT_SQL + """
, n as (select count(*) filter (norm <> '' and norm in (select norm from t where y <= 2017)) as leaked_rows,
  count(*) as test_rows from t where y between 2018 and 2023)
select leaked_rows, test_rows, round(leaked_rows * 100.0 / test_rows, 6) as percent from n""", ["v3"])
def c7_share(spark, sf):
    return dedup.leak_share(keyed(spark, sf), is_train(), is_test()).withColumn("percent", F.round("percent", 6))


@query("c8_company_overlap", """
, tr as (select distinct cik from v3 where year(filing_date) <= 2017),
te as (select distinct cik from v3 where year(filing_date) between 2018 and 2023)
select (select count(*) from tr) as train_companies, (select count(*) from te) as test_companies,
  (select count(*) from tr where cik in (select cik from te)) as both_companies""", ["v3"])
def c8(spark, sf):
    return joins.company_overlap(view(spark, sf, "v3").withColumn("y", F.year("filing_date")), "cik", is_train(), is_test())


@query("c9_previous_filing", """
, f as (select distinct company, filing_id, filing_date from v5)
select company, filing_id, filing_date,
  lag(filing_id) over (partition by company order by filing_date, filing_id) as reference_filing_id,
  lag(filing_date) over (partition by company order by filing_date, filing_id) as reference_filing_date from f""", ["v5"])
def c9(spark, sf):
    return joins.previous_filings(view(spark, sf, "v5"))


@query("c9_previous_filing_many_per_day", """
select cik, filing_id, filing_date,
  lag(filing_id) over (partition by cik order by filing_date, filing_id) as reference_filing_id,
  lag(filing_date) over (partition by cik order by filing_date, filing_id) as reference_filing_date from v1""", ["v1"])
def c9_many(spark, sf):
    return joins.previous_filings(view(spark, sf, "v1"), "cik")


@query("c10_align_years", LABELLED_SQL + """
, a as (select year(reporting_date) as year, count(*) filter (fraudulent = 1) as p, count(*) as n from kept group by 1),
b as (select year(reporting_date) as year, count(*) filter (fraudulent = 1) as p, count(*) as n from kept
  where not (filing_type like '%/A') group by 1)
select cast(a.year as int) as year, a.p as label_1_all, b.p as label_1_filtered, round(a.p / a.n, 6) as fraud_ratio_all,
  round(b.p / b.n, 6) as fraud_ratio_filtered from a join b on a.year = b.year""", ["v1", "v2"])
def c10(spark, sf):
    rows = labelled(spark, sf).withColumn("year", F.year("reporting_date"))
    wanted = ["year", "label_1", "fraud_ratio"]
    whole = describe.label_pivot(rows, "year").select(*wanted)
    part = describe.label_pivot(rows.filter(fields.filing_flags()["amend_filing"] == 0), "year").select(*wanted)
    out = joins.align_years(whole, part)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("fraud_ratio")})


@query("c12_compare_windows", """
, s as (select year(filing_date) as w, fraudulent as y, cast(length(mda) > 1000 as int) as p from v3),
c as (select w, count(*) as n, count(*) filter (y = p) as ok, count(*) filter (y = 0 and p = 0) as tn,
  count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 1 and p = 1) as tp
  from s group by w),
m as (select 'accuracy' as metric, w, ok / n as v from c
  union all select 'macro_recall', w, (case when tn + fp > 0 then tn / (tn + fp) else 0 end
    + case when tp + fn > 0 then tp / (tp + fn) else 0 end) / 2 from c)
select a.metric, cast(a.w as int) as i, cast(b.w as int) as j,
  round(case when a.w = b.w then a.v when a.w < b.w then a.v - b.v else b.v - a.v end, 4) as diff
from m a join m b on a.metric = b.metric""", ["v3"])
def c12(spark, sf):
    rows = view(spark, sf, "v3").select(F.year("filing_date").alias("window"), F.col("fraudulent").alias("y"),
                                        (F.length("mda") > 1000).cast("int").alias("p"))
    scores = evaluate.macro_scores(rows, "y", "p", ["window"])
    metrics = scores.unpivot("window", ["accuracy", "macro_recall"], "metric", "value")
    return joins.compare_windows(metrics)


@query("d1_drop_repeated_negatives", LABELLED_SQL + """
select filing_id, aaer_id, cast(fraudulent as int) as fraudulent from kept""", ["v1", "v2"])
def d1(spark, sf):
    return labelled(spark, sf).select("filing_id", "aaer_id", "fraudulent")


@query("d2_duplicate_rows", """
select lang as state, source as cik, n_chars, md5(text) as digest, count(*) over (partition by lang, source, n_chars, text) as copies
from documents qualify copies > 1""")
def d2(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("state"), F.col("source").alias("cik"), "n_chars", "text")
    return dedup.duplicate_rows(docs).withColumn("digest", F.md5("text")).drop("text")


@query("d2_duplicate_share", """
with n as (select text, count(*) as n from documents group by text)
select cast(sum(case when n > 1 then n else 0 end) as bigint) as duplicate_rows, cast(sum(n) as bigint) as rows,
  round(sum(case when n > 1 then n else 0 end) * 100.0 / sum(n), 6) as percent from n""")
def d2_share(spark, sf):
    return dedup.duplicate_share(table(spark, sf, "documents"), ["text"]).withColumn("percent", F.round("percent", 6))


@query("d3_distinct_rows_in_place", "select distinct lang, source, n_chars, md5(text) as digest from documents")
def d3_places(spark, sf):
    """The same for a stored table: duplicates are found by key and place, and dropped where they lie."""
    path = scratch_path(spark, "rows")
    table(spark, sf, "documents").select("lang", "source", "n_chars", "text").write.parquet(path)
    return row_dedup.drop_repeated_rows(spark, path).withColumn("digest", F.md5("text")).drop("text")


@query("d3_drop_exact_duplicates", "select distinct lang, source, n_chars, md5(text) as digest from documents")
def d3(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source", "n_chars", "text")
    return dedup.drop_exact_duplicates(docs).withColumn("digest", F.md5("text")).drop("text")


@query("d4_duplicate_text", TEXT_SQL + """
select doc_id, copies from (select doc_id, norm, count(*) over (partition by norm) as copies from t where norm <> '')
where copies > 1""", ["v3"])
def d4(spark, sf):
    return dedup.duplicate_text_rows(keyed(spark, sf)).select("doc_id", "copies")


@query("d5_conflicting_labels", TEXT_SQL + """
select doc_id, cast(fraudulent as int) as fraudulent from t where norm <> '' and norm in
  (select norm from t where norm <> '' group by norm having count(distinct fraudulent) > 1)""", ["v3"])
def d5(spark, sf):
    return dedup.conflicting_label_rows(keyed(spark, sf)).select("doc_id", "fraudulent")


@query("d6_earliest_filings", """
select cik, filing_id, filing_date from (select *, row_number() over (partition by cik order by filing_date, filing_id) as r
  from v1 where filing_type = '10-K' and filing_date between date '1993-01-01' and date '1996-12-31') where r <= 3""", ["v1"])
def d6(spark, sf):
    return dedup.earliest_filings(view(spark, sf, "v1"), "cik", "filing_id", "filing_date", "filing_type", (1993, 1996), 3) \
        .select("cik", "filing_id", "filing_date")


@query("d7_key_offenders", "select cik, count(*) as copies from v2 group by cik having count(*) > 1", ["v2"])
def d7(spark, sf):
    return dedup.key_offenders(view(spark, sf, "v2"), ["cik"])


@query("d8_conservation", """
, words as (select cast(sum(len(regexp_extract_all(text, '[^\\s]+'))) as bigint) as w, count(*) as n,
   count(*) filter (len(regexp_extract_all(text, '[^\\s]+')) = 0) as empty from documents)
select n as input_keys, n - empty as output_keys, empty as missing_keys, w as input_words, w as output_words,
  cast(0 as bigint) as words_lost from words""".replace(", words as", "with words as", 1))
def d8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pieces = sections.chunks(docs, "doc_id", "text")
    return dedup.conservation_report(docs, pieces, "doc_id", tx.word_count("text"), F.col("word_count")).drop("output_rows")
