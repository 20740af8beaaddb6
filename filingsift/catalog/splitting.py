"""Splits and draws."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import view
from filingsift.functions import text as tx
from filingsift.operators import splits

SEED = 42


def order_sql(seed, id_col):
    return f"md5('{seed}:' || cast({id_col} as varchar))"


@query("g1_temporal_split", """
select doc_id, case when year(filing_date) <= 2017 then 'train' when year(filing_date) between 2018 and 2023 then 'test'
  else 'excluded' end as split from v3""", ["v3"])
def g1(spark, sf):
    return view(spark, sf, "v3").select("doc_id", splits.temporal_split("filing_date").alias("split"))


@query("g2_delay_splits", """
, y as (select doc_id, year(filing_date) as y from v3)
select 'until_2008' as variant, doc_id, case when y <= 2008 then 'train' when y = 2011 then 'test' else 'excluded' end as split from y
union all select 'from_2004', doc_id, case when y between 2004 and 2008 then 'train' when y = 2011 then 'test' else 'excluded' end from y
union all select 'only_2003', doc_id, case when y = 2003 then 'train' when y between 2004 and 2008 then 'validation'
  when y = 2011 then 'test' else 'excluded' end from y
union all select 'only_2008', doc_id, case when y = 2008 then 'train' when y between 2004 and 2007 then 'validation'
  when y = 2011 then 'test' else 'excluded' end from y
union all select 'fixed_validation', doc_id, case when y between 2003 and 2008 then 'train' when y between 1997 and 2002 then 'validation'
  when y = 2011 then 'test' else 'excluded' end from y""", ["v3"])
def g2(spark, sf):
    rows = view(spark, sf, "v3").select("doc_id", "filing_date")
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), splits.delay_split("filing_date", v).alias("split"))
                         for v in splits.DELAY_SPLITS])
    return rows.select("doc_id", F.explode(variants).alias("r")).select("doc_id", "r.*")


STRATIFIED = f""", h as (select doc_id, fraudulent, row_number() over (partition by fraudulent order by {order_sql(SEED, 'doc_id')}, doc_id) as r,
  count(*) over (partition by fraudulent) as n from v3)
"""


@query("g3_stratified_split", STRATIFIED + """
select doc_id, fraudulent, case when r <= floor(n * 0.2 + 0.5) then 'validation' else 'train' end as split from h""", ["v3"])
def g3(spark, sf):
    return splits.stratified_split(view(spark, sf, "v3").select("doc_id", "fraudulent"), "doc_id", "fraudulent", 0.2, SEED)


@query("g3_stratified_split_threshold", f"""
select doc_id, case when cast('0x' || left({order_sql(SEED, 'doc_id')}, 13) as bigint) / power(16, 13) < 0.2
  then 'validation' else 'train' end as split from v3""", ["v3"])
def g3_threshold(spark, sf):
    return splits.stratified_split(view(spark, sf, "v3").select("doc_id"), "doc_id", "fraudulent", 0.2, SEED, exact=False)


@query("g4_above_train_quantile", """
, w as (select doc_id, len(regexp_extract_all(mda, '[^\\s]+')) as word_count, case when year(filing_date) <= 2017 then 'train' else 'test' end as split from v3)
select doc_id, word_count, split from w where split <> 'train'
  or word_count > (select quantile_cont(word_count, 0.25) from w where split = 'train')""", ["v3"])
def g4(spark, sf):
    rows = view(spark, sf, "v3").select(
        "doc_id", tx.word_count("mda").alias("word_count"), F.when(F.year("filing_date") <= 2017, "train").otherwise("test").alias("split"))
    return splits.above_train_quantile(rows, "word_count")


WINDOWS = """, w as (select doc_id, fraudulent, year(filing_date) as y, cast(e as int) as window_end from v3, range(2003, 2015) r(e)
  where year(filing_date) between 2003 and e or year(filing_date) = e + 3)
"""


@query("g5_expanding_windows", WINDOWS + """
select doc_id, window_end, case when y = window_end + 3 then 'test' else 'train' end as split from w""", ["v3"])
def g5(spark, sf):
    return splits.expanding_windows(view(spark, sf, "v3"), "filing_date").select("doc_id", "window_end", "split")


@query("g5_expanding_windows_with_validation", WINDOWS + f"""
, t as (select *, row_number() over (partition by window_end, fraudulent order by {order_sql(SEED, 'doc_id')}, doc_id) as r,
  count(*) over (partition by window_end, fraudulent) as n from w where y <> window_end + 3)
select doc_id, window_end, case when r <= floor(n * 0.2 + 0.5) then 'validation' else 'train' end as split from t
union all select doc_id, window_end, 'test' from w where y = window_end + 3""", ["v3"])
def g5_validation(spark, sf):
    rows = splits.expanding_windows(view(spark, sf, "v3").select("doc_id", "fraudulent", "filing_date"), "filing_date")
    return splits.split_window_train(rows, "doc_id", "fraudulent").select("doc_id", "window_end", "split")


@query("g6_ratio_pool", f"""
, s as (select 2 * count(*) filter (year(filing_date) = 2003) as half,
  floor(2 * count(*) filter (year(filing_date) = 2003) * avg(fraudulent) + 1) as pos from v3),
h as (select doc_id, fraudulent, row_number() over (partition by fraudulent order by {order_sql(SEED, 'doc_id')}, doc_id) as r,
  count(*) over (partition by fraudulent) as n from v3 where year(filing_date) > 2003),
t as (select h.*, least(2 * case when fraudulent = 1 then pos else half - pos end, n) as take from h, s)
select doc_id, fraudulent, case when r <= floor(take / 2) then 'validation' else 'test' end as split from t where r <= take""", ["v3"])
def g6(spark, sf):
    return splits.ratio_pool(view(spark, sf, "v3").select("doc_id", "fraudulent", "filing_date"), "doc_id", "fraudulent", "filing_date") \
        .select("doc_id", "fraudulent", "split")


# scores in the shape of the novelty job, made from the chunk fixture by rule
SCORES = """, sc as (select company, filing_id, filing_date, chunk_id, chunk_text, (chunk_id % 97) / 96.0 as sim,
  case when chunk_number = 1 then 'no_history' when chunk_id % 97 >= 77 then 'potential_boilerplate'
    when chunk_id % 97 >= 39 then 'modified_disclosure' else 'potential_novel_disclosure' end as cat from v5)
"""


def made_scores(spark, sf):
    c = F.col("chunk_id")
    cat = (F.when(F.col("chunk_number") == 1, "no_history").when(c % 97 >= 77, "potential_boilerplate")
           .when(c % 97 >= 39, "modified_disclosure").otherwise("potential_novel_disclosure"))
    return view(spark, sf, "v5").withColumns({
        "boilerplate_category": cat, "max_similarity": F.when(cat != "no_history", (c % 97) / 96.0),
        "novelty_score": 1 - (c % 97) / 96.0, "reference_filing_date": F.col("filing_date"), "matched_chunk_id": c + 1,
        "matched_chunk_text": F.col("chunk_text")})


@query("g7_review_sample", SCORES + f"""
, p as (select *, row_number() over (partition by company, cat order by {order_sql(SEED, 'chunk_id')}, chunk_id) as r from sc where cat <> 'no_history'),
d as (select *, row_number() over (order by md5('{SEED}:sheet:' || cast(chunk_id as varchar)), chunk_id) as pos from p where r <= 5)
select 'BR_' || lpad(cast(pos as varchar), cast(greatest(3, length(cast(pos as varchar))) as int), '0') as review_id, company, filing_date, chunk_id,
  '' as manual_category, '' as review_notes, cat as boilerplate_category, round(sim, 6) as max_similarity from d""", ["v5"])
def g7(spark, sf):
    sheet, predictions = splits.review_sample(made_scores(spark, sf), 5, SEED)
    return sheet.select("review_id", "company", "filing_date", "chunk_id", "manual_category", "review_notes").join(
        predictions.select("review_id", "boilerplate_category", F.round("max_similarity", 6).alias("max_similarity")), "review_id")


@query("g8_hide_positives", STRATIFIED + """
select doc_id, fraudulent, cast(fraudulent = 1 and r > 20 as int) as pu_label from h""", ["v3"])
def g8(spark, sf):
    return splits.hide_positives(view(spark, sf, "v3").select("doc_id", "fraudulent"), "doc_id", "fraudulent", 20, SEED)


@query("g9_shuffled_split", f"""
, h as (select doc_id, row_number() over (order by {order_sql(SEED, 'doc_id')}, doc_id) as r, count(*) over () as n from v3)
select doc_id, case when r <= floor(2 * n / 3) then 'train' else 'validation' end as split from h""", ["v3"])
def g9(spark, sf):
    return splits.shuffled_split(view(spark, sf, "v3").select("doc_id"), "doc_id", SEED)


@query("g9_shuffled_split_threshold", f"""
select doc_id, case when cast('0x' || left({order_sql(SEED, 'doc_id')}, 13) as bigint) / power(16, 13) < 2.0 / 3.0
  then 'train' else 'validation' end as split from v3""", ["v3"])
def g9_threshold(spark, sf):
    return splits.shuffled_split(view(spark, sf, "v3").select("doc_id"), "doc_id", SEED, exact=False)


@query("sample_fraction", f"""
select filing_id from v1 where cast('0x' || left({order_sql(SEED, 'filing_id')}, 13) as bigint) / power(16, 13) < 0.25""", ["v1"])
def sample_fraction(spark, sf):
    return splits.sample_fraction(view(spark, sf, "v1"), "filing_id", 0.25, SEED).select("filing_id")
