"""Readers, writers, manifests, cached features."""
import os

from pyspark.sql import functions as F

from filingsift.catalog.features import TFIDF, tfidf
from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import text as tx
from filingsift.operators import vocab
from filingsift.session import scratch_path
from filingsift.sources import tables as src

V2_SCHEMA = ("aaer_id bigint, cik bigint, fraud_start date, fraud_end date, release_date date, v_10b int, v_13a int, "
             "v_17a int, corruption int, amis int, fsf int, certainty_start int, certainty_end int")
V1_SCHEMA = ("filing_id bigint, cik bigint, name string, city string, state string, incorp_state string, sic string, "
             "filing_type string, reporting_date date, filing_date date, amount double")


@query("a1_read_delimited", "select aaer_id, cik, fraud_start, fraud_end, v_10b, v_13a from v2", ["v2"])
def a1(spark, sf):
    path = scratch_path(spark, "enforcement")
    src.write_table(view(spark, sf, "v2"), path, "csv", sep=";")
    return src.read_delimited(spark, path, V2_SCHEMA).select("aaer_id", "cik", "fraud_start", "fraud_end", "v_10b", "v_13a")


@query("a2_read_json", "select filing_id, cik, name, sic, filing_type, reporting_date from v1", ["v1"])
def a2(spark, sf):
    path = scratch_path(spark, "filings")
    src.write_table(view(spark, sf, "v1"), path, "json")
    return src.read_json_records(spark, path, V1_SCHEMA).select("filing_id", "cik", "name", "sic", "filing_type", "reporting_date")


@query("a3_read_csv_null_conventions", """
select 'na' as convention, filing_id, sic from v1
union all select 'empty' as convention, filing_id, coalesce(sic, '') as sic from v1""", ["v1"])
def a3(spark, sf):
    path = scratch_path(spark, "filings")
    src.write_table(view(spark, sf, "v1"), path, "csv")
    wanted = ["filing_id", "sic"]
    na = src.read_csv(spark, path, V1_SCHEMA, columns=wanted)
    empty = src.read_csv(spark, path, V1_SCHEMA, keep_empty=True, columns=wanted)
    return na.withColumn("convention", F.lit("na")).unionByName(empty.withColumn("convention", F.lit("empty")))


@query("a4_write_partitioned", """
select cast(year(filing_date) as int) as filing_year, count(*) as n, cast(sum(length(mda)) as bigint) as chars
from v3 group by 1""", ["v3"])
def a4(spark, sf):
    path = scratch_path(spark, "corpus")
    src.write_table(view(spark, sf, "v3").withColumn("filing_year", F.year("filing_date")), path, partition_by=["filing_year"])
    return spark.read.parquet(path).groupBy("filing_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("mda")).alias("chars"))


@query("a5_write_record", """
select 'corpus' as experiment, count(*) as n_samples, cast(sum(fraudulent) as bigint) as n_fraud,
  round(avg(fraudulent), 6) as fraud_ratio from v3""", ["v3"])
def a5(spark, sf):
    row = view(spark, sf, "v3").agg(F.count(F.lit(1)).alias("n"), F.sum("fraudulent").alias("p"),
                                    F.round(F.avg("fraudulent"), 6).alias("r")).first()
    path = scratch_path(spark, "record")
    src.write_record(spark, {"experiment": "corpus", "n_samples": row["n"], "n_fraud": row["p"], "fraud_ratio": row["r"]}, path)
    return src.read_json_records(spark, path, "experiment string, n_samples bigint, n_fraud bigint, fraud_ratio double")


@query("a6_document_manifest", """
, m as (select page_id, encode(html) as raw, lower(left(html, 5000)) as head from pages),
f as (select page_id, raw, octet_length(raw) < 1000 or not (contains(head, '<html') or contains(head, '<!doctype')
   or contains(head, '<?xml') or contains(head, '<document')) as small,
   contains(head, 'access denied') or contains(head, 'request rate threshold exceeded') as refused from m)
select page_id, case when small or refused then 'failed' else 'downloaded' end as status,
  cast(case when small or refused then 0 else octet_length(raw) end as bigint) as bytes,
  case when small or refused then '' else sha256(raw) end as sha256,
  case when small or refused then '' else 'raw/' || cast(page_id as varchar) || '.html' end as raw_path,
  case when small then 'Unexpected or suspiciously small filing document'
    when refused then 'Access restriction in response body' else '' end as error from f
""".replace(", m as", "with m as", 1))
def a6(spark, sf):
    pages = table(spark, sf, "pages").withColumn("place", F.format_string("raw/%d.html", "page_id"))
    return src.document_manifest(pages, "page_id", "html", "place")


@query("a7_saved_model_state", TFIDF + "select cast(idx as int) as idx, term, df, cf, round(idf, 6) as idf, (select n from n) as n_docs from voc",
       ["v3"])
def a7(spark, sf):
    _, model = tfidf(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    back = vocab.TfidfModel.load(spark, path)
    return back.vocabulary.withColumn("idf", F.round("idf", 6)).withColumn("n_docs", F.lit(back.n_docs))


@query("a8_cached_features", "select doc_id, n_chars, cast(len(regexp_extract_all(text, '[^\\s]+')) as int) as words from documents")
def a8(spark, sf):
    keys = table(spark, sf, "documents")
    path = os.path.join(scratch_path(spark, "features"), "words")

    def build(docs):
        return docs.select("doc_id", "n_chars", tx.word_count("text").alias("words"))
    src.cached_features(keys, "doc_id", path, build)
    return src.cached_features(keys, "doc_id", path, build)
