"""Views over the given tables that play filings, enforcement records, texts, raw documents and
chunks. The same SQL runs on Spark and on DuckDB."""
import os

from filingsift.sources.tables import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # filing_meta
    "v1": """
select o.o_orderkey as filing_id, o.o_custkey as cik, c.c_name as name, c.c_mktsegment as city, n.n_name as state,
  case when o.o_custkey % 3 = 0 then n.n_name else 'NATION_1' end as incorp_state,
  case when o.o_custkey % 101 = 0 then null else lpad(cast((o.o_custkey * 97) % 10000 as varchar(4)), 4, '0') end as sic,
  case o.o_orderpriority when '1-URGENT' then '10-K405' when '2-HIGH' then '10-KT' when '3-MEDIUM' then '10-K/A'
    when '4-NOT SPECIFIED' then '10-KT/A' else '10-K' end as filing_type,
  cast(o.o_orderdate as date) as reporting_date,
  cast(cast(o.o_orderdate as date) + interval '60' day as date) as filing_date, o.o_totalprice as amount
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
""",
    # enforcement
    "v2": """
select o_orderkey as aaer_id, o_custkey as cik, cast(date_trunc('month', o_orderdate) as date) as fraud_start,
  last_day(cast(cast(o_orderdate as date) + interval '180' day as date)) as fraud_end,
  case when o_orderkey % 9 = 0 then cast(cast(o_orderdate as date) + interval '100' day as date)
    else cast(cast(o_orderdate as date) + interval '400' day as date) end as release_date,
  cast(o_orderkey % 2 as int) as v_10b, cast(case when o_orderkey % 5 = 0 then 1 else 0 end as int) as v_13a,
  cast(case when o_orderkey % 7 < 3 then 1 else 0 end as int) as v_17a,
  cast(case when o_orderkey % 3 = 0 then 1 else 0 end as int) as corruption,
  cast(case when o_orderkey % 4 = 0 then 1 else 0 end as int) as amis,
  cast(case when o_orderkey % 6 <> 1 then 1 else 0 end as int) as fsf,
  cast(case when o_orderkey % 8 <> 0 then 1 else 0 end as int) as certainty_start,
  cast(case when o_orderkey % 3 <> 2 then 1 else 0 end as int) as certainty_end
from orders where o_orderpriority = '1-URGENT' and o_totalprice > 450000
""",
    # filing_text
    "v3": """
select d.doc_id, d.source as cik, d.lang as state, d.text as mda,
  make_date(cast(1994 + (d.doc_id * 7 + cast(floor(d.doc_id / 20) as bigint) * 3) % 32 as int),
    cast(1 + d.doc_id % 12 as int), cast(1 + d.doc_id % 28 as int)) as filing_date,
  coalesce(l.toxic, 0) as fraudulent, l.quality
from documents d left join labels l on d.doc_id = l.doc_id
""",
    # raw_filings
    "v4": """
select doc_id, source as company,
  '<html><body><p>Item 1A.</p><p>Risk Factors</p><p>12</p><p>Item 1B.</p><p>Unresolved Staff Comments</p><p>13</p>'
  || '<script>var x = 1;</script><h2>Item 1A. Risk Factors</h2><p>' || replace(text, chr(10), '</p><p>') || '</p>'
  || case when doc_id % 10 = 3 then '' else '<h2>Item 1B. Unresolved Staff Comments</h2><p>None.</p>' end
  || case when doc_id % 10 = 4 then '<h2>Item 1A. Risk Factors</h2><p>' || replace(text, chr(10), '</p><p>')
       || '</p><h2>Item 2. Properties</h2><p>None.</p>' else '' end
  || '</body></html>' as html
from documents
""",
    # chunks
    "v5": """
with b as (select d.doc_id, d.source as cik, d.text as mda,
    cast(floor(((d.doc_id * 7 + cast(floor(d.doc_id / 20) as bigint) * 3) % 32) / 4) as int) as bucket from documents d),
  s as (select cik, min(doc_id) as first_id from b group by cik),
  u as (select doc_id as chunk_id, cik, bucket, mda from b
    union all
    select 1000000 * (g.bucket + 1) + s.first_id as chunk_id, g.cik, g.bucket, d.text as mda
    from (select distinct cik, bucket from b) g join s on g.cik = s.cik join documents d on d.doc_id = s.first_id)
select cik as company, cik || '_' || cast(bucket as varchar(4)) as filing_id,
  make_date(cast(1994 + 4 * bucket as int), 1, 1) as filing_date, chunk_id,
  cast(row_number() over (partition by cik, bucket order by chunk_id) as int) as chunk_number, mda as chunk_text
from u
""",
}


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark, sf_dir, name):
    scan = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(scan, TEXT_KEYS[name]) if name in TEXT_KEYS else scan


def view(spark, sf_dir, name):
    """A fixture view as a DataFrame."""
    used = [t for t in TABLES if f" {t} " in VIEWS[name].replace("\n", " ") + " "]
    for t in used:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])
