"""Audits from stored sketches, held against the exact figures."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.functions import text as tx
from filingsift.operators import sketches
from filingsift.session import materialize, scratch_path

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
# sets of years that are read from the same stored states
SPANS = {"all": (1992, 2030), "early": (1992, 2005), "late": (2006, 2030)}


@query("e7_stored_length_quantiles", """
, w as (select year(filing_date) as y, len(regexp_extract_all(mda, '[^\\s]+')) as words from v3),
s as (select * from (values ('all', 1992, 2030), ('early', 1992, 2005), ('late', 2006, 2030)) as t(span, low, high))
select span, count(*) as n, true as within from s join w on y between low and high where words > 0 group by span""", ["v3"])
def e7_stored(spark, sf):
    """Length quantiles of any span of years from states stored by year; ``within``: the exact rank of each estimate lies
    within the stated error of its probability."""
    rows = view(spark, sf, "v3").select(F.year("filing_date").alias("y"), tx.word_count("mda").alias("words")).filter("words > 0")
    rows = materialize(rows, "lengths")
    path = scratch_path(spark, "length-sketches")
    sketches.store_states(sketches.build_states(rows.filter("y < 2010"), ["y"], ["words"]), path, ["y"])
    states = sketches.store_states(sketches.build_states(rows.filter("y >= 2010"), ["y"], ["words"]), path, ["y"])
    found = None
    error = F.lit(sketches.rank_error())
    for span, (low, high) in SPANS.items():
        said = sketches.estimates(sketches.merge_states(states.filter(F.col("y").between(low, high))), PROBS).first()
        here = rows.filter(F.col("y").between(low, high))
        n = F.count(F.lit(1))
        near = [(F.count_if(F.col("words") < said[f"p{round(p * 100)}_words"]) / n <= p + error)
                & (F.count_if(F.col("words") <= said[f"p{round(p * 100)}_words"]) / n >= p - error) for p in PROBS]
        one = here.agg(F.lit(span).alias("span"), F.max(F.lit(said["n_words"])).cast("bigint").alias("n"), F.array_min(F.array(*near)).alias("within"))
        found = one if found is None else found.unionByName(one)
    return found.filter("n > 0")  # a span without rows has no row


@query("e15_stored_distinct_customers", """
with w as (select year(cast(o_orderdate as date)) as y, o_custkey from orders),
s as (select * from (values ('all', 1992, 2030), ('early', 1992, 1996), ('late', 1997, 2030)) as t(span, low, high))
select span, count(*) as n, true as within from s join w on y between low and high group by span""")
def e15_stored(spark, sf):
    """Distinct customers of any span of years from states stored by year; ``within``: off by at most the stated share."""
    rows = table(spark, sf, "orders").select(F.year(F.col("o_orderdate").cast("date")).alias("y"), "o_custkey")
    path = scratch_path(spark, "customer-sketches")
    states = sketches.store_states(sketches.build_states(rows, ["y"], keys=["o_custkey"]), path, ["y"])
    found = None
    for span, (low, high) in {"all": (1992, 2030), "early": (1992, 1996), "late": (1997, 2030)}.items():
        said = sketches.estimates(sketches.merge_states(states.filter(F.col("y").between(low, high)))).first()
        exact = F.count_distinct("o_custkey")
        one = rows.filter(F.col("y").between(low, high)).agg(
            F.lit(span).alias("span"), F.max(F.lit(said["n_rows"])).cast("bigint").alias("n"),
            (F.abs(exact - said["distinct_o_custkey"]) <= F.greatest(F.lit(1.0), exact * sketches.count_error())).alias("within"))
        found = one if found is None else found.unionByName(one)
    return found.filter("n > 0")  # a span without rows has no row
