"""The physical plans that matter at scale."""
import pytest
from oracle import MODELS
from pyspark.sql import functions as F

from filingsift import catalog
from filingsift.catalog.views import table, view
from filingsift.functions import text as tx
from filingsift.operators import dedup, describe, joins, ranks, sections, splits, vectors, vocab
from filingsift.sources import tables
from filingsift.session import build_session  # noqa: F401

QUERIES, ORACLES = catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - MODELS))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def jobs_run(spark, make):
    """How many jobs building a plan starts."""
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    make()
    spark.sparkContext.setJobGroup("tests", "tests")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_enforcement_is_left_to_adaptive_execution(spark, sf_dir):
    filings, enforcement = view(spark, sf_dir, "v1"), view(spark, sf_dir, "v2")
    joined = joins.attach_enforcement(filings, enforcement)
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    assert jobs_run(spark, lambda: joins.attach_enforcement(filings, enforcement)) == 0


def test_term_counts_do_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.topic_tokens("text").alias("tokens"))
    counts = vocab.term_counts(docs, "doc_id", F.col("tokens"))
    assert "Exchange" not in plan(counts)
    plain = docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    assert counts.exceptAll(plain).count() == 0 and plain.exceptAll(counts).count() == 0


def test_markup_is_not_shuffled_by_extraction(spark, sf_dir):
    docs = view(spark, sf_dir, "v4")
    text = plan(sections.extract_sections(docs.select("doc_id", "company"), docs.select("doc_id", "html"), "doc_id", "html"))
    below = [line for line in text.split("\n") if "Exchange" in line]
    assert below and not any("html" in line for line in below)
    tree = docs.select("doc_id", "html")
    raw = sections.extract_sections(docs.select("doc_id"), tree, "doc_id", "html")
    assert "html" not in raw.columns and raw.count() == docs.count()


def test_exact_duplicates_carry_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    text = plan(dedup.drop_exact_duplicates(docs))
    assert "SortAggregate" not in text and "first(" not in text


def test_chunk_quality_reads_its_input_once(spark, sf_dir):
    chunks = view(spark, sf_dir, "v5").withColumn("word_count", F.lit(60))
    text = plan(describe.chunk_quality(chunks))
    scans = [line for line in text.split("\n") if "Scan parquet" in line]
    assert scans and all("chunk_text" not in line and "text:" not in line for line in scans)


def test_a_large_csv_is_split_unless_it_has_line_feeds(spark, tmp_path):
    path = str(tmp_path / "large.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "12345,some words in a row\n" * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        schema = "a int, b string"
        assert tables.read_csv(spark, path, schema).rdd.getNumPartitions() > 2
        assert tables.read_csv(spark, path, schema, multiline=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_hot_year_is_written_by_several_tasks(spark, tmp_path):
    """The rows of one year exceed the advisory partition size several times over."""
    import os
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 60_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 2004).otherwise(F.col("id") % 20 + 1990).alias("year"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        tables.write_table(rows, str(tmp_path / "t"), partition_by=["year"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(tmp_path / "t" / "year=2004") if f.endswith(".parquet")]
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "t")).count() == 60_000


def test_a_crowded_day_is_cut_into_ranges(spark, monkeypatch):
    """A third of all filings belong to one company on one day; lag over it equals the plain window."""
    from pyspark.sql import Window
    monkeypatch.setattr(joins, "FILINGS_PER_RANGE", 20)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("company"),
        F.format_string("f%06d", (F.col("id") * 7919) % 3001).alias("filing_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2004-01-05").cast("date")).otherwise(
            F.date_add(F.lit("2004-01-01").cast("date"), (F.col("id") % 9).cast("int"))).alias("filing_date"))
    rows = rows.unionByName(rows.limit(0)).unionByName(spark.createDataFrame(
        [("hot", "g1", None), ("hot", "g2", None)], "company string, filing_id string, day string").select(
            "company", "filing_id", F.lit("2004-02-01").cast("date").alias("filing_date")))
    plain = rows.withColumn("p", F.lag("filing_id").over(Window.partitionBy("company").orderBy("filing_date", "filing_id")))
    got = joins.previous_filings(rows).select("filing_id", "reference_filing_id")
    assert got.exceptAll(plain.select("filing_id", "p")).count() == 0 and got.count() == 3002


def test_forest_pool_does_not_grow_with_the_table():
    def share(n, pool=76_800):
        return min(1.0, (pool + 6 * pool ** 0.5) / n)
    assert share(10 ** 12) * 10 ** 12 == share(10 ** 8) * 10 ** 8 < 80_000


def test_quantiles_keep_large_integers_apart(spark):
    base = 2 ** 53
    rows = spark.createDataFrame([(base + 1,), (base + 2,), (base + 3,)], "x bigint")
    values = ranks.value_table(rows, "x", {"n": F.lit(1)})
    assert sorted(r["value"] for r in values.collect()) == [base + 1, base + 2, base + 3]
    assert ranks.exact_quantiles(rows, "x", (0.5,), names=["m"]).first()["m"] == float(base + 2)


def test_a_level_limit_holds_for_each_column(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("many"), F.lit("one").alias("single"))
    with pytest.raises(ValueError, match="many"):
        vectors.one_hot(rows, ["many", "single"], most_levels=20)
    coded = vectors.one_hot_vector(rows, ["many", "single"], "v")
    assert coded.columns == ["v"] and coded.first()["v"].size == 29


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 450000).select("o_orderkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_threshold_splits_do_not_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    assert "Exchange" not in plan(splits.stratified_split(rows, "o_orderkey", "o_orderstatus", exact=False))
    assert "Exchange" not in plan(splits.sample_fraction(rows, "o_orderkey", 0.25))


def test_global_ranks_have_no_single_partition_sort(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    text = plan(splits.shuffled_split(rows, "id"))
    row_window = [part for part in text.split("Window [") if "row_number()" in part.split("\n")[0]]
    assert row_window and all("SinglePartition" not in part.split("Window")[0].split("SortMergeJoin")[0] for part in row_window)


def test_rank_filters_run_before_the_shuffle(spark, sf_dir):
    text = plan(dedup.earliest_filings(view(spark, sf_dir, "v1"), "cik", "filing_id", "filing_date", "filing_type", (1993, 1996), 3))
    assert text.count("WindowGroupLimit") >= 4


def test_duplicates_shuffle_hashes_not_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = plan(dedup.duplicate_share(docs, ["text"]))
    keys = [line for line in text.split("\n") if "Exchange hashpartitioning(" in line and "REPARTITION" not in line]
    assert keys and all("hashpartitioning(_groupingexpression" in line for line in keys)


def test_hot_values_are_one_row_before_ordering(spark, monkeypatch):
    """A third of all rows share one score, and ranges are tiny."""
    monkeypatch.setattr(ranks, "VALUES_PER_RANGE", 10)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("s"))
    curve = ranks.prefix_counts(rows, "s", {"n": F.lit(1)}).orderBy("value").collect()
    total = 0
    for r in curve:
        total += r["n"]
        assert r["cum_n"] == total and r["total_n"] == 3000
    assert max(r["n"] for r in curve) == 1001 or max(r["n"] for r in curve) == 1000


def test_a_hot_company_keeps_every_filing(spark):
    """A third of all filings belong to one company; lag over it equals the plain window."""
    from pyspark.sql import Window
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("company"),
        F.format_string("f%06d", F.col("id")).alias("filing_id"),
        F.date_add(F.lit("2004-01-01").cast("date"), (F.col("id") % 37).cast("int")).alias("filing_date"))
    plain = rows.withColumn("p", F.lag("filing_id").over(Window.partitionBy("company").orderBy("filing_date", "filing_id")))
    got = joins.previous_filings(rows).select("filing_id", "reference_filing_id")
    assert got.exceptAll(plain.select("filing_id", "p")).count() == 0 and got.count() == 3000


def test_hot_copies_are_kept_whole(spark):
    """A third of all rows are copies of one text: counts, rows and leaks equal a plain count."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), (F.col("id") % 900).cast("string"))).alias("mda"),
        (F.col("id") % 5 == 0).cast("int").alias("fraudulent"), (F.lit(2010) + F.col("id") % 14).alias("y"))
    local = [tuple(r) for r in rows.collect()]
    count, labels, seen = {}, {}, set()
    for _, t, label, y in local:
        count[t] = count.get(t, 0) + 1
        labels.setdefault(t, set()).add(label)
        if y <= 2017:
            seen.add(t)
    keyed = dedup.with_text_key(rows, "mda")
    ids = {r["id"] for r in dedup.duplicate_text_rows(keyed).collect()}
    assert ids == {i for i, t, _, _ in local if count[t] > 1}
    ids = {r["id"] for r in dedup.conflicting_label_rows(keyed).collect()}
    assert ids == {i for i, t, _, _ in local if len(labels[t]) > 1}
    train, test = F.col("y") <= 2017, F.col("y") > 2017
    ids = {r["id"] for r in dedup.leaked_rows(keyed, train, test).collect()}
    assert ids == {i for i, t, _, y in local if y > 2017 and t in seen}
    kept = {r["id"] for r in dedup.drop_repeated_negatives(rows, ["mda"]).collect()}
    assert kept == {i for i, t, label, _ in local if label == 1 or count[t] == 1}


def test_a_hot_stratum_is_drawn_exactly(spark):
    from pyspark.sql import Window

    from filingsift.functions.keys import draw_key
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 200).cast("string")).alias("s"))
    got = ranks.rank_by_draw(rows, "id", 1, ["s"]).select("id", "draw_rank", "stratum_size")
    plain = rows.select("id", F.row_number().over(Window.partitionBy("s").orderBy(draw_key(1, "id"), "id")).cast("bigint"),
                        F.count("*").over(Window.partitionBy("s")))
    assert got.exceptAll(plain).count() == 0 and got.count() == 5000
