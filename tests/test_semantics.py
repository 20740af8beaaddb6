"""Hand-made rows for the rules that are easy to get wrong."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingsift.functions import fields, text as tx
from filingsift.operators import audit, dedup, describe, evaluate, joins, ranks, splits, vectors
from filingsift.plans import corpus
from filingsift.sources import tables as src


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, text, expr):
    return frame(spark, [(text,)], "t string").select(expr.alias("v")).first()["v"]


def day(y, m, d):
    return dt.date(y, m, d)


def test_url_removal_follows_punctuation_by_default(spark):
    text = "See https://example.org/a?b=1 now"
    assert one(spark, text, tx.normalize_mda("t")) == "see https example org a b 1 now"
    assert one(spark, text, tx.normalize_mda("t", fixed_order=True)) == "see now"


def test_normalize_keeps_unicode_words_and_spaces(spark):
    assert one(spark, "Café Ünïon  «x²»\t'q'\n", tx.normalize_mda("t")) == "café ünïon x² q "
    assert one(spark, None, tx.normalize_mda("t")) == ""


def test_strip_markup(spark):
    html = "<p title=\"a>b\">Hi &amp; bye</p><!-- no --><script>if (a<b) {}</script><STYLE>p{}</STYLE> 1 < 2 &#8364;&nbsp;x"
    assert one(spark, html, tx.strip_markup("t")) == "Hi & bye 1 < 2 € x"
    assert one(spark, None, tx.strip_markup("t")) == ""


def test_text_metrics(spark):
    assert one(spark, "a bb\x1cccc  ", tx.word_count("t")) == 3
    assert one(spark, None, tx.word_count("t")) == 0
    assert one(spark, "", tx.word_density("t")) == 0
    assert one(spark, "😀b c", tx.char_count("t")) == 4


def test_ratios(spark):
    assert one(spark, "ÀÉab1", tx.uppercase_ratio("t")) == 0.5
    assert one(spark, "123", tx.uppercase_ratio("t")) == 0
    assert one(spark, "aé", tx.non_ascii_ratio("t")) == 0.5
    assert one(spark, None, tx.non_ascii_ratio("t")) == 0
    assert one(spark, "The company xyz qqq", tx.english_indicator("t")) == 0.5
    assert one(spark, "the x y z", tx.english_indicator("t", max_words=1)) == 1.0


def test_duplicate_normalization(spark):
    assert one(spark, " ﬁne &amp; Ｗide \n", tx.normalize_for_duplicates("t")) == "fine & wide"
    assert one(spark, None, tx.normalize_for_duplicates("t")) == ""


def test_tokens(spark):
    assert one(spark, "A an _x x1y seventeenletterword naïve", tx.topic_tokens("t")) == ["an", "naïve"]
    assert one(spark, "The cat, a dog_1", tx.unigrams_and_bigrams(tx.term_tokens("t", ["the"]))) == ["cat", "dog_1", "cat dog_1"]
    assert one(spark, "", tx.unigrams_and_bigrams(tx.term_tokens("t"))) == []
    words = F.split("t", " ")
    assert one(spark, "a b c d e", tx.token_windows(words, 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert one(spark, "a b c d e", tx.token_windows(words, 2, 2)) == [["a", "b"], ["c", "d"]]


def test_dates(spark):
    df = frame(spark, [("31-12-2004", "2004-01-02T03:04", "02-2004", "29-02")], "a string, b string, c string, d string")
    row = df.select(fields.parse_date("a", "dd-MM-yyyy"), fields.parse_timestamp_day("b"), fields.month_end("c"),
                    fields.fiscal_year_end("d"), fields.parse_date("b")).first()
    assert list(row) == [day(2004, 12, 31), day(2004, 1, 2), day(2004, 2, 29), None, None]


def test_interval_label_adds_a_calendar_year(spark):
    rows = [(1, day(2005, 2, 28)), (2, day(2005, 3, 1)), (3, day(2004, 1, 31)), (4, day(2004, 2, 1))]
    filings = frame(spark, [(1, i, d) for i, d in rows], "cik int, id int, reporting_date date")
    enforcement = frame(spark, [(1, day(2004, 2, 1), day(2004, 2, 29)), (1, None, None)], "cik int, fraud_start date, fraud_end date")
    out = joins.label_filings(joins.attach_enforcement(filings, enforcement))
    assert out.count() == 8
    assert {r["id"] for r in out.filter("fraudulent = 1").collect()} == {1, 4}


def test_repeated_negatives_all_go_positives_stay(spark):
    rows = [("a", None, 0), ("a", None, 0), ("b", "x", 1), ("b", "x", 1), ("c", "x", 0), ("c", "x", 1), ("d", "y", 0)]
    out = dedup.drop_repeated_negatives(frame(spark, rows, "k string, m string, fraudulent int"), ["k", "m"])
    assert sorted(tuple(r) for r in out.collect()) == [("b", "x", 1), ("b", "x", 1), ("c", "x", 1), ("d", "y", 0)]


def test_anti_join_treats_nulls_as_equal(spark):
    general = frame(spark, [("a", None), ("a", "x"), (None, None), ("1:a", "")], "k string, m string")
    known = frame(spark, [("a", None), (None, None), ("1", ":a")], "k string, m string")
    out = joins.drop_known(general, known, ["k", "m"])
    assert sorted(tuple(r) for r in out.collect()) == [("1:a", ""), ("a", "x")]


def test_null_states_count_as_different(spark):
    df = frame(spark, [("NY", "NY"), ("NY", None), (None, None), ("NY", "DE")], "a string, b string")
    assert [r[0] for r in df.select(fields.differs("a", "b")).collect()] == [False, True, True, True]


def test_industry_codes(spark):
    df = frame(spark, [(1, "1044"), (2, "0100"), (3, None), (4, "1800"), (5, "abcd"), (6, "9999")], "id int, sic string")
    fixed = fields.correct_industry(df, {"1044": "1040"}, frame(spark, [(2, "1311")], "id int, sic string"), "id")
    got = {r["id"]: (r["sic"], r["d"]) for r in fixed.withColumn("d", fields.industry_division()).collect()}
    assert got == {1: ("1040", "Division B"), 2: ("1311", "Division B"), 3: (None, "Unknown"), 4: ("1800", "Unknown"),
                   5: ("abcd", "Unknown"), 6: ("9999", "Division K")}
    assert df.filter("id = 2").select(fields.industry_division()).first()[0] == "Division A"


def test_unknown_flags_keep_ones_and_other_rows(spark):
    df = frame(spark, [("a", 0, 1), ("b", 0, 1), ("a", None, 0)], "id string, f int, g int")
    for ids in (["a"], frame(spark, [("a",), ("a",)], "id string")):
        got = sorted((tuple(r) for r in fields.unknown_flags(df, "id", ids, ["f", "g"]).collect()), key=str)
        assert got == sorted([("a", None, 1), ("b", 0, 1), ("a", None, None)], key=str)


def test_missingness_counts_nulls_as_empty(spark):
    df = frame(spark, [(None, 1), ("", None), ("  ", 2), ("x", 3)], "s string, n int")
    got = {r["column"]: tuple(r)[1:] for r in audit.missingness(df).collect()}
    assert got == {"s": (1, 2, 1, 25.0), "n": (1, 0, 0, 25.0)}


def test_thresholds_differ_by_operator(spark):
    df = frame(spark, [(199, 0), (200, 0), (201, 0), (201, 1), (20000, 0), (20001, 0)], "word_count int, amend_filing int")
    assert corpus.analysis_rows(df).count() == 3
    assert corpus.long_enough(df).count() == 5
    assert audit.short_documents(df, "word_count").count() == 1
    assert audit.long_documents(df, "word_count").count() == 1


def test_stored_word_count_null_is_dropped(spark):
    df = frame(spark, [("a " * 300, None), ("a " * 300, "x"), ("a", "250.5")], "mda string, word_count string")
    assert [r["mda"] for r in corpus.long_enough(df).collect()] == ["a"]
    assert corpus.long_enough(df.drop("word_count")).count() == 2


def test_valid_rows(spark):
    rows = [("t", "2004-01-02", "1"), (None, "2004-01-02", "1"), ("t", "02.01.2004", "0"), ("t", "2004-01-02", "2"), ("t", "2004-01-02", "no")]
    out = corpus.valid_rows(frame(spark, rows, "mda string, filing_date string, fraudulent string")).collect()
    assert [tuple(r) for r in out] == [("t", day(2004, 1, 2), 1)]


def test_required_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        src.require_columns(frame(spark, [(1,)], "a int"), ["a", "b", "c"])


def test_conflicts_and_leaks(spark):
    df = frame(spark, [("A b", 0, 2010), ("a  B", 1, 2019), ("", 0, 2010), (None, 1, 2019), ("c", 1, 2019), ("c", 1, 2020)],
               "mda string, fraudulent int, y int")
    keyed = dedup.with_text_key(df, "mda")
    assert dedup.conflicting_label_rows(keyed).count() == 2
    assert dedup.duplicate_text_rows(keyed).count() == 4
    train, test = F.col("y") <= 2017, F.col("y") >= 2018
    assert [r["mda"] for r in dedup.leaked_rows(keyed, train, test).collect()] == ["a  B"]
    assert tuple(dedup.leak_share(keyed, train, test).first()) == (1, 4, 25.0)


def test_unique_checks(spark):
    df = frame(spark, [(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in dedup.key_offenders(df, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        dedup.require_unique(df, ["k"])


def test_review_gate(spark):
    cand = frame(spark, [("a", "text"), ("b", "text"), ("c", "  "), ("d", "text")], "filing_id string, section_text string")
    yes = (" Accept", "YES", "yes ", "No", "")
    reviews = frame(spark, [("a", *yes), ("b", "accept", "yes", "no", "no", ""), ("c", *yes)],
                    "filing_id string, review_decision string, correct_start string, correct_end string, toc_contamination string, review_notes string")
    assert [r["filing_id"] for r in joins.accepted_sections(cand, reviews).collect()] == ["a"]
    with pytest.raises(ValueError):
        joins.accepted_sections(cand, reviews.unionByName(reviews))


def test_overlap_regions_and_box(spark):
    df = frame(spark, [(1, 1, 0), (1, 1, 0), (0, 0, 0), (None, 0, 1)], "a int, b int, c int")
    assert sorted(tuple(r) for r in describe.flag_overlap(df, ["a", "b", "c"]).collect()) == [(0, 0, 1, 1), (1, 1, 0, 2)]
    box = describe.box_summary(frame(spark, [(float(x),) for x in [1, 2, 3, 4, 5, 100]], "x double"), "x").first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 5.0, 1)


def test_histogram_puts_the_maximum_into_the_last_bin(spark):
    bins = describe.histogram(frame(spark, [(0.0,), (1.0,), (10.0,)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [2, 0, 0, 0, 1]
    flat = describe.histogram(frame(spark, [(3.0,), (3.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["n"]) for r in flat] == [(2.5, 0), (3.0, 2)]


def test_sparse_one_hot_visits_no_place_that_a_row_leaves_empty(spark, monkeypatch):
    from pyspark.ml.feature import VectorSlicer
    monkeypatch.setattr(VectorSlicer, "_transform", lambda *_: pytest.fail("slicing walks over all levels for every row"))
    out = vectors.one_hot_sparse(frame(spark, [("b",), ("a",), (None,), ("c",), ("b",)], "x string"), "x", "v")
    assert out.columns == ["x", "v"]
    found = {(r["x"], r["v"].size, tuple(r["v"].indices), tuple(r["v"].values)) for r in out.collect()}
    assert found == {("a", 2, (), ()), ("b", 2, (0,), (1.0,)), ("c", 2, (1,), (1.0,)), (None, 2, (), ())}


def test_one_hot_drops_first_level_and_nulls(spark):
    out = vectors.one_hot(frame(spark, [("b",), ("a",), (None,), ("c",)], "x string"), ["x"])
    assert sorted(out.columns) == ["x_b", "x_c"]
    assert sorted(tuple(r) for r in out.select("x_b", "x_c").collect()) == [(0, 0), (0, 0), (0, 1), (1, 0)]


def test_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_RANGE", 50)
    values = np.round(np.random.default_rng(1).normal(size=999), 2)
    df = frame(spark, [(float(v), int(i % 3)) for i, v in enumerate(values)], "x double, g int")
    probs = (0.0, 0.02, 0.25, 0.5, 0.9, 1.0)
    got = ranks.exact_quantiles(df, "x", probs, names=list("abcdef")).first()
    assert np.allclose(list(got)[1:], np.quantile(values, probs))
    for row in ranks.exact_quantiles(df, "x", probs, ["g"], list("abcdef")).collect():
        assert np.allclose(list(row)[2:], np.quantile(values[np.arange(999) % 3 == row["g"]], probs))


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


def test_areas(spark, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_RANGE", 7)
    rng = np.random.default_rng(2)
    y, s = (rng.random(200) < 0.2).astype(int), np.round(rng.random(200), 1)
    df = frame(spark, [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id int, y int, s double")
    assert abs(evaluate.roc_auc(df, "y", "s").first()[0] - brute_auc(y, s)) < 1e-12
    flipped = evaluate.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert abs(flipped - (1 - brute_auc(y, s))) < 1e-12
    order = sorted(set(s), reverse=True)
    ap, before = 0.0, 0
    for t in order:
        tp, said = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        ap, before = ap + (tp - before) / y.sum() * tp / said, tp
    assert abs(evaluate.average_precision(df, "y", "s").first()[0] - ap) < 1e-12
    points = evaluate.roc_curve(df, "y", "s", drop_intermediate=False).count()
    assert points == len(order) + 1
    with pytest.raises(ValueError):
        evaluate.roc_auc(df.filter("y = 0"), "y", "s")


def test_step_average_precision_is_not_interpolated(spark):
    df = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5)], "y int, s double")
    assert abs(evaluate.average_precision(df, "y", "s").first()[0] - (1 + 2 / 3 + 3 / 4) / 3) < 1e-12


def test_top_k_skips_k_above_n_and_guards_recall(spark):
    df = frame(spark, [(i, 0, float(i)) for i in range(60)], "id int, y int, s double")
    assert [tuple(r) for r in evaluate.precision_recall_at(df, "y", "s", "id").collect()] == [(50, 0, 0.0, 0.0)]


def test_class_report_zero_division(spark):
    df = frame(spark, [(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["name"]: r for r in evaluate.class_report(df, "y", "p").collect()}
    assert rows["1"]["precision"] == 0 and rows["1"]["f1"] == 0 and abs(rows["0"]["f1"] - 0.8) < 1e-12
    assert [tuple(r) for r in evaluate.confusion_matrix(df, "y", "p").collect()] == [(0, 2, 0), (1, 1, 0)]


def test_early_release_filter_and_extremes(spark):
    df = frame(spark, [(day(2004, 1, 1), day(2004, 1, 1)), (day(2003, 12, 31), day(2004, 1, 1))], "release_date date, fraud_end date")
    assert describe.drop_early_releases(df).count() == 1
    ties = frame(spark, [("b", 2), ("a", 2), ("c", 1)], "k string, n int")
    assert [r["k"] for r in describe.extreme(ties, "n", 2, "k").collect()] == ["a", "b"]
    assert describe.rows_at_maximum(ties, "n").count() == 2


def test_manifest(spark):
    body = "x" * 2000
    df = frame(spark, [(1, "<!DOCTYPE html>" + body), (2, "<html>short"), (3, body), (4, "<html>Access DENIED" + body), (5, None)], "id int, html string")
    got = {r["id"]: r for r in src.document_manifest(df, "id", "html").collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["downloaded", "failed", "failed", "failed", "failed"]
    assert got[1]["bytes"] == 2015 and len(got[1]["sha256"]) == 64 and got[4]["bytes"] == 0


def test_csv_null_conventions_and_json_array(spark, tmp_path):
    df = frame(spark, [(1, None, 'say "hi"\nthere'), (2, "a;b", "x")], "id int, s string, t string")
    src.write_table(df, str(tmp_path / "c"), "csv")
    schema = "id int, s string, t string"
    assert {tuple(r) for r in src.read_csv(spark, str(tmp_path / "c"), schema, multiline=True).collect()} == {(1, None, 'say "hi"\nthere'), (2, "a;b", "x")}
    assert src.read_csv(spark, str(tmp_path / "c"), schema, keep_empty=True, columns=["s"], multiline=True).filter("s = ''").count() == 1
    (tmp_path / "a.json").write_text('[{"id": 1, "s": "x"}, {"id": 2}]')
    assert src.read_json_records(spark, str(tmp_path / "a.json"), "id int, s string", single_array=True).count() == 2


def test_cached_features_guard(spark, tmp_path):
    keys = frame(spark, [(1,), (2,)], "k int")
    path = str(tmp_path / "f")
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("v", F.col("k") * 2)
    src.cached_features(keys, "k", path, build)
    assert src.cached_features(keys, "k", path, build).count() == 2 and len(calls) == 1
    with pytest.raises(ValueError, match="expected"):
        src.cached_features(frame(spark, [(1,), (2,), (3,)], "k int"), "k", path, build)
    with pytest.raises(ValueError, match="miss"):
        src.cached_features(frame(spark, [(1,), (3,)], "k int"), "k", path, build)


def test_previous_filing_within_and_across_days(spark):
    rows = [("a", "f1", day(2004, 1, 1)), ("a", "f2", day(2004, 1, 1)), ("a", "f3", day(2005, 1, 1)), ("b", "f4", day(2004, 1, 1)),
            ("a", "f3", day(2005, 1, 1))]
    got = {r["filing_id"]: (r["reference_filing_id"], r["reference_filing_date"]) for r in
           joins.previous_filings(frame(spark, rows, "company string, filing_id string, filing_date date")).collect()}
    assert got == {"f1": (None, None), "f2": ("f1", day(2004, 1, 1)), "f3": ("f2", day(2004, 1, 1)), "f4": (None, None)}


def test_draws_do_not_depend_on_partitioning(spark):
    base = spark.range(3000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    results = []
    for n in (1, 8, 64):
        df = base.repartition(n)
        parts = [splits.stratified_split(df, "id", "y"), splits.shuffled_split(df, "id"), splits.hide_positives(df, "id", "y", 20)]
        results.append([sorted(tuple(r) for r in p.select("id", p.columns[-1]).collect()) for p in parts])
    assert results[0] == results[1] == results[2]
    split = splits.stratified_split(base, "id", "y")
    sizes = {(r["y"], r["split"]): r["n"] for r in split.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert sizes[(1, "validation")] == round(429 * 0.2) and sizes[(0, "validation")] == round(2571 * 0.2)


def test_hiding_more_extends_hiding_less(spark):
    df = spark.range(500).select("id", F.lit(1).alias("y"))
    few = {r["id"] for r in splits.hide_positives(df, "id", "y", 10).filter("pu_label = 0").collect()}
    more = {r["id"] for r in splits.hide_positives(df, "id", "y", 30).filter("pu_label = 0").collect()}
    assert len(few) == 10 and len(more) == 30 and few < more


def test_scratch_follows_the_cluster_setting():
    from types import SimpleNamespace

    from filingsift.session import shared_dir

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))
    assert shared_dir(session(spark_checkpoint_dir="hdfs://shared/x", spark_master="yarn")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        shared_dir(session(spark_master="yarn"))


def test_sketches_come_close(spark):
    df = spark.range(2000).select((F.col("id") + 1).alias("w"), F.lit("x").alias("city"), F.col("id").alias("cik"))
    assert abs(audit.length_percentiles(df, "w", approximate=True).first()["p50"] - 1000.5) <= 2
    assert abs(describe.distinct_companies(df, ["city"], approximate=True).first()["companies"] - 2000) < 100


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html>" + "x" * 1500)
    (tmp_path / "b.html").write_text("<html>")
    docs = src.read_documents(spark, str(tmp_path))
    got = src.document_manifest(docs, "path", "content").orderBy("path").collect()
    assert [r["status"] for r in got] == ["downloaded", "failed"] and got[0]["bytes"] == 1506
