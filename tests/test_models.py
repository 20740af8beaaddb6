"""Properties of the jobs SQL cannot state."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingsift.functions import text as tx
from filingsift.operators import classify, evaluate, forest, novelty, splits, svd, topics, vectors, vocab
from filingsift.plans import anomaly_job
from filingsift.session import materialize


@pytest.fixture(scope="module")
def blobs(spark):
    """Two noisy classes in five dimensions and one far outlier."""
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.3).astype(int)
    x = rng.normal(size=(600, 5)) + y[:, None] * 1.5
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(600)]
    return materialize(spark.createDataFrame(rows, "id int, v array<double>, y int"), "blobs")


@pytest.fixture(scope="module")
def parts(blobs):
    split = materialize(splits.stratified_split(blobs, "id", "y", 0.3, 1, names=("train", "test")), "split")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def test_forest_isolates_a_planted_outlier(spark, blobs):
    odd = blobs.unionByName(spark.createDataFrame([(9999, [40.0] * 5, 0)], blobs.schema))
    model = forest.fit_isolation_forest(odd, "id", "v", trees=60, contamination=0.02)
    scored = forest.anomaly_scores(odd, model, "v")
    top = scored.orderBy(F.col("anomaly_score").desc()).first()
    assert top["id"] == 9999
    above = scored.filter("anomaly_score > 0").count()
    assert abs(above - 0.02 * 601) <= 1.5
    assert model.nodes.agg(F.countDistinct("tree")).first()[0] == 60
    assert model.nodes.agg(F.max("depth")).first()[0] <= 8


def test_forest_does_not_depend_on_partitioning(blobs):
    got = []
    for n in (1, 8, 64):
        model = forest.fit_isolation_forest(blobs.repartition(n), "id", "v", trees=20, sample=64)
        rows = forest.anomaly_scores(blobs, model, "v").orderBy("id").select("anomaly_score").collect()
        got.append([round(r[0], 9) for r in rows])
    assert got[0] == got[1] == got[2]


def test_forest_save_and_load(spark, blobs, tmp_path):
    model = forest.fit_isolation_forest(blobs, "id", "v", trees=10)
    model.save(str(tmp_path / "m"))
    back = forest.ForestModel.load(spark, str(tmp_path / "m"))
    a, b = (forest.anomaly_scores(blobs, m, "v").agg(F.sum("anomaly_score")).first()[0] for m in (model, back))
    assert abs(a - b) < 1e-9


def test_forest_path_lengths():
    assert forest.mean_path(1) == 0 and forest.mean_path(2) == 1
    expected = 2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256
    assert abs(float(forest.mean_path(256)) - expected) < 1e-12


def sparse(spark, x):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, indices array<int>, weights array<double>")


def test_svd_agrees_with_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.random((80, 30)) * (rng.random((80, 30)) < 0.3)
    x[:, :3] *= 6
    rows = sparse(spark, x)
    model = svd.fit_svd(rows, 30, 80, 6, passes=12)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular_values, s[:6], rtol=1e-6)
    assert np.allclose(model.components @ model.components.T, np.eye(6), atol=1e-9)
    assert np.allclose(np.abs(model.components @ vt[:6].T), np.eye(6), atol=1e-4)
    z = x @ model.components.T
    assert abs(model.explained_variance_ratio - z.var(axis=0).sum() / x.var(axis=0).sum()) < 1e-9
    got = np.array([r["vector"] for r in svd.project(rows, model, "id").orderBy("id").collect()])
    assert np.allclose(got, z)
    model.save(spark, str(tmp_path / "svd"))
    assert np.allclose(svd.SvdModel.load(spark, str(tmp_path / "svd")).components, model.components)


def test_tfidf_weights_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum")], "id int, t string")
    model = vocab.fit_tfidf(docs, "id", "t", [], min_df=1, max_df=1.0)
    got = {(r["id"], r["term"]): r["weight"] for r in
           vocab.weigh(vocab.tfidf_counts(docs, "id", "t", []), model, "id").collect()}
    rare = math.log(3 / 2) + 1
    raw = {"apple": 1 + math.log(2), "pear": rare, "apple apple": rare, "apple pear": rare}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    for term, w in raw.items():
        assert abs(got[(1, term)] - w / norm) < 1e-12
    assert "plum apple" not in {t for _, t in got}


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_term_totals_are_those_of_the_counts_and_leave_a_task_once(spark, monkeypatch, block):
    from collections import Counter
    monkeypatch.setattr(vocab, "BLOCK_WORDS", block)
    texts = ["b a b", "", None, "a", "\u00e9 b a b a", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    words = F.split("t", " ")
    each = {}
    for i, t in enumerate(texts):
        if t is not None:
            w = t.split(" ")
            each[i] = Counter(w + [" ".join(p) for p in zip(w, w[1:])])
    counts = {(r["id"], r["term"]): r["tf"] for r in vocab.term_counts(docs, "id", words, pairs=True).collect()}
    assert counts == {(i, t): n for i, c in each.items() for t, n in c.items()}
    totals = {r["term"]: (r["df"], r["cf"]) for r in vocab.term_totals(docs, words, pairs=True).collect()}
    assert totals == {t: (sum(t in c for c in each.values()), sum(c[t] for c in each.values())) for t in set().union(*each.values())}
    # no table of all terms of a task before they are dealt by term
    plan = vocab.term_totals(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Exchange"):]


def test_tfidf_vocabulary_limits(spark):
    docs = spark.createDataFrame([(i, "common " + ("often " if i < 4 else "") + f"w{i}") for i in range(10)], "id int, t string")
    model = vocab.fit_tfidf(docs, "id", "t", ["common"], min_df=2, max_df=0.95)
    assert [r["term"] for r in model.vocabulary.collect()] == ["often"]
    top = vocab.fit_tfidf(docs, "id", "t", [], min_df=1, max_df=1.0, max_terms=2)
    assert {r["term"] for r in top.vocabulary.collect()} == {"common", "common often"} or \
        {r["term"] for r in top.vocabulary.collect()} == {"common", "often"}


def chunk_rows(spark, rows):
    import datetime as dt
    rows = [(c, f, dt.date(y, 1, 1), f"{f}_{i}", i, t) for c, f, y, i, t in rows]
    return spark.createDataFrame(rows, "company string, filing_id string, filing_date date, chunk_id string, chunk_number int, chunk_text string")


def test_novelty_categories(spark):
    rows = [("a", "a1", 2004, 1, "interest rates may rise quickly"), ("a", "a1", 2004, 2, "supply chain trouble"),
            ("a", "a1", 2004, 3, "interest rates may rise quickly"),
            ("a", "a2", 2005, 1, "interest rates may rise quickly"), ("a", "a2", 2005, 2, "zebra xylophone"),
            ("a", "a2", 2005, 3, "supply chain trouble and unrelated further words"), ("b", "b1", 2005, 1, "alone here")]
    got = {r["chunk_id"]: r for r in novelty.score_chunks(chunk_rows(spark, rows)).collect()}
    assert len(got) == 7
    same = got["a2_1"]
    assert same["matched_chunk_id"] == "a1_1" and abs(same["max_similarity"] - 1) < 1e-9
    assert same["boilerplate_category"] == "potential_boilerplate" and same["reference_filing_id"] == "a1"
    none = got["a2_2"]
    assert (none["scoring_status"], none["max_similarity"], none["novelty_score"], none["matched_chunk_id"]) == ("no_shared_terms", 0.0, 1.0, None)
    first = got["b1_1"]
    assert (first["boilerplate_category"], first["max_similarity"]) == ("no_history", None)
    with pytest.raises(ValueError):
        novelty.score_chunks(chunk_rows(spark, rows), high=0.3, low=0.4)


def test_chunk_ids_may_repeat_across_filings(spark):
    """Chunks numbered within each filing: nothing is multiplied, and matches stay in the reference filing."""
    rows = [("a", "a1", 2004, 1, "interest rates may rise quickly"), ("a", "a1", 2004, 2, "supply chain trouble"),
            ("a", "a2", 2005, 1, "supply chain trouble again"), ("a", "a2", 2005, 2, "interest rates may rise quickly"),
            ("b", "b1", 2004, 1, "rates of another firm"), ("b", "b2", 2005, 1, "interest rates may rise quickly"), ("b", "b2", 2005, 2, "rates")]
    unique = chunk_rows(spark, rows)
    repeated = unique.withColumn("chunk_id", F.format_string("c%d", "chunk_number"))
    want = {(r["filing_id"], r["chunk_number"]): (r["matched_chunk_text"], round(r["max_similarity"] or 0, 9)) for r in novelty.score_chunks(unique).collect()}
    got = novelty.score_chunks(repeated).collect()
    assert len(got) == 7
    assert {(r["filing_id"], r["chunk_number"]): (r["matched_chunk_text"], round(r["max_similarity"] or 0, 9)) for r in got} == want
    with pytest.raises(ValueError):
        novelty.score_chunks(repeated.unionByName(repeated.limit(1)))


def test_a_filing_of_many_chunks(spark):
    """20,000 chunks in one filing: the frequent words do not pair all of them."""
    rows = spark.range(20_000).select(
        F.lit("a").alias("company"), F.lit("a1").alias("filing_id"), F.lit("2004-01-01").cast("date").alias("filing_date"), F.col("id").alias("chunk_id"),
        F.col("id").cast("int").alias("chunk_number"), F.concat(F.lit("the report of item "), F.md5((F.col("id") % 15_000).cast("string"))).alias("chunk_text"))
    later = rows.filter("chunk_id % 4 = 0").withColumns({"filing_id": F.lit("a2"), "filing_date": F.lit("2005-01-01").cast("date")})
    out = novelty.score_chunks(rows.unionByName(later)).filter("filing_id = 'a2'")
    assert out.count() == 5_000 and out.filter("max_similarity < 0.999999").count() == 0
    assert out.filter(F.col("matched_chunk_id") != F.col("chunk_id") % 15_000).count() == 0


def brute_matches(spark, past, now):
    joined = now.join(past.select("ref", F.col("rep").alias("match"), F.col("rep_number").alias("number"), "term", F.col("w").alias("p")), ["ref", "term"])
    scored = {}
    for r in joined.groupBy("ref", "rep", "match", "number").agg(F.sum(F.col("w") * F.col("p")).alias("dot")).collect():
        key = (-round(r["dot"], 12), r["number"], r["match"])
        scored[(r["ref"], r["rep"])] = min(scored.get((r["ref"], r["rep"]), key), key)
    return {k: v[2] for k, v in scored.items()}


@pytest.mark.parametrize("frequent", [0, 3, 10 ** 9])
def test_bounded_search_is_exhaustive(spark, frequent):
    """A filing with a very large share of the rows, copies included, and every word frequent somewhere."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(40)]

    def text():
        return " ".join(rng.choice(words, size=rng.integers(2, 12), p=np.arange(40, 0, -1) / 820))
    rows = [("a", "a1", 2004, i, text()) for i in range(150)] + [("a", "a1", 2004, 150 + i, "w0 w1 w2") for i in range(60)]
    rows += [("a", "a2", 2005, i, text()) for i in range(60)] + [("a", "a2", 2005, 60 + i, "w0 w1") for i in range(30)]
    rows += [("b", "b1", 2004, i, text()) for i in range(5)] + [("b", "b2", 2005, i, text()) for i in range(5)]
    _, _, past, now = novelty.reference_weights(chunk_rows(spark, rows))
    past, now = materialize(past), materialize(now)
    got = {(r["ref"], r["rep"]): r["match"] for r in novelty.best_matches(past, now, frequent).collect()}
    assert got == brute_matches(spark, novelty.unit(past), novelty.unit(now))


def test_bounds_keep_few_candidates(spark):
    """Texts that share a frequent vocabulary and differ in rare words: the search completes few of the pairs that share a word."""
    rng = np.random.default_rng(5)

    def text(i):
        return " ".join([*rng.choice([f"common{j}" for j in range(12)], size=4), *[f"rare{i}_{j}" for j in range(3)]])
    first = [text(i) for i in range(300)]
    rows = [("a", "a1", 2004, i, t) for i, t in enumerate(first)] + [("a", "a2", 2005, i, first[i] + " added") for i in range(0, 300, 3)]
    _, _, past, now = novelty.reference_weights(chunk_rows(spark, rows))
    past, now = materialize(novelty.unit(past)), materialize(novelty.unit(now))
    held = past.select("ref", F.col("rep").alias("match"), F.col("rep_number").alias("match_number"), "term", F.col("w").alias("p"))
    able, left_out = novelty.candidates(now, held, 20)
    sharing = now.join(held, ["ref", "term"]).select("rep", "match").distinct().count()
    assert left_out.count() > 0 and 100 <= able.count() <= 200 and sharing > 15_000
    found = {(r["rep"], r["match"]) for r in able.collect()}
    assert found >= {(k[1], v) for k, v in brute_matches(spark, past, now).items()}


def test_weighted_forest_and_report(parts):
    train, test = parts
    model = classify.fit_random_forest(train, "v", "y", trees=20, depth=5)
    scored = classify.predict(model, test, "v")
    assert evaluate.roc_auc(scored, "y", "probability").first()[0] > 0.9
    assert scored.filter("probability < 0 or probability > 1").count() == 0


def test_windows_without_two_classes_keep_their_row(spark):
    rows = [(2003, "train", i % 2, [float(i % 2), 1.0]) for i in range(20)] + [(2003, "test", i % 2, [float(i % 2), 1.0]) for i in range(4)]
    rows += [(2004, "train", 0, [0.0, 1.0]), (2004, "test", 1, [0.0, 1.0]), (2005, "train", 1, [0.0, 1.0]), (2005, "train", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "window_end int, split string, y int, v array<double>")
    got = {r["window_end"]: r for r in classify.expanding_evaluation(df, "v", "y", trees=5).collect()}
    assert set(got) == {2003, 2004, 2005} and got[2003]["macro_f1"] == 1.0 and got[2003]["n"] == 4
    assert got[2004]["macro_f1"] is None and (got[2004]["train_rows"], got[2004]["test_rows"]) == (1, 1) and got[2005]["test_rows"] == 0


def test_windows_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading
    meeting, fit = threading.Barrier(2, timeout=60), classify.fit_random_forest

    def together(*args, **options):
        meeting.wait()
        return fit(*args, **options)
    monkeypatch.setattr(classify, "fit_random_forest", together)
    rows = [(end, split, [float(y), float(i)], y) for end in (2003, 2004) for split in ("train", "test") for i in range(8) for y in (0, 1)]
    windows = spark.createDataFrame(rows, "window_end int, split string, x array<double>, y int")
    out = classify.expanding_evaluation(windows, "x", "y", trees=5).collect()
    assert {r["window_end"]: (r["n"], r["macro_f1"]) for r in out} == {2003: (16, 1.0), 2004: (16, 1.0)}


def test_positive_unlabelled_scales_up(parts):
    train, test = parts
    hidden = splits.hide_positives(train, "id", "y", 40)
    fitted = classify.fit_positive_unlabelled(hidden, "id", "v", "pu_label", trees=20, depth=5)
    assert 0 < fitted[1] <= 1
    scored = classify.predict_positive_unlabelled(fitted, test, "v")
    assert scored.filter("probability < base_probability - 1e-12").count() == 0
    plain = scored.agg(F.count_if(F.col("base_probability") > 0.5)).first()[0]
    assert scored.filter("prediction = 1").count() >= plain


def test_sweep(parts):
    train, test = parts
    split = splits.shuffled_split(train, "id")
    sweep, hidden, scored = classify.sweep_and_refit(split.filter("split = 'train'").drop("split"), split.filter("split = 'validation'").drop("split"),
                                                     test, "id", "v", "y", step=40, trees=8, depth=4)
    rows = {r["hidden"]: r["pu_f1"] for r in sweep.collect()}
    assert sorted(rows)[:2] == [0, 40] and rows[hidden] == max(rows.values()) and scored.count() == test.count()


def test_topic_vectors_sum_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.topic_tokens("text").alias("tokens"))
    terms = topics.fit_vocabulary(docs, "doc_id", "tokens", 50_000)
    counted = topics.count_vectors(docs, "tokens", terms)
    model = topics.fit_topics(counted, k=4, passes=1, rate=0.5)
    out = topics.topic_vectors(model, counted, ["doc_id"])
    assert out.count() == docs.count()
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    # a document without a vocabulary term has no topics
    assert out.filter((F.abs(total - 1) > 1e-6) & (total != 0)).count() == 0
    scores = topics.coherence(docs, "tokens", topics.top_terms(model, terms, 5)).collect()
    assert len(scores) == 4 and all(-1 <= r["coherence"] <= 1 + 1e-9 for r in scores)


def test_pooling(spark):
    tokens = [(1, 0, [1.0, 0.0], 1), (1, 0, [3.0, 0.0], 1), (1, 0, [9.0, 9.0], 0), (1, 1, [0.0, 4.0], 1)]
    df = spark.createDataFrame(tokens, "doc int, chunk int, v array<double>, mask int")
    assert vectors.pool_tokens(df, "doc", "chunk", "v").first()["embedding"] == [1.0, 2.0]
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0])], "k int, v array<double>")
    row = vectors.validate_embeddings(bad, spark.createDataFrame([(1,), (3,)], "k int"), "k", "v").first()
    assert (row["non_finite"], row["missing_keys"], row["min_dim"], row["max_dim"], row["valid"]) == (1, 1, 1, 2, 0)


def test_scratch_is_empty_after_a_job(spark, blobs, tmp_path):
    import os

    from filingsift.session import scratch, shared_dir
    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        model = forest.fit_isolation_forest(blobs, "id", "v", trees=5)
        forest.anomaly_scores(blobs, model, "v").write.parquet(str(tmp_path / "scores"))
        assert set(os.listdir(shared_dir(spark))) - before
    assert set(os.listdir(shared_dir(spark))) == before and spark.read.parquet(str(tmp_path / "scores")).count() == 600


def test_text_job_end_to_end(spark, sf_dir):
    from filingsift.catalog.views import view
    docs = view(spark, sf_dir, "v3")
    scored = anomaly_job.score_text(docs, "doc_id", components=5, trees=20, stop_words=["the"], least_words=20, min_df=2)
    wanted = docs.filter(F.year("filing_date").between(2018, 2023) & (tx.word_count("mda") >= 20)).count()
    assert scored.count() == wanted
    report = anomaly_job.report(scored, "doc_id", "fraudulent", "x", ks=(5,)).first()
    assert 0 <= report["roc_auc"] <= 1 and report["n_samples"] == wanted


def test_planted_anomalies_are_found_and_noise_finds_none(spark):
    from filingsift.catalog.features import labelled_vectors, planted, planted_found
    rows = planted(labelled_vectors(spark, "/root/testdata/sf0.01"))
    scored = anomaly_job.score_vectors(rows, "vec_id", "embedding", "is_planted", trees=50)
    assert planted_found(scored).first().ranked_first
    noise = scored.withColumn("anomaly_score", F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000)
    assert planted_found(noise).first().ranked_first is False


def test_novelty_leaves_one_round_on_disk_at_a_time(spark, monkeypatch):
    """Pairs of filings are searched in rounds: same results, and no round's weights outlive it."""
    from filingsift import session
    rng = np.random.default_rng(3)
    rows = [(c, f"{c}{y}", y, i, " ".join(rng.choice([f"w{j}" for j in range(30)], size=8))) for c in "abc" for y in range(2001, 2007)
            for i in range(6)]
    chunks = materialize(chunk_rows(spark, rows), "chunks")

    def scored():
        out = novelty.score_chunks(chunks)
        return sorted((r["filing_id"], r["chunk_id"], r["reference_filing_id"], r["matched_chunk_id"], r["matched_chunk_text"], r["scoring_status"],
                       round(r["max_similarity"] or 0, 9)) for r in out.collect())
    monkeypatch.setattr(novelty, "ROUND_CHARS", 10 ** 9)
    whole = scored()
    seen, weigh = [], novelty.reference_weights

    def weighed(some, refs):
        seen.append((some.select("filing_id").distinct().count(), sum("weights-" in p for p in session._paths)))
        return weigh(some, refs)
    monkeypatch.setattr(novelty, "reference_weights", weighed)
    monkeypatch.setattr(novelty, "ROUND_CHARS", 1200)
    before = sum("weights-" in p for p in session._paths)
    assert scored() == whole and len(whole) == 108
    assert len(seen) > 4 and max(n for n, _ in seen) < 18 and {n for _, n in seen} == {before}
    plan = novelty.score_chunks(chunks).drop("chunk_text", "matched_chunk_text")._jdf.queryExecution().executedPlan().toString()
    assert "first(chunk_text" not in plan


def test_rounds_hold_every_bucket_once():
    held = [(7, 0), (5, 1), (5, 2), (3, 3), (30, 4), (1, 5)]
    rounds = novelty._packed(held, 10)
    assert sorted(b for r in rounds for b in r) == list(range(6)) and [4] in rounds
    assert all(len(r) == 1 or sum(dict((b, n) for n, b in held)[b] for b in r) <= 10 for r in rounds)


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_sparse_documents_are_those_of_the_long_tables(spark, monkeypatch, block):
    """Repeated ids are one document, texts without a known term have no row, and no term is shuffled."""
    monkeypatch.setattr(vocab, "BLOCK_WORDS", block)
    texts = ["apple pear apple pear", None, "", "unseen words", "plum", "pear pear plum été", "apple plum", "apple plum"]
    docs = spark.createDataFrame([(min(i, 6), t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    model = vocab.fit_tfidf(docs, "id", "t", ["unseen"], min_df=1, max_df=1.0, max_terms=6)

    def told(rows):
        return {r["id"]: [(i, round(w, 12)) for i, w in zip(r["indices"], r["weights"])] for r in rows.collect()}
    short = vocab.sparse_documents(docs, "id", "t", model, ["unseen"])
    assert told(short) == told(vocab.sparse_rows(vocab.weigh(vocab.tfidf_counts(docs, "id", "t", ["unseen"]), model, "id"), "id"))
    assert short.schema.simpleString() == "struct<id:int,indices:array<int>,weights:array<double>>"
    spread = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(4)
    plan = vocab.sparse_documents(spread, "id", "t", model, ["unseen"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning(_id") == 1


@pytest.mark.parametrize("frequent", [3, 10 ** 9])
def test_slices_of_texts_have_the_same_matches(spark, monkeypatch, frequent):
    """What a slice of a filing's texts leaves on disk is gone before the next, and no match changes."""
    from filingsift import session
    rng = np.random.default_rng(17)
    rows = [("a", f"a{y}", y, i, " ".join(rng.choice([f"w{j}" for j in range(20)], size=rng.integers(2, 9)))) for y in (2004, 2005) for i in range(40)]
    _, _, past, now = novelty.reference_weights(chunk_rows(spark, rows))
    past, now = materialize(past), materialize(now)
    seen, best = [], novelty._best

    def one(*args):
        seen.append(sum(name in p for p in session._paths for name in ("bounds-", "split-", "able-")))
        return best(*args)
    monkeypatch.setattr(novelty, "_best", one)
    monkeypatch.setattr(novelty, "ROUND_PAIRS", 300)
    got = {(r["ref"], r["rep"]): r["match"] for r in novelty.best_matches(past, now, frequent).collect()}
    assert len(seen) > 3 and len(set(seen)) == 1 and len(got) > 30
    assert got == brute_matches(spark, novelty.unit(past), novelty.unit(now))
