"""Unsupervised scoring of future filings, over text or over ready vectors, with hidden-label evaluation."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.functions import text as tx
from filingsift.operators import evaluate, forest, splits, svd, vocab
from filingsift.operators.ranks import beside
from filingsift.plans.corpus import long_enough, valid_rows
from filingsift.session import materialize


def text_vectors(train: DataFrame, rest: DataFrame, id_col, text, components=300, stop_words=None, **vocabulary):
    """Fit TF-IDF and SVD on ``train``; (train vectors, rest vectors, TF-IDF model, SVD model).

    The first job keeps only term statistics, the second writes the sparse rows over the chosen vocabulary; the table
    of all n-grams, several times the corpus, is never written.
    """
    def rows_of(docs):
        return vocab.sparse_documents(docs, id_col, text, model, stop_words)
    model = vocab.fit_tfidf(train, id_col, text, stop_words, **vocabulary)
    n_terms = model.vocabulary.count()
    train_rows = materialize(rows_of(train), "rows")
    reduced = svd.fit_svd(train_rows, n_terms, model.n_docs, components)
    rest_rows = rows_of(rest)

    def whole(docs, rows):
        # a document without known terms still gets its (zero) vector
        return svd.project(docs.select(id_col).join(rows, id_col, "left"), reduced, id_col)
    return whole(train, train_rows), whole(rest, rest_rows), model, reduced


def score_text(df: DataFrame, id_col, text="mda", date="filing_date", label="fraudulent", components=300, trees=300,
               contamination=0.02, stop_words=None, least_words=200, seed=42, **vocabulary):
    """Scored test rows (id, label, anomaly_score) of the temporal split."""
    rows = valid_rows(df, text, date, label)
    rows = long_enough(rows.withColumn(text, tx.collapse(text)), text, least=least_words)
    rows = materialize(rows.withColumn("split", splits.temporal_split(date)).select(id_col, text, label, "split"), "rows")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    train_v, test_v, _, _ = text_vectors(train, test, id_col, text, components, stop_words, **vocabulary)
    train_v = materialize(train_v, "train-vectors")
    model = forest.fit_isolation_forest(train_v, id_col, "vector", trees, contamination=contamination, seed=seed)
    scored = forest.anomaly_scores(test_v, model, "vector").select(id_col, "anomaly_score")
    return materialize(scored.join(test.select(id_col, label), id_col), "scores")


def score_vectors(df: DataFrame, id_col, vector, label, split="split", trees=300, contamination=0.02, seed=42):
    """Scored test rows from ready vectors and a split column."""
    slim = df.select(id_col, vector, label, split)
    train, test = slim.filter(F.col(split) == "train"), slim.filter(F.col(split) == "test")
    model = forest.fit_isolation_forest(train, id_col, vector, trees, contamination=contamination, seed=seed)
    return materialize(forest.anomaly_scores(test, model, vector).select(id_col, label, "anomaly_score"), "scores")


def report(scored: DataFrame, id_col, label, experiment, ks=(50, 100, 200)) -> DataFrame:
    return evaluate.metrics_record(scored, label, "anomaly_score", id_col, experiment, ks)
