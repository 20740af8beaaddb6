"""Exact evaluation of scores and predictions.

Curves and areas come from one table: positives and negatives per distinct score with running totals
from the highest score down (:func:`score_counts`). Ties are one step, never an arbitrary order.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.operators.ranks import beside, prefix_counts


def score_counts(df: DataFrame, label, score, by=()) -> DataFrame:
    """Per distinct score: pos, neg and cumulative cum_pos, cum_neg from the highest score down."""
    return prefix_counts(df, score, {"pos": (F.col(label) == 1).cast("bigint"),
                                     "neg": (F.col(label) != 1).cast("bigint")}, by, descending=True)


def _areas(curve: DataFrame, by) -> DataFrame:
    pos, neg, cp, cn = (F.col(c) for c in ("pos", "neg", "cum_pos", "cum_neg"))
    tp, tn = F.col("total_pos"), F.col("total_neg")
    # a positive beats every negative scored lower and ties count one half
    won = F.sum(pos * (tn - cn) + pos * neg / 2)
    steps = F.sum(pos * (cp / (cp + cn)))
    return curve.groupBy(*by).agg(
        F.when((F.max(tp) > 0) & (F.max(tn) > 0), F.try_divide(won, F.max(tp).cast("double") * F.max(tn)))
        .alias("roc_auc"),
        F.try_divide(steps, F.max(tp)).alias("pr_auc"))


def areas(df: DataFrame, label, score, by=()) -> DataFrame:
    """Both areas in one pass, per group; null where a group lacks a class."""
    return _areas(score_counts(df, label, score, by), list(by))


def require_two_classes(df: DataFrame, label) -> DataFrame:
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    if not row["p"] or not row["n"]:
        raise ValueError("Evaluation requires both positive and negative samples.")
    return df


def roc_auc(df, label, score, by=()) -> DataFrame:
    if not by:
        require_two_classes(df, label)
    return _areas(score_counts(df, label, score, by), list(by)).drop("pr_auc")


def average_precision(df, label, score, by=()) -> DataFrame:
    """Sum of precision times the step in recall over the distinct scores (no interpolation)."""
    return _areas(score_counts(df, label, score, by), list(by)).drop("roc_auc")


def top_rows(df: DataFrame, score, id_col, k) -> DataFrame:
    """The k highest scores, ties by id: a heap per task, then a merge of k rows each."""
    return df.orderBy(F.col(score).desc(), F.col(id_col).asc()).limit(k)


def precision_recall_at(df: DataFrame, label, score, id_col, ks=(50, 100, 200)) -> DataFrame:
    """Precision, recall and positives among the k best, for every k not above the row count."""
    from pyspark.sql import Window
    top = top_rows(df.select(label, score, id_col), score, id_col, max(ks))
    # at most max(ks) rows are left here
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(id_col).asc())))
    hits = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col(label))), F.lit(0)).alias(f"h{k}") for k in ks])
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p"))
    items = [F.struct(F.lit(k).alias("k"), F.col(f"h{k}").cast("bigint").alias("hits")) for k in ks]
    return (beside(hits, whole)
            .select("n", "p", F.explode(F.array(*items)).alias("r")).filter(F.col("r.k") <= F.col("n"))
            .select("r.k", "r.hits", (F.col("r.hits") / F.col("r.k")).alias("precision"),
                    F.when(F.col("p") > 0, F.col("r.hits") / F.col("p")).otherwise(F.lit(0.0)).alias("recall")))


def roc_curve(df: DataFrame, label, score, drop_intermediate=True) -> DataFrame:
    """(fpr, tpr, threshold) from the highest score down, preceded by the origin.

    With ``drop_intermediate`` a point on the straight line between its neighbours is left out.
    """
    curve = score_counts(df, label, score)
    if drop_intermediate:
        last = F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        curve = curve.filter(last | bend)
    points = curve.select((F.col("cum_neg") / F.col("total_neg")).alias("fpr"),
                          (F.col("cum_pos") / F.col("total_pos")).alias("tpr"), F.col("value").alias("threshold"))
    spark = df.sparkSession
    origin = spark.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                   F.lit(float("inf")).alias("threshold"))
    return origin.unionByName(points)


def precision_recall_curve(df: DataFrame, label, score) -> DataFrame:
    """(precision, recall, threshold) per distinct score, closed by the point (1, 0)."""
    curve = score_counts(df, label, score)
    points = curve.select((F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                          F.try_divide("cum_pos", "total_pos").alias("recall"), F.col("value").alias("threshold"))
    end = df.sparkSession.range(1).select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                                          F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def confusion_counts(df: DataFrame, label, prediction, by=()) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, label, prediction) -> DataFrame:
    """Two rows, true label 0 then 1; columns are the predictions."""
    c = confusion_counts(df, label, prediction)
    rows = F.array(F.struct(F.lit(0).alias("label"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
                   F.struct(F.lit(1).alias("label"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def _guarded(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _class_scores(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = counts.withColumns({
        "p0": _guarded(tn, tn + fn), "r0": _guarded(tn, tn + fp), "s0": tn + fp,
        "p1": _guarded(tp, tp + fp), "r1": _guarded(tp, tp + fn), "s1": fn + tp})
    return out.withColumns({f"f{i}": _guarded(2 * F.col(f"p{i}") * F.col(f"r{i}"), F.col(f"p{i}") + F.col(f"r{i}"))
                            for i in (0, 1)})


def class_report(df: DataFrame, label, prediction) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    s = _class_scores(confusion_counts(df, label, prediction))
    n = F.col("s0") + F.col("s1")
    acc = _guarded(F.col("tn") + F.col("tp"), n)

    def line(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    def mean(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return _guarded(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), n)
    rows = [line(str(i), F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"f{i}"), F.col(f"s{i}")) for i in (0, 1)]
    rows += [line("accuracy", acc, acc, acc, n), line("macro avg", mean("p"), mean("r"), mean("f"), n),
             line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n)]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def macro_scores(df: DataFrame, label, prediction, by=()) -> DataFrame:
    """Accuracy and macro precision, recall and F1, per group."""
    s = _class_scores(confusion_counts(df, label, prediction, by))
    return s.select(*by, (F.col("s0") + F.col("s1")).alias("n"),
                    _guarded(F.col("tn") + F.col("tp"), F.col("s0") + F.col("s1")).alias("accuracy"),
                    *[((F.col(f"{x}0") + F.col(f"{x}1")) / 2).alias(name)
                      for x, name in (("p", "macro_precision"), ("r", "macro_recall"), ("f", "macro_f1"))])


def metrics_record(df: DataFrame, label, score, id_col, experiment, ks=(50, 100, 200)) -> DataFrame:
    """One row: sizes, ratio, areas, and the top-k results in columns (null where k exceeds n)."""
    require_two_classes(df, label)
    areas = _areas(score_counts(df, label, score), [])
    base = df.agg(F.lit(experiment).alias("experiment"), F.count(F.lit(1)).alias("n_samples"),
                  F.sum(label).cast("bigint").alias("n_fraud"), F.avg(label).alias("fraud_ratio"))
    at_k = precision_recall_at(df, label, score, id_col, ks)
    wide = at_k.agg(*[F.max(F.when(F.col("k") == k, F.col(src))).alias(f"{name}_at_{k}")
                      for k in ks for src, name in (("precision", "precision"), ("recall", "recall"), ("hits", "fraud_found"))])
    return beside(base, areas, wide)


def descending(df: DataFrame, score, id_col) -> DataFrame:
    """All rows from the highest score down: a range-partitioned sort, one range per task."""
    return df.orderBy(F.col(score).desc(), F.col(id_col).asc())
