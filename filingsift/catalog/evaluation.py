"""Evaluation of scores and predictions. The score is the first component of the given vectors."""
from pyspark.sql import functions as F

from filingsift.catalog.registry import query
from filingsift.catalog.views import table, view
from filingsift.operators import evaluate, splits

S = """with s as (select vec_id, cast(label = 0 as int) as y, round(cast(embedding[1] as double), 2) as score,
  cast(embedding[1] > 0 as int) as p from embeddings),
d as (select score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from s group by score),
c as (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg, sum(pos) over () as tp, sum(neg) over () as tn,
  lead(pos) over w as next_pos, lead(neg) over w as next_neg from d window w as (order by score desc))
"""


def scored(spark, sf):
    """Scores rounded to two digits, so ties occur."""
    first = F.col("embedding")[0].cast("double")
    return table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("y"), F.round(first, 2).alias("score"), (first > 0).cast("int").alias("p"))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("f5_score_prefix_counts", S + """
select score as value, pos, neg, cast(cum_pos as bigint) as cum_pos, cast(cum_neg as bigint) as cum_neg, cast(tp as bigint) as total_pos,
  cast(tn as bigint) as total_neg, next_pos, next_neg from c""")
def f5(spark, sf):
    return evaluate.score_counts(scored(spark, sf), "y", "score")


AUC = """round((select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) / count(*)
  from s a, s b where a.y = 1 and b.y = 0), 6)"""
AP = "(select round(sum(pos / tp * (cum_pos / (cum_pos + cum_neg))), 6) from c)"


@query("k1_roc_auc", S + f"select {AUC} as roc_auc")
def k1(spark, sf):
    return rounded(evaluate.roc_auc(scored(spark, sf), "y", "score"), "roc_auc")


@query("k2_average_precision", S + f"select {AP} as pr_auc")
def k2(spark, sf):
    return rounded(evaluate.average_precision(scored(spark, sf), "y", "score"), "pr_auc")


TOP = """, r as (select y, row_number() over (order by score desc, vec_id) as r from s),
k as (select k, count(*) filter (r <= k and y = 1) as hits, sum(y) as p, count(*) as n from r, (values (50), (100), (200)) v(k) group by k)
"""


@query("k3_precision_recall_at", S + TOP + """
select k, hits, round(hits / k, 6) as precision, round(case when p > 0 then hits / p else 0 end, 6) as recall from k where k <= n""")
def k3(spark, sf):
    return rounded(evaluate.precision_recall_at(scored(spark, sf), "y", "score", "vec_id"), "precision", "recall")


@query("k4_roc_curve", S + """
select 0.0 as fpr, 0.0 as tpr, cast('inf' as double) as threshold
union all select round(cum_neg / tn, 6), round(cum_pos / tp, 6), score from c
where next_pos is null or next_pos <> pos or next_neg <> neg""")
def k4(spark, sf):
    return rounded(evaluate.roc_curve(scored(spark, sf), "y", "score"), "fpr", "tpr")


@query("k4_roc_curve_all_points", S + """
select 0.0 as fpr, 0.0 as tpr, cast('inf' as double) as threshold
union all select round(cum_neg / tn, 6), round(cum_pos / tp, 6), score from c""")
def k4_all(spark, sf):
    return rounded(evaluate.roc_curve(scored(spark, sf), "y", "score", drop_intermediate=False), "fpr", "tpr")


@query("k5_precision_recall_curve", S + """
select round(cum_pos / (cum_pos + cum_neg), 6) as precision, round(cum_pos / tp, 6) as recall, score as threshold from c
union all select 1.0, 0.0, null""")
def k5(spark, sf):
    return rounded(evaluate.precision_recall_curve(scored(spark, sf), "y", "score"), "precision", "recall")


@query("k6_confusion_matrix", S + """
select 0 as label, count(*) filter (p = 0) as predicted_0, count(*) filter (p = 1) as predicted_1 from s where y = 0
union all select 1, count(*) filter (p = 0), count(*) filter (p = 1) from s where y = 1""")
def k6(spark, sf):
    return evaluate.confusion_matrix(scored(spark, sf), "y", "p")


@query("k7_class_report", S + """
, q as (select count(*) filter (y = 0 and p = 0) as tn, count(*) filter (y = 0 and p = 1) as fp, count(*) filter (y = 1 and p = 0) as fn,
  count(*) filter (y = 1 and p = 1) as tp, count(*) as n from s),
k as (select '0' as name, tn / (tn + fn) as precision, tn / (tn + fp) as recall, tn + fp as support from q
  union all select '1', tp / (tp + fp), tp / (tp + fn), fn + tp from q),
f as (select *, 2 * precision * recall / (precision + recall) as f1 from k)
select name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from f
union all select 'accuracy', round((tn + tp) / n, 6), round((tn + tp) / n, 6), round((tn + tp) / n, 6), n from q
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from f""")
def k7(spark, sf):
    return rounded(evaluate.class_report(scored(spark, sf), "y", "p"), "precision", "recall", "f1")


@query("k8_metrics_record", S + TOP + f"""
select 'first component' as experiment, (select count(*) from s) as n_samples, (select count(*) from s where y = 1) as n_fraud,
  round((select avg(y) from s), 6) as fraud_ratio, {AUC} as roc_auc, {AP} as pr_auc, """ + ", ".join(
    f"""(select round(hits / k, 6) from k where k = {k} and k <= n) as precision_at_{k}, (select round(hits / p, 6) from k where k = {k} and k <= n)
  as recall_at_{k}, (select hits from k where k = {k} and k <= n) as fraud_found_at_{k}""" for k in (50, 100, 200)))
def k8(spark, sf):
    out = evaluate.metrics_record(scored(spark, sf), "y", "score", "vec_id", "first component")
    return rounded(out, *[c for c in out.columns if c.startswith(("precision", "recall")) or c in ("fraud_ratio", "roc_auc", "pr_auc")])


@query("k9_split_summary", """
select case when year(filing_date) <= 2017 then 'train' when year(filing_date) between 2018 and 2023 then 'test' else 'excluded' end as split,
  count(*) as n, cast(sum(fraudulent) as bigint) as positives, round(avg(fraudulent), 6) as positive_ratio from v3 group by 1""", ["v3"])
def k9(spark, sf):
    rows = view(spark, sf, "v3").withColumn("split", splits.temporal_split("filing_date"))
    return rounded(splits.split_summary(rows, "fraudulent"), "positive_ratio")


@query("f1_top_anomalies", """
select e.vec_id, round(cast(embedding[1] as double), 6) as score, left(d.text, 200) as preview
from embeddings e join documents d on e.vec_id = d.doc_id order by embedding[1] desc, e.vec_id limit 200""")
def f1(spark, sf):
    from filingsift.functions import text as tx
    scores = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    top = evaluate.top_rows(scores.join(docs.select("vec_id"), "vec_id", "left_semi"), "score", "vec_id", 200)
    return (top.join(docs, "vec_id").select("vec_id", F.round("score", 6).alias("score"), tx.preview("text", 200).alias("preview")))


@query("f2_descending_scores", "select vec_id, round(cast(embedding[1] as double), 6) as score from embeddings order by embedding[1] desc, vec_id")
def f2(spark, sf):
    scores = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score"))
    return evaluate.descending(scores, "score", "vec_id").select("vec_id", F.round("score", 6).alias("score"))
