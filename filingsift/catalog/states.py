"""Stored model states and growing feature stores."""
import os

from pyspark.sql import functions as F

from filingsift.catalog.features import counted_texts, labelled_vectors, part
from filingsift.catalog.registry import query
from filingsift.catalog.views import table
from filingsift.functions import text as tx
from filingsift.operators import boosting, classify, forest, splits, svd, topics
from filingsift.session import materialize, scratch_path
from filingsift.sources import states


def _apart(fitted, loaded, key):
    """(rows of both, largest difference) of two tables (key, array of numbers)."""
    both = fitted.select(key, F.col("x").alias("a")).join(loaded.select(key, F.col("x").alias("b")), key)
    gaps = F.transform(F.arrays_zip("a", "b"), lambda z: F.abs(z["a"] - z["b"]))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.array_max(gaps)), 9).alias("difference"))


@query("a7_reloaded_models", """
select 'boosting' as kind, (select count(*) from embeddings) as n, 0.0 as difference, true as keys_agree
union all select 'forest', (select count(*) from embeddings), 0.0, true
union all select 'svd', (select count(*) from embeddings), 0.0, true
union all select 'topics', (select count(*) from v3), 0.0, true""", ["v3"])
def a7_reloaded(spark, sf):
    """Four fitted models are published and loaded again; the loaded ones score every row like the fitted ones."""
    rows = labelled_vectors(spark, sf)
    train = materialize(splits.stratified_split(part(rows, "train").drop("split"), "vec_id", "y", 0.25, 8), "halves")
    keys = states.fingerprint(rows, "vec_id")
    root, out = scratch_path(spark, "states"), []

    def publish(kind, key, score, fitted, restore, **parts):
        path = os.path.join(root, kind)
        states.save_state(spark, path, kind, keys=keys, **parts)
        stored = states.load_state(spark, path, kind, keys)
        out.append(_apart(score(fitted), score(restore(stored)), key).withColumn("kind", F.lit(kind))
                   .withColumn("keys_agree", F.lit(stored.keys == keys)))

    boosted, _, _ = boosting.fit_boosted(part(train, "train"), part(train, "validation"), "embedding", "y", rounds=5)
    publish("boosting", "vec_id", lambda m: classify.predict(m, rows, "embedding").select("vec_id", F.array("probability").alias("x")),
            boosted, lambda s: s.model("trees"), models={"trees": boosted}, parameters={"rounds": boosted.getNumTrees})
    isolated = forest.fit_isolation_forest(part(rows, "train"), "vec_id", "embedding", trees=50)
    publish("forest", "vec_id", lambda m: forest.anomaly_scores(rows, m, "embedding").select("vec_id", F.array("anomaly_score").alias("x")),
            isolated, lambda s: forest.ForestModel(s.table("nodes"), s.parameters["trees"], s.parameters["sample"], s.parameters["offset"]),
            tables={"nodes": isolated.nodes}, parameters={"trees": isolated.trees, "sample": isolated.sample, "offset": isolated.offset})
    size = len(rows.first()["embedding"])
    numbered = F.sequence(F.lit(0), F.size("embedding") - 1)
    sparse = materialize(rows.select("vec_id", numbered.alias("indices"), F.col("embedding").cast("array<double>").alias("weights")), "sparse")
    reduced = svd.fit_svd(sparse, size, rows.count(), components=8, passes=2)
    components = spark.createDataFrame([(i, [float(v) for v in c], float(s)) for i, (c, s) in enumerate(zip(reduced.components, reduced.singular_values))],
                                       "i int, component array<double>, singular_value double")
    publish("svd", "vec_id", lambda m: svd.project(sparse, m, "vec_id", "x"), reduced, lambda s: svd.restored(s.table("components"), s.parameters["explained"]),
            tables={"components": components}, parameters={"explained": float(reduced.explained_variance_ratio)})
    counted, _ = counted_texts(spark, sf)
    counted = materialize(counted.select("doc_id", "counts"), "counts")
    model = topics.fit_topics(counted, k=5, passes=2)
    publish("topics", "doc_id", lambda m: topics.topic_vectors(m, counted, ["doc_id"], "x"), model, lambda s: s.model("topics"),
            models={"topics": model}, parameters={"k": 5})
    found = out[0]
    for one in out[1:]:
        found = found.unionByName(one)
    return found


@query("a8_grown_features", """
select doc_id, n_chars, cast(len(regexp_extract_all(text, '[^\\s]+')) as int) as words, cast(doc_id % 3 = 0 as int) as part from documents""")
def a8_grown(spark, sf):
    """A store made for two thirds of the keys grows to all of them: only the missing rows are built, as a second part."""
    docs = table(spark, sf, "documents")
    store = states.FeatureStore(spark, os.path.join(scratch_path(spark, "store"), "words"), "doc_id", "white space words")

    def build(keys):
        return docs.join(keys, "doc_id", "left_semi").select("doc_id", "n_chars", tx.word_count("text").alias("words"))
    keys = docs.select("doc_id")
    store.extend(keys.filter("doc_id % 3 <> 0"), build)
    return store.extend(keys, build)
