"""Isolation forest (Liu, Ting and Zhou, 2008) on an array column.

Fitting looks at ``trees x sample`` rows: one cheap hash pass keeps a small pool, every tree draws its
rows from the pool by hash, and each tree is built by one task. Scoring broadcasts the node table, whose
size is fixed by trees and sample size, and runs over Arrow batches. Every draw depends on the seed, the
tree and the row key, so partitioning and retries do not change the forest.
"""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.keys import draw_fraction
from filingsift.operators.ranks import exact_quantiles
from filingsift.operators.vectors import array_batch
from filingsift.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def mean_path(n):
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    big = np.maximum(n, 2.0)
    long = 2.0 * (np.log(big - 1.0 + (n <= 2)) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x, rng, limit):
    """Nodes of one tree: random feature that varies, random threshold between its extremes."""
    nodes = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][3 if side == 0 else 4] = me
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= threshold
        if goes_left.all():
            threshold = float(low[feature])
            goes_left = x[rows, feature] <= threshold
        nodes[me][1], nodes[me][2] = feature, threshold
        stack.append((rows[~goes_left], depth + 1, me, 1))
        stack.append((rows[goes_left], depth + 1, me, 0))
    return nodes


@dataclass
class ForestModel:
    nodes: DataFrame
    trees: int
    sample: int
    offset: float = -0.5

    def save(self, path):
        (self.nodes.withColumn("n_trees", F.lit(self.trees)).withColumn("sample", F.lit(self.sample))
         .withColumn("offset", F.lit(self.offset)).write.mode("overwrite").parquet(path))

    @staticmethod
    def load(spark, path):
        stored = spark.read.parquet(path)
        first = stored.select("n_trees", "sample", "offset").first()
        return ForestModel(stored.drop("n_trees", "sample", "offset"), first["n_trees"], first["sample"], first["offset"])


def fit_forest(df: DataFrame, id_col, vector, trees=300, sample=256, seed=42) -> ForestModel:
    """Grow the trees; labels are no input."""
    slim = df.select(id_col, vector)
    n = slim.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    size = min(sample, n)
    pool_size = min(n, trees * sample)
    # six standard deviations of slack: the pool stays small however large the table is
    share = min(1.0, (pool_size + 6 * pool_size ** 0.5) / n)
    pool = slim.filter(draw_fraction(f"{seed}:pool", id_col) < share) if share < 1.0 else slim
    pool = materialize(pool, "forest-pool")
    in_pool = pool.count()
    size = min(size, in_pool)
    # more than twice the wanted rows pass the hash threshold of a tree, the ranks cut them to size
    threshold = min(1.0, (2.0 * size + 64) / in_pool)
    draw = F.xxhash64(F.lit(seed), F.col("tree"), F.col(id_col).cast("string"))
    keep = int(threshold * 2.0 ** 63)
    drawn = (pool.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
             .withColumn("_h", draw))
    if threshold < 1.0:
        drawn = drawn.filter(F.shiftrightunsigned("_h", 1) < keep)
    order = Window.partitionBy("tree").orderBy("_h", id_col)
    chosen = drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size)
    rows = chosen.join(pool, id_col).select("tree", "_r", F.col(vector).cast("array<double>").alias("x"))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        x = array_batch(frame.sort_values("_r")["x"])
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        table = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        return table.assign(tree=tree)[["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]]
    nodes = materialize(rows.groupBy("tree").applyInPandas(build, NODE_SCHEMA), "forest")
    return ForestModel(nodes, trees, size)


def _packed(model: ForestModel):
    """Node arrays of all trees end to end; at most 2 x trees x sample nodes."""
    table = model.nodes.orderBy("tree", "node").toPandas()
    roots = np.flatnonzero(table["node"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(table))))
    left, right = table["left"].to_numpy(), table["right"].to_numpy()
    path = table["depth"].to_numpy() + mean_path(table["size"].to_numpy())
    return dict(roots=roots, feature=table["feature"].to_numpy(), threshold=table["threshold"].to_numpy(),
                left=np.where(left >= 0, left + base, -1), right=np.where(right >= 0, right + base, -1), path=path)


def normality(df: DataFrame, model: ForestModel, vector, out="normality") -> DataFrame:
    """-2^(-mean depth / expected depth): close to -1 for isolated rows, around -0.4 for ordinary ones."""
    shared = df.sparkSession.sparkContext.broadcast(_packed(model))
    expected = float(mean_path(model.sample))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        f = shared.value
        if len(column) == 0:
            return pd.Series([], dtype="float64")
        x = array_batch(column)
        rows = np.arange(len(x))
        depth = np.zeros(len(x))
        for root in f["roots"]:
            at = np.full(len(x), root)
            while True:
                feature = f["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(feature, 0)] <= f["threshold"][at]
                at = np.where(inner, np.where(goes_left, f["left"][at], f["right"][at]), at)
            depth += f["path"][at]
        return pd.Series(-np.exp2(-depth / len(f["roots"]) / expected))
    return df.withColumn(out, score(vector))


def fit_isolation_forest(train: DataFrame, id_col, vector, trees=300, sample=256, contamination=0.02, seed=42) -> ForestModel:
    """Forest and the offset below which the share ``contamination`` of the train rows lies."""
    model = fit_forest(train, id_col, vector, trees, sample, seed)
    scored = normality(train.select(id_col, vector), model, vector).select("normality")
    model.offset = float(exact_quantiles(scored, "normality", (contamination,), names=["q"]).first()["q"])
    return model


def anomaly_scores(df: DataFrame, model: ForestModel, vector, out="anomaly_score") -> DataFrame:
    """Larger is more anomalous; above 0 lies the contamination share of the train rows."""
    scored = normality(df, model, vector, "_normality")
    return scored.withColumn(out, -(F.col("_normality") - F.lit(model.offset))).drop("_normality")
