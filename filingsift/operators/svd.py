"""Truncated SVD (uncentred) of a sparse document-term table by randomised subspace iteration
(Halko, Martinsson and Tropp, 2011).

Documents stay distributed. What a task returns is the product of its rows with a (terms x rank)
matrix; the caller bounds the vocabulary and the rank, so that matrix is bounded (20,000 x 310 doubles are 50 MB). A run
makes a fixed, small number of passes over the documents.
"""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
ROWS = 64


@dataclass
class SvdModel:
    """components: (rank x terms), rows orthonormal; singular values; explained variance ratio."""
    components: np.ndarray
    singular_values: np.ndarray
    explained_variance_ratio: float

    def save(self, spark, path):
        rows = [(i, [float(x) for x in c], float(s), float(self.explained_variance_ratio))
                for i, (c, s) in enumerate(zip(self.components, self.singular_values))]
        spark.createDataFrame(rows, "i int, component array<double>, singular_value double, explained double") \
            .write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path):
        stored = spark.read.parquet(path)
        return restored(stored, stored.first()["explained"])


def restored(components: DataFrame, explained) -> SvdModel:
    """The model of a stored table (i, component, singular_value), one row per component."""
    rows = components.orderBy("i").collect()
    return SvdModel(np.array([r["component"] for r in rows]), np.array([r["singular_value"] for r in rows]), explained)


def _sum_blocks(keys, frame):
    total = np.sum([np.frombuffer(b, dtype="float64") for b in frame["values"]], axis=0)
    return pd.DataFrame({"block": [keys[0]], "values": [total.tobytes()]})


def _gram_product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(X'X) basis: one pass; partial products are summed in two rounds of blocks."""
    spark = rows.sparkSession
    n_terms, width = basis.shape
    shared = spark.sparkContext.broadcast(basis)
    spread = max(1, int(spark.sparkContext.defaultParallelism ** 0.5))

    def partial(frames):
        v = shared.value
        out = np.zeros((n_terms, width))
        for frame in frames:
            for first in range(0, len(frame), ROWS):
                # a block of documents over the terms it has, as one dense matrix
                idx, w = frame["indices"].iloc[first:first + ROWS], frame["weights"].iloc[first:first + ROWS]
                size = np.array([len(x) for x in idx])
                if not size.sum():
                    continue
                terms, column = np.unique(np.concatenate(list(idx)), return_inverse=True)
                block = np.zeros((len(size), len(terms)))
                block[np.repeat(np.arange(len(size)), size), column] = np.concatenate(list(w))
                out[terms] += block.T @ (block @ v[terms])
        salt = TaskContext.get().partitionId() % spread
        for start in range(0, n_terms, BLOCK):
            part = out[start:start + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [start], "salt": [salt], "values": [part.tobytes()]})

    def first_round(keys, frame):
        return _sum_blocks(keys, frame).assign(salt=keys[1])
    schema = "block int, values binary"
    pieces = rows.select("indices", "weights").mapInPandas(partial, "block int, salt int, values binary")
    halfway = pieces.groupBy("block", "salt").applyInPandas(first_round, schema + ", salt int")
    blocks = halfway.groupBy("block").applyInPandas(lambda k, f: _sum_blocks(k, f), schema)
    result = np.zeros((n_terms, width))
    # terms x rank numbers in all, the size of the basis itself
    for r in blocks.collect():
        part = np.frombuffer(r["values"], dtype="float64").reshape(-1, width)
        result[r["block"]:r["block"] + len(part)] = part
    shared.unpersist()
    return result


def fit_svd(rows: DataFrame, n_terms, n_rows, components=300, passes=5, oversample=10, seed=42) -> SvdModel:
    """``rows`` holds (indices, weights) per document, best a written table, since each pass reads it; fit on
    training documents only."""
    k = max(1, min(components, n_terms - 1, n_rows - 1))
    spark = rows.sparkSession
    # every task returns a full block set, so tasks are limited to the cores there are
    rows = rows.coalesce(max(1, spark.sparkContext.defaultParallelism))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, min(n_terms, k + oversample))))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_gram_product(rows, basis))[0]
    small = basis.T @ _gram_product(rows, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    parts = (basis @ vectors[:, order]).T
    # sign convention: the entry of largest size in a component is positive
    signs = np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])
    parts = parts * np.where(signs == 0, 1.0, signs)[:, None]
    energy = np.clip(values[order], 0, None)
    # at most n_terms rows
    sums = (rows.select(F.explode(F.arrays_zip("indices", "weights")).alias("t"))
            .groupBy("t.indices").agg(F.sum("t.weights").alias("s"), F.sum(F.col("t.weights") ** 2).alias("q")).collect())
    mean = np.zeros(n_terms)
    square = 0.0
    for r in sums:
        mean[r["indices"]] = r["s"] / n_rows
        square += r["q"] / n_rows
    total = square - float(mean @ mean)
    explained = float((energy / n_rows - (parts @ mean) ** 2).sum())
    return SvdModel(parts, np.sqrt(energy), explained / total if total > 0 else 0.0)


def project(rows: DataFrame, model: SvdModel, id_col, out="vector") -> DataFrame:
    """Dense coordinates of every document; a document without known terms is the zero vector."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.components.T))
    width = model.components.shape[0]

    @F.pandas_udf("array<double>")
    def coordinates(indices: pd.Series, weights: pd.Series) -> pd.Series:
        v = shared.value
        out = np.zeros((len(indices), width))
        for first in range(0, len(out), ROWS):
            some = [(r, i, w) for r, (i, w) in enumerate(zip(indices.iloc[first:first + ROWS], weights.iloc[first:first + ROWS]))
                    if i is not None and len(i)]
            if some:
                terms, column = np.unique(np.concatenate([i for _, i, _ in some]), return_inverse=True)
                block = np.zeros((ROWS, len(terms)))
                block[np.repeat([r for r, _, _ in some], [len(i) for _, i, _ in some]), column] = np.concatenate([w for _, _, w in some])
                out[first:first + ROWS] = (block @ v[terms])[:len(out) - first]
        return pd.Series(list(out))
    return rows.select(id_col, coordinates("indices", "weights").alias(out))
