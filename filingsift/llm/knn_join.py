"""Exact top-k search by a Voronoi kNN join.

The largest inner product becomes the smallest distance once every data vector x gets one more component,
sqrt(M - |x|^2) with M the largest squared length, and every query a zero. In that space queries and data are
grouped by their nearest pivot. From the groups' summaries (a query group's radius, a data group's smallest
distances to its pivot) follows how far the k-th neighbour of any query of a group can be, and a data vector is
sent to a query group only if the triangle inequality cannot rule it out. Each group is solved on its own.

Equal vectors count once: a query vector is searched once however many rows have it, and a data vector carries
its k + 1 smallest ids, more of which no query can need. A query group is cut into blocks of about
``QUERY_BLOCK`` vectors and the data sent to it into chunks of about ``DATA_CHUNK``, so a task holds one block and
one chunk whatever the skew; the blocks' results meet in a top-k per query.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without
id; vectors are compared with those of the same length; rows that share an id do not find each other; fewer
than k candidates give fewer rows; an empty table gives an empty result; other columns play no part.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from filingsift.llm.tables import Tables

MOST_PIVOTS, LEAST_PIVOTS, QUERIES_PER_PIVOT = 64, 8, 512
QUERY_BLOCK, DATA_CHUNK = 2048, 8192


def whole_vectors(vectors: DataFrame, id, column, scale):
    """(id, v) rows: ``v`` is floor(scale * x) of each component, as integers."""
    x = F.col(column)
    whole = F.col(id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.filter(whole).select(F.col(id).cast("long").alias("id"),
                                         F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("v"))
            .dropDuplicates(["id", "v"]))


def _matrix(column):
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _products(a, b):
    """Integer inner products of all rows of a and b, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(v, pivots, pivot_lift, lift):
    """Distances of rows to pivots in the space with one more component (``lift``)."""
    square = (np.square(v.astype(np.float64)).sum(1) + lift ** 2)[:, None] + \
        (np.square(pivots.astype(np.float64)).sum(1) + pivot_lift ** 2)[None]
    cross = v.astype(np.float64) @ pivots.astype(np.float64).T + np.outer(lift, pivot_lift)
    return np.sqrt(np.maximum(square - 2 * cross, 0))


class Cells:
    """Pivots and what their groups' summaries allow."""

    def __init__(self, pivots, most):
        self.pivots, self.most = pivots, most
        self.lift = self.lifted(pivots)
        self.radius, self.reach = None, None

    def lifted(self, v):
        return np.sqrt(np.maximum(self.most - np.square(v.astype(np.float64)).sum(1), 0))

    def nearest(self, v, data):
        d = _distances(v, self.pivots, self.lift, self.lifted(v) if data else np.zeros(len(v)))
        cell = d.argmin(1)
        return cell, d[np.arange(len(d)), cell]

    def bound(self, radius, near, k):
        """``radius`` of the query groups (nan without queries), ``near``: (data group, distance) of the data vectors
        nearest to each pivot. No k-th neighbour of a query of group i is farther than ``reach[i]``."""
        between = _distances(self.pivots, self.pivots, self.lift, self.lift)
        cell = np.array([c for c, _ in near], np.int64)
        away = np.array([d for _, d in near], np.float64)
        self.radius = radius
        ways = np.sort(between[:, cell] + away[None] if len(near) else np.zeros((len(radius), 0)), axis=1)
        self.reach = radius + ways[:, k - 1] if ways.shape[1] >= k else np.full(len(radius), np.inf)

    def wanted(self, v):
        """Which query groups may need each data vector."""
        d = _distances(v, self.pivots, self.lift, self.lifted(v))
        slack = 1e-6 * (1 + math.sqrt(max(self.most, 0)))
        with np.errstate(invalid="ignore"):
            return d - self.radius[None] <= self.reach[None] + slack


def _assign(cells, data):
    def run(frames):
        for frame in frames:
            if len(frame):
                cell, away = cells.nearest(_matrix(frame["v"]), data)
                yield frame.assign(cell=cell.astype(np.int32), away=away)
    return run


def _send(cells, blocks, chunks):
    """Copies of each data vector for the query groups and blocks that may need it."""
    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            row, cell = np.nonzero(cells.wanted(_matrix(frame["v"])))
            many = blocks[cell]
            row, cell = np.repeat(row, many), np.repeat(cell, many)
            block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            out = frame.iloc[row][["v", "ids", "draw"]].reset_index(drop=True)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "block": block.astype(np.int32),
                                "chunk": (out["draw"].to_numpy() % chunks).astype(np.int32), "v": out["v"], "ids": out["ids"]})
    return run


def _solve(k):
    def run(key, frame):
        is_query = frame["ids"].isna().to_numpy()
        queries, data = frame["v"][is_query], frame[~is_query]
        empty = pd.DataFrame({"v": [], "id": np.array([], np.int64), "score": np.array([], np.int64)})
        if not len(queries) or not len(data):
            return empty
        scores = _products(_matrix(queries), _matrix(data["v"]))
        ids = [np.asarray(x, np.int64) for x in data["ids"]]
        size = min(k, scores.shape[1])
        edge = -np.partition(-scores, size - 1, axis=1)[:, size - 1]
        out = []
        for q, v in enumerate(queries):
            near = np.flatnonzero(scores[q] >= edge[q])
            found = np.concatenate([ids[i] for i in near])
            score = np.repeat(scores[q, near], [len(ids[i]) for i in near])
            best = np.lexsort((found, -score))[:k]
            out += [(v, i, s) for i, s in zip(found[best].tolist(), score[best].tolist())]
        return pd.DataFrame(out, columns=["v", "id", "score"])
    return run


def _search(rows, queries, k, tables, name):
    """Top k + 1 ids of each distinct query vector: (v, id, score); all vectors of one length."""
    by_vector = Window.partitionBy("v").orderBy("id")
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 40)).alias("draw")
    data = tables.write(f"data{name}", rows.withColumn("_r", F.row_number().over(by_vector)).filter(f"_r <= {k + 1}")
                        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", draw))
    asked = tables.write(f"asked{name}", queries.select("v").distinct().select("v", draw))
    n_data, n_asked = data.count(), asked.count()
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, n_asked // QUERIES_PER_PIVOT))
    pivots = np.array([r.v for r in data.orderBy("draw", "v").limit(count).collect()], np.int64)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    cells = Cells(pivots, data.agg(F.max(square)).first()[0])
    placed = data.mapInPandas(_assign(cells, True), "v array<long>, ids array<long>, draw long, cell int, away double")
    close = Window.partitionBy("cell").orderBy("away")
    near = (placed.select("cell", "away").withColumn("_r", F.row_number().over(close)).filter(f"_r <= {k + 1}")
            .select("cell", "away").collect())  # at most k + 1 rows for each pivot
    grouped = tables.write(f"grouped{name}", asked.mapInPandas(_assign(cells, False), "v array<long>, draw long, cell int, away double"))
    radius, sizes = np.full(len(pivots), np.nan), np.zeros(len(pivots), np.int64)
    for r in grouped.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect():
        radius[r.cell], sizes[r.cell] = r.far, r.n
    cells.bound(radius, [(r.cell, r.away) for r in near], k + 1)
    blocks = -(-sizes // QUERY_BLOCK)
    chunks = max(1, -(-n_data // DATA_CHUNK))
    sent = data.mapInPandas(_send(cells, blocks, chunks), "cell int, block int, chunk int, v array<long>, ids array<long>")
    of_cell = F.array(*[F.lit(int(max(1, b))) for b in blocks])[F.col("cell")]
    met = (grouped.select("cell", F.pmod(F.col("draw"), of_cell).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(int(chunks - 1)))).alias("chunk"), "v",
                          F.lit(None).cast("array<long>").alias("ids")))
    local = met.unionByName(sent).groupBy("cell", "block", "chunk").applyInPandas(_solve(k + 1), "v array<long>, id long, score long")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "id")
    return local.withColumn("_r", F.row_number().over(best)).filter(f"_r <= {k + 1}").drop("_r")


def top_k(vectors: DataFrame, is_query, k=5, id="vec_id", column="embedding", scale=256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that fits the condition ``is_query`` on ``id`` (a function of the
    id column) the k other rows of largest integer inner product, ties to the smaller id."""
    tables = Tables(vectors.sparkSession, "knn")
    rows = tables.write("rows", whole_vectors(vectors, id, column, scale))
    queries = rows.filter(is_query(F.col("id")))
    found = None
    for r in queries.select(F.size("v").alias("n")).distinct().collect():  # one search for each vector length
        part = _search(rows.filter(F.size("v") == r.n), queries.filter(F.size("v") == r.n), k, tables, r.n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "id")
    return (queries.select(F.col("id").alias("query_id"), "v").join(found, "v").filter("id <> query_id")
            .withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))


def op7_topk_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, lambda id: id % 50 == 0)


OP7_SQL = """
with r as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
p as (select q.vec_id as query_id, d.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(d.v as double[])) as bigint) as score
  from r q join r d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""
