"""Near-duplicate documents by min-max hashing.

Each document's distinct shingles are hashed under ``PERMUTATIONS`` permutations, of which both the minimum
and the maximum are kept: two signature values for one hash evaluation, each agreeing between two sets with
their Jaccard similarity. Two permutations (four values) make a band; documents that share a band are
candidates, and a link is confirmed on the full sets. With 32 bands a pair at similarity 0.85 shares none
with probability (1 - 0.85**4)**32, about 5e-11.

Equal sets are one class from the start, so copies cost a partial aggregate. A bucket of candidates is never
expanded into all its pairs. First each document is compared with the smallest id it shares a bucket with, which
settles most links. Buckets that still hold more than one component are then finished exactly: a small one by
comparing its members of different components, a large one in blocks. A task takes two blocks with their full
sets, counts all intersections as a matrix product, and returns no more links than join its components. Blocks of
the component that most of a bucket belongs to are never compared with each other.

Defined results: a null text, an empty one and one without words have no shingles and are linked with nothing;
a text of fewer words than a shingle is one shingle; repeated rows each get a result; rows that share a
doc_id are one vertex, named by it; an empty table gives an empty result; other columns play no part.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filingsift.llm import words as W
from filingsift.llm.components import components
from filingsift.llm.tables import Tables, packed, unpacked

SHINGLE = 5
PERMUTATIONS = 64
BAND = 2  # permutations in a band, each with its minimum and maximum
SMALL_BUCKET = 24
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
COLUMNS = 4096
_SEEDS = W.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts, shingle=SHINGLE):
    """Distinct shingle hashes of each text, ascending: (hashes, index of each text's first)."""
    data, offsets = W.text_buffer(texts)
    _, _, hashes, first = W.split_words(data, offsets, W.SPACED_LOWER)
    own = W.owners(first)
    grams = W.gram_hashes(hashes, shingle)
    whole = np.flatnonzero(own[:len(grams)] == own[shingle - 1:]) if len(grams) else np.zeros(0, np.int64)
    values, texts_of = grams[whole], own[whole]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        single = [W.gram_hashes(hashes[first[i]:first[i + 1]], int(count[i]))[0] + np.uint64(count[i]) for i in short]
        values = np.concatenate([values, W.mix(np.array(single, np.uint64))])
        texts_of = np.concatenate([texts_of, short])
    order = np.lexsort((values, texts_of))
    values, texts_of = values[order], texts_of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (texts_of[1:] != texts_of[:-1])
    values, texts_of = values[fresh], texts_of[fresh]
    return values, np.searchsorted(texts_of, np.arange(len(count) + 1))


def signatures(values, first):
    """The band keys (a row of PERMUTATIONS // BAND) and a 128-bit identity of each non-empty set."""
    full = np.flatnonzero(np.diff(first))
    starts = first[:-1][full]
    bands = np.zeros((len(full), PERMUTATIONS // BAND), np.uint64)
    if not len(full):
        return full, bands, bands[:, 0], bands[:, 0]
    for p in range(PERMUTATIONS):
        y = (values ^ _SEEDS[2 * p]) * (_SEEDS[2 * p + 1] | np.uint64(1))
        y ^= y >> np.uint64(32)
        y *= np.uint64(0x94D049BB133111EB)
        key = bands[:, p // BAND]
        key *= np.uint64(0xD6E8FEB86659FD93)
        key += W.mix(np.minimum.reduceat(y, starts))
        key *= np.uint64(0xA24BAED4963EE407)
        key += W.mix(np.maximum.reduceat(y, starts) + np.uint64(p))
    bands = W.mix(bands + np.arange(1, bands.shape[1] + 1, dtype=np.uint64))
    return full, bands, np.add.reduceat(W.mix(values), starts), np.add.reduceat(W.mix(values ^ _SEEDS[0]), starts)


def _sign(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text"):
            values, first = shingle_sets(batch.column("text"))
            full, bands, k1, k2 = signatures(values, first)
            has = np.diff(first) > 0
            at = np.concatenate([[0], np.cumsum(has)]) * bands.shape[1]
            one, two = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            one[full], two[full] = k1.view(np.int64), k2.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(one), pa.array(two),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))],
                ["id", "n", "k1", "k2", "bands"])


def _sets(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text"):
            values, first = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))],
                ["id", "shingles"])


def _confirmed(pairs, sets, percent):
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def _small_pairs(placed, percent):
    """Members of one bucket in different components, whose sizes allow the similarity."""
    left = placed.select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = placed.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    able = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return left.join(right, "bucket").filter((F.col("ca") < F.col("cb")) & able).select("a", "b").distinct()


def _block_links(placed, sets, percent):
    """Links (u, v) between components in large buckets, from blocks of about BLOCK_SETS members.

    The members of a bucket outside the component of its smallest id are cut into blocks, and so is that component;
    each outer block meets every other block.
    """
    outer = F.col("c") != F.col("low")

    def blocks(side):
        count, volume = F.count_if(side), F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0))
        return F.greatest(F.lit(1), F.ceil(count / BLOCK_SETS), F.ceil(volume / BLOCK_SHINGLES)).cast("int")

    cuts = placed.groupBy("bucket").agg(blocks(outer).alias("outer_blocks"), blocks(~outer).alias("inner_blocks"))
    mine = F.pmod(F.xxhash64("id"), F.when(outer, F.col("outer_blocks")).otherwise(F.col("inner_blocks"))).cast("int")

    def unit(i, j, kind):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))

    b, others = F.col("b"), F.sequence(F.lit(0), F.col("outer_blocks") - 1)
    with_inner = F.transform(F.sequence(F.lit(0), F.col("inner_blocks") - 1), lambda j: unit(b, j, 1))
    among = F.transform(others, lambda j: unit(F.least(b, j), F.greatest(b, j), 0))
    units = (F.when(~outer, F.transform(others, lambda i: unit(i, b, 1)))
             .when(F.col("outer_blocks") > 1, F.concat(with_inner, among)).otherwise(with_inner))
    sent = (placed.join(cuts, "bucket").withColumn("b", mine).select("bucket", "id", "c", F.explode(units).alias("unit"))
            .select("bucket", "unit.*", "id", "c").join(sets, "id").drop("id"))
    kind = placed.schema["c"].dataType.simpleString()
    return sent.groupBy("bucket", "i", "j", "kind").applyInArrow(_solve(percent), f"u {kind}, v {kind}")


def _solve(percent):
    def run(table):
        table = table.combine_chunks()
        names = table.column("c").to_pylist()
        labels = sorted(set(names))
        number = {c: i for i, c in enumerate(labels)}
        of = np.array([number[c] for c in names])
        lists = table.column("shingles").combine_chunks() if isinstance(table.column("shingles"), pa.ChunkedArray) else table.column("shingles")
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, (_, column) = row[shared], np.unique(column[shared], return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(size), len(size)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            some, at = np.unique(row[a:b], return_inverse=True)
            part = np.zeros((len(some), COLUMNS), np.float32)
            part[at, column[a:b] - first] = 1
            both[np.ix_(some, some)] += part @ part.T
        linked = 100 * both >= percent * (size[:, None] + size[None] - both)
        x, y = np.nonzero(linked & (of[:, None] < of[None]))
        root = list(range(len(labels)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        kept = []
        for key in np.unique(of[x] * len(labels) + of[y]).tolist():
            i, j = find(key // len(labels)), find(key % len(labels))
            if i != j:
                root[max(i, j)] = min(i, j)
                kept.append((key // len(labels), key % len(labels)))
        kind = table.schema.field("c").type
        return pa.table({"u": pa.array([labels[i] for i, _ in kept], kind), "v": pa.array([labels[j] for _, j in kept], kind)})
    return run


def near_duplicates(documents: DataFrame, tables: Tables, id="doc_id", text="text", percent=85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable over links) and kept."""
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = tables.write("signed", rows.mapInArrow(_sign, f"id {kind}, n long, k1 long, k2 long, bands array<long>"))
    full = signed.filter("n > 0")
    classes = full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    # a band's key is hashed with its number, so one column names a bucket
    members = (full.join(classes.filter("rep is not null"), ["k1", "k2", "n"]).filter("id = rep")
               .select("id", "n", F.explode("bands").alias("bucket")))
    members = tables.write("members", members)
    crowded = members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    members = tables.write("crowded", members.join(crowded.select("bucket", "pivot"), "bucket"))
    tables.drop("members")
    wanted = members.select("id").distinct()
    one_each = rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])  # needs no further shuffle
    sets = tables.write("sets", one_each.mapInArrow(_sets, f"id {kind}, shingles array<long>"))
    pairs = members.filter("id <> pivot").groupBy("id").agg(F.min("pivot").alias("b")).select(F.col("id").alias("a"), "b")
    found = components(_confirmed(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), tables, "found0")
    placed = tables.write("placed", members.drop("pivot").join(found, "id", "left")
                          .select("bucket", "id", "n", F.coalesce("component", "id").alias("c")))
    split = (placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"))
             .filter("low < high").select("bucket", "low", "size"))
    placed = tables.write("split", placed.join(split, "bucket"))
    small = _confirmed(_small_pairs(placed.filter(F.col("size") <= SMALL_BUCKET), percent), sets, percent)
    large = _block_links(placed.filter(F.col("size") > SMALL_BUCKET), sets, percent)
    fresh = tables.write("fresh", small.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(large))
    stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = components(stars.unionByName(fresh), tables, "found1")
    tables.drop("crowded", "sets", "placed", "split", "fresh", "found0")
    joined = (signed.join(classes, ["k1", "k2", "n"], "left").join(found.withColumnRenamed("id", "rep"), "rep", "left"))
    component = F.coalesce("component", "rep", "id")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         (F.col("id") == component).alias("kept"))


def keep_one(documents: DataFrame, id="doc_id", text="text", percent=85) -> DataFrame:
    """One document of each group: the row of its smallest id (rows that repeat an id stay as they are)."""
    tables = Tables(documents.sparkSession, "neardedup")
    gone = near_duplicates(documents, tables, id, text, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = packed(documents, text)
    return unpacked(rows.join(gone, F.col(f"row.`{id}`") == F.col("_gone"), "left_anti"), documents.columns, text)


def op9_minhash_near_dedup(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents, Tables(spark, "op9"))


OP9_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 85 * (a.n + b.n - common)),
e as (select x as u, y as v from l union all select y, x from l),
r as (select doc_id as id, doc_id as c from documents union select e.v, r.c from r join e on e.u = r.id where r.c < e.v),
c as (select id, min(c) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on n.doc_id = d.doc_id join c on c.id = d.doc_id
"""
