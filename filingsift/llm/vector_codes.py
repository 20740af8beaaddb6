"""Vector code compression: a product quantiser whose codebooks are fitted by ball k-means.

A vector of integers is cut into ``PARTS`` equal parts, and each part is coded as the number of its nearest
codebook entry. An entry and the parts assigned to it are a ball. Once the entries have moved, a part of the ball
of entry c at distance d can only be nearer to an entry c' with |c - c'| <= 2 d. So

* the ball's radius (its largest d) gives the ball's neighbours, the entries within twice the radius of c;
* sorted by distance from c, the neighbours divide the ball into rings, and a part meets only the neighbours up
  to its own ring;
* parts inside half the distance to the nearest neighbour, the stable core, keep their entry without a comparison.

The restriction is exact: all arithmetic is on integers, and an entry at equal distance lies within the bound.
A ball is spread over tasks; each task uses the radius of its own share, which only shortens the list. The first
assignment has no balls yet and compares with every entry.

Each round is one pass: a task reads vectors with their codes, writes them with their new codes, and adds as its
last rows the sums of its parts by entry, (parts x entries) rows per task. The next codebook, of parts x entries
x part length numbers, is the only thing that reaches the driver.

Defined results: vectors that are null or hold a null or non-finite component are dropped. The codebooks are those
of the commonest length that is a multiple of ``PARTS`` (of equally common ones the smallest); a vector of another
length keeps its row with null code and error. Components beyond +-``LARGEST`` count as that. Rows with a null id
come last in the order of ids and repeated ids count as often as they come, in the order of their components;
fewer than ``ENTRIES`` vectors make a smaller codebook; equal entries leave the later one unused; an empty table
gives an empty result; other columns play no part.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filingsift.llm.keyed import attach
from filingsift.llm.tables import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
STEP = 1 << 20


def squares(a, b):
    """Squared distances of all rows of a to all rows of b; exact, since no product or sum of them reaches 2**53 in
    floating point, and integers serve otherwise."""
    if a.size and b.size and 4 * a.shape[1] * max(np.abs(a).max(), np.abs(b).max()) ** 2 < 1 << 53:
        f, g = a.astype(np.float64), b.astype(np.float64)
        return (np.square(f).sum(1)[:, None] - 2 * (f @ g.T) + np.square(g).sum(1)[None]).astype(np.int64)
    return np.square(a).sum(1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(1)[None]


class Balls:
    """The entries of one part position, and each entry's neighbours by distance."""

    def __init__(self, entries):
        self.entries = entries
        between = squares(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.gap = np.take_along_axis(between, self.order, 1)
        self.compared = 0

    def nearest(self, x):
        """(entry, squared distance) of each row by comparison with all."""
        d = squares(x, self.entries)
        entry = d.argmin(1)
        self.compared += d.size
        return entry, d[np.arange(len(x)), entry]

    def moved(self, x, entry):
        """The same for rows whose entry before the entries moved is known."""
        d = np.square(x - self.entries[entry]).sum(1)
        self.compared += len(d)
        ring = np.ones(len(x), np.int64)
        by_ball = np.argsort(entry, kind="stable")
        bounds = np.searchsorted(entry[by_ball], np.arange(len(self.entries) + 1))
        for ball in np.flatnonzero(np.diff(bounds)).tolist():
            rows = by_ball[bounds[ball]:bounds[ball + 1]]
            own = d[rows]
            gap = self.gap[ball]
            neighbours = gap[:np.searchsorted(gap, 4 * own.max(), "right")]
            ring[rows] = np.searchsorted(neighbours, 4 * own, "right")
        entry, d = entry.copy(), d.copy()
        outside = np.flatnonzero(ring > 1)  # the others are in a stable core
        at, step = 0, max(1, STEP // (x.shape[1] * len(self.entries)))
        while at < len(outside):
            rows = outside[at:at + step]
            at += step
            begin = np.concatenate([[0], np.cumsum(ring[rows])[:-1]])
            row = np.repeat(rows, ring[rows])
            place = np.arange(len(row)) - np.repeat(begin, ring[rows])
            other = self.order[entry[row], place]
            away = np.square(x[row] - self.entries[other]).sum(1)
            self.compared += len(away) - len(rows)
            least = np.minimum.reduceat(away, begin)
            entry[rows] = np.minimum.reduceat(np.where(away == np.repeat(least, ring[rows]), other, len(self.entries)), begin)
            d[rows] = least
        return entry, d


def _components(column, dim):
    """(indexes of the rows of ``dim`` components, their integers)."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(lengths == dim)
    values = np.floor(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False) * float(SCALE))
    return rows, np.clip(values, -LARGEST, LARGEST).astype(np.int64).reshape(len(rows), dim)


def _assign(codebooks, dim, coded, last):
    """Code every vector; ``coded`` says whether a code is there already, ``last`` whether errors or sums are wanted."""
    width = dim // PARTS

    def run(batches):
        balls = [Balls(e) for e in codebooks]
        entries = codebooks.shape[1]
        total, count, label = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64), pa.null()
        for whole in batches:
            label = whole.schema.field("label").type
            for at in range(0, whole.num_rows, max(1, STEP // dim)):
                batch = whole.slice(at, max(1, STEP // dim))
                n = batch.num_rows
                if coded:
                    rows, v = np.arange(n), np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, dim).astype(np.int64)
                    old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
                else:
                    rows, v = _components(batch.column("v"), dim)
                code, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
                for p in range(PARTS if len(rows) else 0):
                    x = v[:, p * width:(p + 1) * width]
                    entry, d = balls[p].moved(x, old[:, p].astype(np.int64)) if coded else balls[p].nearest(x)
                    code[:, p] = entry
                    error += d
                    if not last:
                        count[p] += np.bincount(entry, minlength=entries)
                        order = np.argsort(entry, kind="stable")
                        here, begin = np.unique(entry[order], return_index=True)
                        total[p, here] += np.add.reduceat(x[order], begin)
                codes = code.tobytes()
                if last:
                    named = [codes[i:i + PARTS].hex() for i in range(0, len(codes), PARTS)]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(named, pa.string()), pa.array(error)],
                                                     ["id", "label", "code", "error"])
                    continue
                numbers, pick = v.astype("<i4").tobytes(), pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pick), batch.column("label").take(pick),
                     pa.array([numbers[i:i + 4 * dim] for i in range(0, len(numbers), 4 * dim)], pa.binary()),
                     pa.array([codes[i:i + PARTS] for i in range(0, len(codes), PARTS)], pa.binary()),
                     *(pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                    ["id", "label", "v", "code", "part", "entry", "n", "total"])
        if not last and count.any():
            part, entry = np.nonzero(count)
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, label), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
                 pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
                ["id", "label", "v", "code", "part", "entry", "n", "total"])
    return run


def _moved(codebooks, sums):
    """Each entry at the componentwise floor of the mean of its parts; unused entries stay."""
    found = (sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
             .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    out = codebooks.copy()
    for r in found.collect():  # parts x entries x part length numbers
        out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return out


def codebook_digest(codebooks):
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, tables: Tables, id="vec_id", column="embedding", label="label", entries=ENTRIES, rounds=ROUNDS):
    """(rows, codebooks): rows of id, label, code (two hex digits a part) and error; codebooks as an array
    (part, entry, component), None without vectors."""
    x = F.col(column).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(whole).select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), x.alias("v"))
    size = F.size("v")
    common = (kept.filter((size > 0) & (size % PARTS == 0)).groupBy(size.alias("dim")).count()
              .orderBy(F.desc("count"), "dim").limit(1).collect())
    other = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not common:
        return other, None
    dim = common[0]["dim"]
    fitting = kept.filter(size == dim)
    first = fitting.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    whole_first = np.clip(np.floor(np.array([r["v"] for r in first]) * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)
    codebooks = whole_first.reshape(len(first), PARTS, dim // PARTS).swapaxes(0, 1).copy()
    kind = kept.schema["label"].dataType.simpleString()
    coded = f"id long, label {kind}, v binary, code binary, part int, entry int, n long, total array<long>"
    rows = fitting
    for number in range(rounds):
        rows = tables.write(f"round{number}", rows.mapInArrow(_assign(codebooks, dim, number > 0, False), coded))
        tables.drop(f"round{number - 1}")
        codebooks = _moved(codebooks, rows.filter("part is not null").select("part", "entry", "n", "total"))
        rows = rows.filter("part is null").select("id", "label", "v", "code")
    done = rows.mapInArrow(_assign(codebooks, dim, rounds > 0, True), f"id long, label {kind}, code string, error long")
    return done.unionByName(other.filter(size != dim)), codebooks


def with_label_errors(rows: DataFrame, tables: Tables) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (null where no 64-bit number holds the sum)."""
    rows = tables.write("coded", rows)
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.try_sum("error").alias("label_error"))
    return attach(rows, tables.write("labels", sums), ["label"]).drop("n_rows")


def op11_vector_codes(spark, sf_dir):
    tables = Tables(spark, "op11")
    rows, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), tables)
    digest = F.lit(None if codebooks is None else codebook_digest(codebooks)).cast("string")
    return with_label_errors(rows, tables).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _op11_sql():
    width = f"(len(v) // {PARTS})"
    parts = [f"""
with k as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
o as (select *, row_number() over (order by vec_id, v) - 1 as o from k),
p as (select r, o, part, v[part * {width} + 1:(part + 1) * {width}] as x from o, unnest(range({PARTS})) as t(part)),
c0 as (select part, o as entry, x as c from p where o < {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
a{n} as (select r, part, min(d * {ENTRIES} + entry) % {ENTRIES} as entry, min(d) as d from (
  select r, part, entry, cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
  from p join c{n} using (part)) group by r, part)""")
        if n < ROUNDS:
            parts.append(f"""
m{n} as (select part, entry, i, cast(sum(x) as bigint) as s, count(*) as n from (
  select part, entry, unnest(x) as x, unnest(range(len(x))) as i from p join a{n} using (r, part)) group by part, entry, i),
f{n} as (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from m{n} group by part, entry),
c{n + 1} as (select part, entry, coalesce(f{n}.c, c{n}.c) as c from c{n} left join f{n} using (part, entry))""")
    parts.append(f"""
e as (select r, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as h from c{ROUNDS})""")
    return ",".join(parts) + """
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from k join e using (r), h
"""


OP11_SQL = _op11_sql()
