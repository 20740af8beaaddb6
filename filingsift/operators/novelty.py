"""How much of a filing repeats the previous filing of its company.

Every chunk is compared with all chunks of the previous filing by the cosine of TF-IDF vectors that
are fitted on that previous filing alone. All models are fitted in one grouped job keyed by the
reference filing.

Similarities are sums over shared terms. Identical texts of a filing are searched once. Terms are spelled out until one task has
numbered and weighed a bucket of them for a filing and its predecessor; from then on a text is a row of numbers. Blocks of texts
are compared with blocks of the reference filing in one task each, all pairs of them: terms that many texts have as a product of
matrices, the others pair by pair of the texts that share them. What a task holds is bounded by its blocks, the result is that
of the exhaustive comparison, and only a text's best match in a block leaves the task.

:func:`candidates` finds the pairs that may be a best match by joins alone: frequent terms whose joint contribution cannot reach a
lower bound are left out of the join. That contribution is at most the sum over the terms of the text's weight times the
largest weight any text gives the term, and at most the length of the left-out part of the text's vector,
since the other vector has length one; the smaller of the two counts.
"""
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingsift.functions import text as tx
from filingsift.operators import vocab
from filingsift.operators.dedup import require_unique
from filingsift.operators.joins import previous_filings
from filingsift.session import materialize, release_since, scratch_mark

SCORED_CATEGORIES = ["potential_boilerplate", "modified_disclosure", "potential_novel_disclosure"]
CATEGORIES = ["no_history"] + SCORED_CATEGORIES
SLACK = 1e-9
# a term held by more texts of a block than this is multiplied as a column of a matrix
FREQUENT = 256
# characters of a filing and its predecessor that are searched at a time, all pairs of a round together
ROUND_CHARS = 1 << 28
BUCKETS = 1024
# pairs of a text and a text of its reference filing whose blocks may lie on disk at a time
ROUND_PAIRS = 1 << 29
# characters of texts whose terms one task weighs, about four to a term
BUCKET_CHARS = 1 << 23
# texts of a filing, and of its reference filing, that one task compares
NOW_TEXTS, PAST_TEXTS = 4096, 4096
# rows of products, columns of matrices and single products at a time
TILE, COLUMNS, PRODUCTS = 256, 512, 1 << 17
TEXT = ["filing_id", "rep", "rep_number", "copies"]


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """Texts of every filing with the number of copies and the first chunk that holds each."""
    keyed = chunks.withColumn("text_key", F.sha2("chunk_text", 256))
    return (keyed.groupBy("company", "filing_id", "text_key")
            .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("chunk_number", "chunk_id")).alias("_first"),
                 F.first("chunk_text").alias("chunk_text"))
            .select("company", "filing_id", "text_key", "copies", F.col("_first.chunk_id").alias("rep"),
                    F.col("_first.chunk_number").alias("rep_number"), "chunk_text"))


def references(chunks: DataFrame) -> DataFrame:
    """Every filing with the one before it."""
    return materialize(previous_filings(chunks.select("company", "filing_id", "filing_date")), "references")


def in_rounds(chunks: DataFrame, refs: DataFrame, work, most=None) -> DataFrame:
    """``work(chunks, refs)`` for some filings and their predecessors at a time, the results as one written table.

    A pair of a filing and its predecessor needs no other filing, so what a pair leaves on disk while it is searched
    can go before the next ones begin: a round holds pairs of about ``most`` characters (a larger pair is a round of
    its own), and its weights and shuffles are dropped once its result is written. A company that fits a quarter of a
    round stays together, so that its filings are read once.
    """
    spark = chunks.sparkSession
    most = ROUND_CHARS if most is None else most
    sizes = materialize(chunks.groupBy("filing_id").agg(F.sum(F.coalesce(F.length("chunk_text"), F.lit(0))).alias("chars")), "sizes")
    pairs = (refs.filter("reference_filing_id is not null").join(sizes, "filing_id")
             .join(sizes.select(F.col("filing_id").alias("reference_filing_id"), F.col("chars").alias("_before")), "reference_filing_id")
             .withColumn("_chars", F.col("chars") + F.col("_before")).drop("chars", "_before"))
    whole = pairs.groupBy(F.xxhash64("company").alias("_company")).agg(F.sum("_chars").alias("_whole"))
    bucket = F.pmod(F.when(F.col("_whole") <= most / 4, F.col("_company")).otherwise(F.xxhash64("_company", "reference_filing_id")), F.lit(BUCKETS))
    pairs = materialize(pairs.withColumn("_company", F.xxhash64("company")).join(whole, "_company")
                        .withColumn("_bucket", bucket).drop("_company", "_whole"), "pairs")
    # at most BUCKETS rows
    held = [(r["n"], r["_bucket"]) for r in pairs.groupBy("_bucket").agg(F.sum("_chars").alias("n")).collect()]
    rounds = _packed(held, most)
    results = []
    for buckets in rounds or [None]:
        before = scratch_mark()
        if len(rounds) <= 1:
            some, mine = chunks, refs
        else:
            mine = materialize(pairs.filter(F.col("_bucket").isin(buckets)).select(*refs.columns), "round-pairs")
            filings = mine.select("filing_id").unionByName(mine.select(F.col("reference_filing_id").alias("filing_id"))).distinct()
            some = chunks.join(materialize(filings, "round-filings"), "filing_id", "left_semi")
        results.append(materialize(work(some, mine), "round"))
        release_since(spark, before, keep=1)
    return reduce(DataFrame.unionByName, results)


def _packed(held, most):
    """Buckets of sizes up to ``most`` in all, first fit, the largest first."""
    rounds = []
    for n, b in sorted(held, reverse=True):
        for r in rounds:
            if r[0] + n <= most:
                r[0] += n
                r[1].append(b)
                break
        else:
            rounds.append([n, [b]])
    return [r[1] for r in rounds]


class Weights(tuple):
    """(texts, filing references, past, now); ``packed`` holds the rows that past and now are read from."""
    def __new__(cls, tables, packed):
        made = super().__new__(cls, tables)
        made.packed = packed
        return made


def reference_weights(chunks: DataFrame, refs: DataFrame | None = None) -> Weights:
    """TF-IDF weights of reference texts and of the texts compared with them, not yet scaled.

    Returns (texts, filing references, past, now): past = (ref, rep, rep_number, term, w), now = (ref,
    filing_id, rep, term, w, df). Terms the reference filing does not know are absent from ``now``. A filing
    has one successor, so (ref, rep) names a text on either side; lengths are divided out later, see
    :func:`unit`. A term is a number, the same for both sides of a reference filing. ``refs`` limits the work to its
    pairs, whose filings ``chunks`` must hold whole.

    Terms travel packed, a row per text and bucket of terms: one task sees a bucket of a reference filing and of the filing compared
    with it, counts the reference texts of each term and weighs both sides.
    """
    refs = references(chunks) if refs is None else refs
    texts = materialize(distinct_texts(chunks), "texts")
    pairs = refs.filter("reference_filing_id is not null").select(
        "filing_id", F.col("reference_filing_id").alias("ref"))
    sizes = texts.groupBy("filing_id").agg(F.sum("copies").alias("n_chunks"), F.coalesce(F.sum(F.length("chunk_text")), F.lit(0)).alias("chars"))
    # a text is compared with the filing before its own and serves as reference for the filing after it
    known = pairs.join(sizes.select(F.col("filing_id").alias("ref"), "n_chunks", F.col("chars").alias("_before")), "ref").join(
        sizes.select("filing_id", "chars"), "filing_id")
    of_ref = known.groupBy("ref").agg(F.first("n_chunks").alias("n_chunks"), (F.first("_before") + F.sum("chars")).alias("chars"))
    of_ref = materialize(of_ref.withColumn("buckets", F.greatest(F.ceil(F.col("chars") / BUCKET_CHARS), F.lit(1)).cast("int")), "reference-sizes")
    roles = of_ref.select(F.col("ref").alias("filing_id"), "ref", F.lit(True).alias("is_past"), "buckets", "n_chunks").unionByName(
        pairs.join(of_ref.drop("chars"), "ref").withColumn("is_past", F.lit(False)))
    roles = roles.groupBy("filing_id").agg(F.collect_list(F.struct("ref", "is_past", "buckets", "n_chunks")).alias("_roles"))
    groups, chars = (n or 0 for n in of_ref.agg(F.sum("buckets"), F.sum("chars")).first())
    tasks = _tasks(chunks, groups, chars / BUCKET_CHARS)
    # dealt anew, as adaptive execution would give few tasks what is long work in small bytes
    dealt = texts.join(roles, "filing_id").select("_roles", *TEXT, "chunk_text").repartition(tasks, "filing_id", "rep")
    counted = _packed_terms(dealt.select("_roles", *TEXT, tx.term_tokens("chunk_text").alias("_terms")))
    kept = ["ref", "is_past", *TEXT]
    schema = T.StructType([*[counted.schema[c] for c in kept], T.StructField("square", T.DoubleType()),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("term", "df", "alone")],
                           *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("w", "alone_w")]])
    packed = materialize(counted.repartition(tasks, "ref", "bucket").groupBy("ref", "bucket").applyInArrow(lambda table: _weighed(table, kept), _spelled_out(schema)), "weights")

    def long(rows, columns, **of):
        return rows.select(*columns, F.inline(F.arrays_zip(*[F.col(c).alias(n) for n, c in of.items()])))
    reference, names = packed.filter("is_past"), ["ref", "rep", "rep_number"]
    past = long(reference, names, term="term", w="w").unionByName(long(reference, names, term="alone", w="alone_w"))
    now = long(packed.filter("not is_past"), ["ref", "filing_id", "rep"], term="term", w="w", df="df")
    return Weights((texts.drop("chunk_text"), refs, past, now.select("ref", "filing_id", "rep", "term", "w", "df")), packed)


def _tasks(df, groups, whole):
    """Partitions for groups that hold the work of ``whole`` full ones, few of which should share one."""
    return int(max(1, min(2 * groups, 2 * df.sparkSession.sparkContext.defaultParallelism + 2 * whole)))


def _packed_terms(texts: DataFrame) -> DataFrame:
    """Terms of every text and how often it has them, as bytes: a row for each role of the text and each bucket of terms of the
    reference filing. Counted inside each row, as :func:`filingsift.operators.vocab.term_counts` does."""
    role = texts.schema["_roles"].dataType.elementType
    schema = T.StructType([role["ref"], role["is_past"], role["n_chunks"], T.StructField("bucket", T.IntegerType()), *[texts.schema[c] for c in TEXT],
                           *[T.StructField(c, T.BinaryType()) for c in ("letters", "sizes", "tf")]])

    names = [f.name for f in schema]
    # tasks find what they run by its name
    return texts.mapInArrow(lambda batches: _counted(batches, names), _spelled_out(schema))


def _spelled_out(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _cut(values, edges):
    """Bytes of numbers or letters between edges, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("int64")), pa.py_buffer(values)]).cast(pa.binary())


def _counted(batches, names):
    for batch, first, words, row in vocab._blocks(batches):
        known, code, row = vocab._coded(words, row, True)
        code, row, n = vocab._runs(code, row)
        if not len(code):
            continue
        roles = batch.column("_roles").slice(first, row[-1] + 1)
        parent, each = np.repeat(np.arange(len(roles)), pc.list_value_length(roles).to_numpy(zero_copy_only=False)), roles.flatten()
        ends = np.searchsorted(row, np.arange(len(roles) + 1))
        lengths = ends[parent + 1] - ends[parent]
        entry = np.arange(lengths.sum()) + np.repeat(ends[parent] - np.cumsum(lengths) + lengths, lengths)
        buckets = each.field("buckets").to_numpy(zero_copy_only=False)
        most, of = int(buckets.max()), np.repeat(np.arange(len(parent)), lengths)
        place = of * most
        if most > 1:
            place += (_term_hash(known, code)[entry] % buckets[of].astype("uint64")).astype("int64")
            order = np.argsort(place, kind="stable")
            entry, place = entry[order], place[order]
        edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)) if len(place) else np.zeros(1, "int64")
        terms = vocab._spelled(known, code).cast(pa.large_string()).take(pa.array(entry))
        offsets = np.frombuffer(terms.buffers()[1], "int64")[terms.offset:terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, "int64")
        mine, bucket = np.divmod(place[edges[:-1]], most)
        at = pa.array(first + parent[mine])
        yield pa.RecordBatch.from_arrays(
            [*[each.field(c).take(pa.array(mine)) for c in ("ref", "is_past", "n_chunks")], pa.array(bucket, pa.int32()),
             *[batch.column(c).take(at) for c in TEXT], _cut(terms.buffers()[2] or b"", offsets[edges]),
             _cut(np.diff(offsets).astype("int32"), 4 * edges), _cut(n[entry].astype("int32"), 4 * edges)], names)


def _term_hash(words, code):
    """A hash of terms by their words, the same in every task."""
    n = max(1, len(words))
    of_word = pd.util.hash_array(np.append(words.to_numpy(zero_copy_only=False).astype(object), "")[:max(1, len(words))])
    with np.errstate(over="ignore"):
        before = np.where(code >= n, of_word[np.maximum(code // n - 1, 0)], np.uint64(0))
        mixed = (of_word[code % n] + np.uint64(0x9E3779B97F4A7C15) * before) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(17)


def _weighed(table: pa.Table, kept) -> pa.Table:
    """Weights of the terms of a bucket: those both sides have, with their number of reference texts, and those only reference texts have."""
    tf, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), "int32") for c in ("tf", "sizes"))
    letters = b"".join(table.column("letters").to_pylist())
    edges = np.append(0, np.cumsum(sizes, dtype="int64"))
    terms = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(letters)]).dictionary_encode()
    code, n_terms = terms.indices.to_numpy(zero_copy_only=False).astype("int64"), len(terms.dictionary)
    row = np.repeat(np.arange(table.num_rows), pc.binary_length(table.column("tf")).to_numpy().astype("int64") // 4)
    of_past = table.column("is_past").to_numpy()[row]
    copies = table.column("copies").to_numpy()[row].astype("float64")
    df = np.bincount(code[of_past], copies[of_past], n_terms)
    both = (df > 0) & (np.bincount(code[~of_past], minlength=n_terms) > 0)
    w = (1.0 + np.log(tf)) * (np.log((1.0 + table.column("n_chunks")[0].as_py()) / (1.0 + df)) + 1.0)[code]
    number = code + (table.column("bucket")[0].as_py() << 32)
    shared, alone = both[code], of_past & ~both[code]
    some = np.flatnonzero(np.bincount(row, shared | alone, table.num_rows))
    place = np.zeros(table.num_rows, dtype="int64")
    place[some] = np.arange(len(some))

    def lists(values, which, kind):
        offsets = np.append(0, np.cumsum(np.bincount(place[row[which]], minlength=len(some))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[which], kind))
    square = np.bincount(row, np.where(shared | alone, w * w, 0.0), table.num_rows)[some]
    columns = [table.column(c).take(pa.array(some)) for c in kept]
    return pa.table([*columns, pa.array(square), lists(number, shared, pa.int64()), lists(df[code].astype("int64"), shared, pa.int64()),
                     lists(number, alone, pa.int64()), lists(w, shared, pa.float64()), lists(w, alone, pa.float64())],
                    names=[*kept, "square", "term", "df", "alone", "w", "alone_w"])


def lengths(weights: DataFrame, **extra) -> DataFrame:
    """Length of every vector: (ref, rep, length) and further aggregates."""
    return weights.groupBy("ref", "rep").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), *[c.alias(n) for n, c in extra.items()])


def unit(weights: DataFrame) -> DataFrame:
    """Weights divided by the length of their vector, those of long tables or of the rows of :class:`Weights`."""
    if "square" in weights.columns:
        whole = F.sqrt(F.sum("square").over(Window.partitionBy("ref", "is_past", "rep")))
        scaled = {c: F.transform(c, lambda x: x / F.col("_length")) for c in ("w", "alone_w")}
        return weights.withColumn("_length", whole).withColumns(scaled).drop("_length", "square")
    return (weights.join(lengths(weights), ["ref", "rep"])
            .withColumn("w", F.col("w") / F.col("length")).drop("length"))


def pack(past: DataFrame, now: DataFrame) -> DataFrame:
    """Long weights as one row per text: (ref, is_past, rep, rep_number, square, term, w)."""
    def rows(weights, is_past, *number):
        made = weights.groupBy("ref", "rep", *number).agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.collect_list(F.struct("term", "w")).alias("_held"))
        return made.withColumns({"is_past": F.lit(is_past), "term": F.col("_held.term"), "w": F.col("_held.w")}).drop("_held")
    return rows(past, True, "rep_number").unionByName(rows(now, False), allowMissingColumns=True)


def best_matches(past: DataFrame, now: DataFrame, frequent=FREQUENT, packed: DataFrame | None = None) -> DataFrame:
    """Exact best match of every ``now`` vector: (ref, rep, match, similarity).

    On equal similarity (to 12 decimals) the text that comes first in its filing wins. ``packed`` are the rows that past and now
    are read from, where the caller has them. Texts are compared in blocks, a block with each block of its reference filing; a text needs
    no other text of its filing, so blocks of about ``ROUND_PAIRS`` pairs are dealt out at a time and go before the next.
    """
    packed = materialize(pack(past, now), "packed") if packed is None else packed
    # a row without a shared term still counts for the length of its text
    packed = packed.filter("rep is not null").select("ref", "is_past", "rep", "rep_number", "square", "term", "w")
    sizes = (packed.select("ref", "is_past", "rep").distinct().groupBy("ref")
             .agg(F.count_if("is_past").alias("n_past"), F.count_if(~F.col("is_past")).alias("n_now")).filter("n_past > 0 and n_now > 0"))
    sizes = materialize(sizes, "sizes")
    pairs = sizes.agg(F.sum(F.col("n_past") * F.col("n_now"))).first()[0] or 0
    slices = max(1, -(-pairs // ROUND_PAIRS))
    if slices == 1:
        return _best(packed, sizes, frequent, 0, 1)
    results = []
    for k in range(slices):
        before = scratch_mark()
        results.append(materialize(_best(packed, sizes, frequent, k, slices), "best"))
        release_since(packed.sparkSession, before, keep=1)
    return reduce(DataFrame.unionByName, results)


def _best(packed: DataFrame, sizes: DataFrame, frequent, k, slices) -> DataFrame:
    """Best match of the ``now`` vectors of slice ``k`` of ``slices``."""
    blocks = sizes.select("ref", F.ceil(F.col("n_past") / PAST_TEXTS).cast("int").alias("_pasts"),
                          F.ceil(F.col("n_now") / (slices * NOW_TEXTS)).cast("int").alias("_nows"))
    rows = packed.join(blocks, "ref")
    sliced = F.pmod(F.xxhash64("ref", "rep"), F.lit(slices)) == k
    past, now = F.pmod(F.xxhash64("rep"), "_pasts").cast("int"), F.pmod(F.xxhash64("rep", F.lit("now")), "_nows").cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.filter("is_past").withColumns({"_past": past, "_now": every("_nows")}).unionByName(
        rows.filter(~F.col("is_past") & sliced).withColumns({"_now": now, "_past": every("_pasts")})).drop("_pasts", "_nows")
    groups, pairs = (n or 0 for n in sizes.join(blocks, "ref").agg(F.sum(F.col("_pasts") * F.col("_nows")), F.sum(F.col("n_past") * F.col("n_now"))).first())
    tasks = _tasks(packed, groups, pairs / (slices * NOW_TEXTS * PAST_TEXTS))
    kind = packed.schema["rep"].dataType
    schema = T.StructType([packed.schema["ref"], packed.schema["rep"], T.StructField("match", kind),
                           T.StructField("match_number", packed.schema["rep_number"].dataType), T.StructField("dot", T.DoubleType())])
    scored = (dealt.repartition(tasks, "ref", "_now", "_past").groupBy("ref", "_now", "_past")
              .applyInArrow(lambda table: _compared(table, frequent), _spelled_out(schema)))
    best = scored.groupBy("ref", "rep").agg(
        F.min_by(F.struct("match", "dot"), F.struct((-F.round("dot", 12)).alias("neg"), "match_number", "match")).alias("b"))
    return best.select("ref", "rep", F.col("b.match").alias("match"), F.col("b.dot").alias("similarity"))


class _Texts:
    """The vectors of one side of a block, scaled to length one: entries (row, term, value) in any order."""

    def __init__(self, table: pa.Table):
        rep = table.column("rep").combine_chunks().dictionary_encode()
        text, self.rep = rep.indices.to_numpy(zero_copy_only=False).astype("int64"), rep.dictionary
        number = table.column("rep_number").combine_chunks()
        self.number = number.take(pa.array(np.unique(text, return_index=True)[1]))
        size = np.sqrt(np.bincount(text, table.column("square").to_numpy(), len(self.rep)))
        terms, w = (table.column(c).combine_chunks() for c in ("term", "w"))
        self.row = np.repeat(text, pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        self.term, self.w = terms.flatten().to_numpy(), w.flatten().to_numpy() / size[self.row]

    def in_order(self):
        """The rows by number and name, as ties are decided."""
        order = pc.sort_indices(pa.table([self.number, self.rep], names=["number", "rep"]), [("number", "ascending"), ("rep", "ascending")],
                                null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype="int64")
        place[order] = np.arange(len(order))
        self.rep, self.number, self.row = self.rep.take(pa.array(order)), self.number.take(pa.array(order)), place[self.row]
        return self

    def only(self, kept):
        return self.row[kept], self.term[kept], self.w[kept]


def _products(now: _Texts, past: _Texts, frequent):
    """Cosines of all pairs. Terms that more than ``frequent`` past texts have are multiplied as matrices, the others pair by pair."""
    names, place = np.unique(np.append(now.term, past.term), return_inverse=True)
    now.term, past.term = place[:len(now.term)], place[len(now.term):]
    held = np.bincount(past.term, minlength=len(names))
    common = (held > 0) & (np.bincount(now.term, minlength=len(names)) > 0)
    dense = np.flatnonzero(common & (held > frequent))
    dots = np.zeros((len(now.rep), len(past.rep)))
    column = np.full(len(names), -1)
    column[dense] = np.arange(len(dense))
    for first in range(0, len(dense), COLUMNS):
        width, sides = min(COLUMNS, len(dense) - first), []
        for side in (now, past):
            at = column[side.term] - first
            mine = (at >= 0) & (at < width)
            matrix = np.zeros((len(side.rep), width))
            matrix[side.row[mine], at[mine]] = side.w[mine]
            sides.append(matrix)
        for a in range(0, len(dots), TILE):
            dots[a:a + TILE] += sides[0][a:a + TILE] @ sides[1].T
    rare = common & (held <= frequent)
    row, term, w = now.only(rare[now.term])
    to, name, p = past.only(rare[past.term])
    order = np.argsort(name, kind="stable")
    to, p = to[order], p[order]
    start = np.append(0, np.cumsum(np.bincount(name, minlength=len(names))))
    order = np.argsort(row, kind="stable")
    row, term, w = row[order], term[order], w[order]
    many = start[term + 1] - start[term]
    ends, first, flat = np.cumsum(many), 0, dots.reshape(-1)
    while first < len(row):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PRODUCTS, "right")))
        n = many[first:last]
        at = np.arange(n.sum()) + np.repeat(start[term[first:last]] - np.cumsum(n) + n, n)
        np.add.at(flat, np.repeat(row[first:last] * len(past.rep), n) + to[at], np.repeat(w[first:last], n) * p[at])
        first = last
    return dots


def _compared(table: pa.Table, frequent) -> pa.Table:
    """Best match of every text of a block among the texts of a block of its reference filing."""
    is_past = table.column("is_past").combine_chunks()
    past, now = _Texts(table.filter(is_past)), _Texts(table.filter(pc.invert(is_past)))
    past.in_order()
    found = [[], [], []]
    dots = _products(now, past, frequent) if len(now.rep) and len(past.rep) else np.zeros((0, 1))
    for a in range(0, len(dots), TILE):
        part = dots[a:a + TILE]
        most = part.max(axis=1)
        row, match = np.nonzero((part >= (most - SLACK)[:, None]) & (part > 0))
        dot = part[row, match]
        order = np.lexsort((match, -np.round(dot, 12), row))
        best = order[np.unique(row[order], return_index=True)[1]]
        for column, values in zip(found, (row[best] + a, match[best], dot[best])):
            column.append(values)
    row, match, dot = (np.concatenate(c) if c else np.zeros(0, "int64") for c in found)
    ref = table.column("ref").combine_chunks().take(pa.array(np.zeros(len(row), "int64")))
    match = pa.array(match, pa.int64())
    return pa.table([ref, now.rep.take(pa.array(row, pa.int64())), past.rep.take(match), past.number.take(match), pa.array(dot, pa.float64())],
                    names=["ref", "rep", "match", "match_number", "dot"])


def candidates(now: DataFrame, past: DataFrame, frequent=FREQUENT):
    """Pairs of unit vectors that may be a best match, and what was left out of the join that found them.

    ``past`` is (ref, match, match_number, term, p). Returns (able, left_out): able = (ref, rep, match, match_number,
    part) with the sum over the joined terms, left_out = (ref, rep, term, w).
    """
    top = past.groupBy("ref", "term").agg(F.max(F.struct("p", "match")).alias("_top"))
    top = top.select("ref", "term", F.col("_top.p").alias("pmax"), F.col("_top.match").alias("champion"))
    now = materialize(now.join(top, ["ref", "term"])
                      .select("ref", "rep", "term", "w", "df", "champion", (F.col("w") * F.col("pmax")).alias("ub")), "bounds")
    # lower bound: the text that leads on most of the weight, scored on all shared terms
    led = now.groupBy("ref", "rep", "champion").agg(F.sum("ub").alias("s"))
    lead = led.groupBy("ref", "rep").agg(F.max_by("champion", F.struct("s", "champion")).alias("match"))
    bound = _dots(now, past, lead).select("ref", "rep", F.col("dot").alias("bound"))
    # the most frequent terms first; leave them out while together they stay below the bound
    vector = Window.partitionBy("ref", "rep")
    so_far = vector.orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("w") * F.col("w")
    spent = F.least(F.sum("ub").over(so_far), F.sqrt(F.sum(square).over(so_far)))
    left_out = (F.col("_spent") < F.col("bound") - SLACK) & (F.col("df") > frequent)

    def over_left_out(value):
        return F.coalesce(F.sum(F.when(F.col("left_out"), value)).over(vector), F.lit(0.0))
    split = (now.join(bound, ["ref", "rep"]).withColumn("_spent", spent).withColumn("left_out", left_out)
             .withColumn("rest", F.least(over_left_out(F.col("ub")), F.sqrt(over_left_out(square)))))
    split = materialize(split.select("ref", "rep", "term", "w", "bound", "rest", "left_out"), "split")
    partial = (split.filter("not left_out").join(past, ["ref", "term"]).groupBy("ref", "rep", "match", "match_number")
               .agg(F.sum(F.col("w") * F.col("p")).alias("part"), F.first("bound").alias("bound"), F.first("rest").alias("rest")))
    able = materialize(partial.filter(F.col("part") + F.col("rest") >= F.col("bound") - SLACK)
                       .select("ref", "rep", "match", "match_number", "part"), "able")
    return able, split.filter("left_out").select("ref", "rep", "term", "w")


def _dots(now: DataFrame, past: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum over shared terms for given (ref, rep, match) pairs."""
    return (pairs.join(now.select("ref", "rep", "term", "w"), ["ref", "rep"])
            .join(past.drop("match_number"), ["ref", "match", "term"])
            .groupBy("ref", "rep", "match").agg(F.sum(F.col("w") * F.col("p")).alias("dot")))


def category(similarity, high=0.80, low=0.40) -> Column:
    if not 0 <= low < high <= 1:
        raise ValueError("Invalid similarity thresholds.")
    s = F.col(similarity)
    return (F.when(s >= high, "potential_boilerplate").when(s >= low, "modified_disclosure")
            .otherwise("potential_novel_disclosure"))


def text_matches(chunks: DataFrame, refs: DataFrame, frequent=FREQUENT) -> DataFrame:
    """Best match of every distinct text of a filing that shares a term with its reference filing: (filing_id, text_key,
    rep, match, similarity)."""
    weighed = reference_weights(chunks, refs)
    texts, _, past, now = weighed
    return (texts.select("filing_id", "text_key", "rep")
            .join(refs.select("filing_id", F.col("reference_filing_id").alias("ref")), "filing_id")
            .join(best_matches(past, now, frequent, weighed.packed), ["ref", "rep"]).drop("ref"))


def score_chunks(chunks: DataFrame, high=0.80, low=0.40, frequent=FREQUENT) -> DataFrame:
    """Every chunk with its reference filing, best match, similarity, novelty and category."""
    if not 0 <= low < high <= 1:
        raise ValueError("Invalid similarity thresholds.")
    require_unique(chunks, ["filing_id", "chunk_id"])
    refs = references(chunks)
    found = in_rounds(chunks, refs, lambda some, pairs: text_matches(some, pairs, frequent))
    # a chunk id is unique within its filing only, so every join carries the filing it belongs to
    texts = distinct_texts(chunks)
    best = found.select("filing_id", "text_key", "match", F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0)).alias("s"))
    keyed = chunks.withColumn("text_key", F.sha2("chunk_text", 256)).join(
        refs.select("filing_id", "reference_filing_id", "reference_filing_date"), "filing_id")
    matched = keyed.join(best, ["filing_id", "text_key"], "left").drop("text_key")
    if matched.count() != chunks.count():
        raise ValueError("novelty scoring lost or added rows")
    # the matched texts are fetched as the result is read, so a result without them moves none
    rows = matched.join(texts.select(F.col("filing_id").alias("reference_filing_id"), F.col("rep").alias("match"),
                                     F.col("chunk_text").alias("matched_chunk_text")), ["reference_filing_id", "match"], "left")
    known = F.col("reference_filing_id").isNotNull()
    shared = F.coalesce(F.col("s") > 0, F.lit(False))
    scored = rows.withColumn("max_similarity", F.when(known, F.when(shared, F.col("s")).otherwise(0.0)))
    return (scored.withColumns({
        "matched_chunk_id": F.when(known & shared, F.col("match")),
        "matched_chunk_text": F.when(known & shared, F.col("matched_chunk_text")),
        "novelty_score": F.lit(1.0) - F.col("max_similarity"),
        "boilerplate_category": F.when(known, category("max_similarity", high, low)).otherwise("no_history"),
        "scoring_status": F.when(~known, "no_history").when(shared, "scored").otherwise("no_shared_terms"),
        "high_threshold": F.lit(high), "low_threshold": F.lit(low),
        "scoring_method": F.lit("historical_tfidf_cosine_v1")})
        .select("filing_id", *[c for c in chunks.columns if c != "filing_id"], "reference_filing_id", "reference_filing_date", "matched_chunk_text",
                "max_similarity", "matched_chunk_id", "novelty_score", "boilerplate_category", "scoring_status", "high_threshold",
                "low_threshold", "scoring_method"))
