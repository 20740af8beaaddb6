"""Mixing sources to target weights by pivotal dependent rounding.

A source's target says how often each of its documents should be taken on average: a ratio between 0 and ``MOST``.
Its whole part is taken for certain; its fraction is a copy probability, and all documents of the source start with
the same one. Pivotal rounding takes two documents with fractional probabilities and moves mass, counted in words,
from one to the other until one of them is 0 or 1; which way is drawn so that no probability changes on average.
The other one stays fractional and meets the next document. A source's words therefore never move away from its
target by more than the one document that is left over in the end.

The pairs form a reduction tree: documents are dealt by a hash to blocks of about ``BLOCK`` within their source, each
block is folded to decisions and one fractional document, and these meet in the blocks of the next level, until every
source has one left, which is rounded by a draw of its own. Each level is a shuffle of small rows without texts, and
the blocks of a dominant source are as many as it needs. All draws are hashes of seed and row keys, so reruns agree.

Everything is a DataFrame or SQL function; a block is folded by ``aggregate`` over an array of bounded length.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, the
last; rows that repeat id, text and source are one document of their joint size, each taken equally often; sources
without words have target 0; an empty table gives an empty result; other columns play no part.
"""
from pyspark.sql import DataFrame, Window, functions as F

from filingsift.llm.keyed import attach
from filingsift.llm.tables import Tables
from filingsift.operators.ranks import null_safe_join

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SOURCES_PER_RANGE = 100_000
ROWS_AT_ONCE = 65_536
_BLANK = " \t\n\u000b\f\r"


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each word and the blanks before it become one letter."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(_BLANK))), F.lit(0)).cast("long")


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(*keys):
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0 ** -53)


def pivot(a, b, seed):
    """struct(done, left): one of two documents decided (its ``p`` is 0 or 1), the other with the mass that is left.

    A document has a key ``h``, a mass ``s`` and a probability ``p``; ``p * s`` summed over both does not change.
    """
    moves = F.struct(a.alias("a"), b.alias("b"), _draw(F.lit(seed), a["h"], b["h"]).alias("u"),
                     F.least((1 - a["p"]) * a["s"], b["p"] * b["s"]).alias("up"),
                     F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"]).alias("down"))

    def choose(t):
        up = t["u"] * (t["up"] + t["down"]) < t["down"]  # a gains what b loses
        ends = F.when(up, (1 - t["a"]["p"]) * t["a"]["s"] <= t["b"]["p"] * t["b"]["s"]).otherwise(
            t["a"]["p"] * t["a"]["s"] <= (1 - t["b"]["p"]) * t["b"]["s"])
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), up.alias("up"), ends.alias("a_ends"),
                        F.when(up, t["up"]).otherwise(-t["down"]).alias("gain"))

    def settle(t):
        gain = F.when(t["up"], 1.0).otherwise(0.0)
        within = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        done = F.when(t["a_ends"], t["a"].withField("p", gain)).otherwise(t["b"].withField("p", 1 - gain))
        left = F.when(t["a_ends"], t["b"].withField("p", within(t["b"]["p"] - t["gain"] / t["b"]["s"]))).otherwise(
            t["a"].withField("p", within(t["a"]["p"] + t["gain"] / t["a"]["s"])))
        return F.struct(done.alias("done"), left.alias("left"))
    return _let(_let(moves, choose), settle)


def _fold(items, seed):
    """struct(left, done) of a block: its documents in their order, each meeting what the ones before left over."""
    start = F.struct(items[0].alias("left"), F.slice(items, 1, 0).alias("done"))

    def meet(state, item):
        return _let(pivot(state["left"], item, seed), lambda t: F.struct(
            t["left"].alias("left"), F.concat(state["done"], F.array(t["done"])).alias("done")))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, meet)


def round_copies(items: DataFrame, tables: Tables, by, seed) -> DataFrame:
    """Decide every item: rows (``by``, item) whose ``item.p`` is 0 or 1.

    ``items``: a group ``by``, the number ``n`` of its items and a struct ``item`` with fields h (distinct in its
    group), s (over 0) and p.
    """
    most = items.agg(F.max("n")).first()[0]
    decided, number = items.select(by, "item").limit(0), 0
    while most:
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        dealt = items.select(by, blocks.alias("n"), "item").withColumn(
            "block", F.pmod(F.xxhash64(F.lit(f"{seed}:{number}"), F.col("item.h")), F.col("n")))
        folded = (dealt.groupBy(by, "n", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
                  .select(by, "n", _fold(F.col("items"), f"{seed}:{number}").alias("t")))
        folded = tables.write(f"level{number}", folded.select(by, "n", F.col("t.left").alias("item"), "t.done"))
        decided = decided.unionByName(folded.select(by, F.explode("done").alias("item")))
        items, number, most = folded.select(by, "n", "item"), number + 1, -(-most // BLOCK)
        if most == 1:
            break
    last = F.when(_draw(F.lit(f"{seed}:last"), F.col("item.h")) < F.col("item.p"), 1.0).otherwise(0.0)
    return decided.unionByName(items.select(by, F.col("item").withField("p", last).alias("item")))


def _numbered(sources: DataFrame, tables: Tables) -> DataFrame:
    """Adds ``no``, the place of each source in code point order from 0, null last."""
    ranges = int(sources.count() // SOURCES_PER_RANGE + 1)
    placed = tables.write("ranged", sources.repartitionByRange(ranges, F.asc_nulls_last("source"))
                          .withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (placed.join(F.broadcast(before), "range").withColumn("no", F.row_number().over(order) - 1 + F.col("before"))
            .drop("range", "before"))


def source_targets(sources: DataFrame, tables: Tables, weights=WEIGHTS, most=MOST, share=1.0) -> DataFrame:
    """Adds no, weight and target to rows (source, source_size).

    Targets follow the weights, stop at ``most`` times the source's size, and what is cut off goes to the others by
    weight until none is above: one aggregate of the sources each time.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = tables.write("targets", _numbered(sources, tables).withColumn("weight", weight).withColumn("cap", cap))
    tables.drop("ranged")
    want, rate = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share, 0.0
    while True:
        above = F.col("cap") <= F.lit(rate) * F.col("weight")
        row = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cut"),
                         F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break  # every source is at its limit
        higher = (want - row["cut"]) / row["free"]
        if higher <= rate:
            break
        rate = higher
    return ranked.withColumn("target", F.least("cap", F.lit(rate) * F.col("weight"))).drop("cap")


def plan_mix(documents: DataFrame, tables: Tables, id="doc_id", text="text", source="source", weights=WEIGHTS, most=MOST, share=1.0,
             seed="mix") -> DataFrame:
    """One row per distinct (id, tid, source): size, n_same rows that have it, source_size, target and copies of each row.

    ``tid`` is a hash of the text (null if that is null).
    """
    content = F.col(text)
    rows = documents.select(F.col(id).alias("id"), F.when(content.isNotNull(), F.xxhash64(content)).alias("tid"),
                            F.col(source).cast("string").alias("source"), word_count(content).alias("size"))
    items = tables.write("items", rows.groupBy("id", "tid", "source").agg(F.count(F.lit(1)).alias("n_same"), F.max("size").alias("size")))
    sources = items.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_same") * F.col("size")).alias("source_size"))
    targets = tables.write("sources", source_targets(tables.write("sizes", sources), tables, weights, most, share))
    ratio = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    placed = attach(items, targets.withColumn("ratio", F.coalesce(ratio, F.lit(0.0))), ["source"]).withColumn("certain", F.floor("ratio"))
    placed = tables.write("placed", placed.select("no", F.col("n_rows").alias("n"), F.struct(
        F.xxhash64("id", "tid").alias("h"), "id", "tid", "size", "n_same", "certain",
        (F.col("size") * F.col("n_same")).cast("double").alias("s"), (F.col("ratio") - F.col("certain")).alias("p")).alias("item")))
    tables.drop("items", "sizes", "targets")
    open_ = (F.col("item.p") > 0) & (F.col("item.s") > 0)
    decided = round_copies(placed.filter(open_), tables, "no", seed).unionByName(
        placed.filter(~open_).select("no", F.col("item").withField("p", F.lit(0.0)).alias("item")))
    copies = (F.col("item.certain") + F.col("item.p")).cast("long")
    chosen = decided.select("no", "item.id", "item.tid", "item.size", "item.n_same", F.when(F.col("item.size") > 0, copies).otherwise(0).alias("copies"))
    chosen = tables.write("chosen", chosen)
    tables.drop("placed", *[n for n in tables.paths if n.startswith("level")])
    return attach(chosen, targets.select("no", "source", "source_size", "target", "n_rows"), ["no"]).drop("no", "n_rows")


def each_row(plan: DataFrame) -> DataFrame:
    """The plan with ``n_same`` rows for each document, in arrays of at most ``ROWS_AT_ONCE``."""
    some = plan.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("n_same") - 1, F.lit(ROWS_AT_ONCE))))
    here = F.least(F.col("n_same") - F.col("_at"), F.lit(ROWS_AT_ONCE))
    return some.withColumn("_row", F.explode(F.sequence(F.lit(1), here))).drop("_at", "_row", "n_same")


def mixed(documents: DataFrame, plan: DataFrame, id="doc_id", text="text", source="source") -> DataFrame:
    """The mix itself: every document as often as the plan says."""
    content = F.col(f"`{text}`")
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id}`").alias("id"),
                             F.when(content.isNotNull(), F.xxhash64(content)).alias("tid"), F.col(f"`{source}`").cast("string").alias("source"))
    taken = null_safe_join(keyed, plan.select("id", "tid", "source", "copies").filter("copies > 0"), ["id", "tid", "source"], "inner")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op12_source_mixing(spark, sf_dir):
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "op12"))
    return each_row(plan).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                 (F.col("size") * F.col("copies")).alias("taken"))
