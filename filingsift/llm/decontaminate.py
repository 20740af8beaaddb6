"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of training documents inside one task. Its words become an FM-index: a suffix
array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix whose prefix counts answer
rank queries, and sampled suffix positions. Every test phrase (a window of consecutive benchmark words)
is searched backwards in it, all phrases at a time; the occurrences are located by walking to the nearest
sampled position, and their spans are merged per document.

Only text that can belong to an occurrence is indexed: a run of consecutive words of one document that
all occur in the benchmark and that is as long as the shortest phrase. That loses nothing, since a phrase
has no other words, and keeps the index far smaller than the shard.

The benchmark reaches the tasks as broadcast blocks of at most ``PHRASE_BYTES`` of text; a task holds one
block at a time, so a benchmark of any size is searched with the same memory.

Defined results: a null or empty text has no words and no hits and is kept; a benchmark item without words is
never found; a null item id counts as the empty string; repeated rows are judged one by one; an empty
benchmark finds nothing; other columns of either table play no part.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filingsift.llm import words as W
from filingsift.llm.tables import packed, unpacked

WINDOW = 13
PHRASE_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
SAMPLING = 8


class Phrases:
    """The distinct windows of a block of benchmark items, with the items each belongs to."""

    def __init__(self, ids, texts, window=WINDOW):
        self.items = sorted(set(ids))
        number = {item: i for i, item in enumerate(self.items)}
        data, offsets = W.text_buffer(pa.array(texts, pa.large_string()))
        _, _, hashes, first = W.split_words(data, offsets, W.ALNUM_LOWER)
        self.vocabulary, coded = np.unique(hashes, return_inverse=True)
        found = {}
        for i, item in enumerate(ids):
            word = coded[first[i]:first[i + 1]]
            size = min(window, len(word))
            for at in range(len(word) - size + 1 if size else 0):
                found.setdefault(word[at:at + size].tobytes(), set()).add(number[item])
        by_size = {}
        for key, owners in found.items():
            by_size.setdefault(len(key) // coded.itemsize, []).append((key, sorted(owners)))
        self.groups = []
        for size, entries in sorted(by_size.items()):
            codes = np.frombuffer(b"".join(k for k, _ in entries), coded.dtype).reshape(-1, size)
            counts = np.array([len(o) for _, o in entries])
            self.groups.append((size, codes, np.concatenate([[0], np.cumsum(counts)]),
                                np.concatenate([np.array(o) for _, o in entries])))
        self.shortest = self.groups[0][0] if self.groups else 0

    def codes(self, hashes):
        """Position of each word in the vocabulary, -1 for words outside it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def suffix_order(symbols):
    """Order of all suffixes by prefix doubling; stops once all ranks differ."""
    _, rank = np.unique(symbols, return_inverse=True)
    n, step = len(symbols), 1
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, symbols, largest):
        self.levels = []
        symbols = symbols.copy()
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol, at):
        """Where the prefix of length ``at`` ends in the block of ``symbol`` on the last level."""
        for shift, ones, zeros in self.levels:
            up = ones[at]
            at = np.where((symbol >> shift) & 1 == 1, zeros + up, at - up)
        return at

    def access(self, at):
        """The symbol at each position, and that position's place on the last level."""
        symbol = np.zeros(len(at), np.int64)
        for shift, ones, zeros in self.levels:
            up = ones[at]
            bit = ones[at + 1] - up
            symbol |= bit.astype(np.int64) << shift
            at = np.where(bit == 1, zeros + up, at - up)
        return symbol, at


class FmIndex:
    """Backward search and location over runs of words; no occurrence spans two runs.

    ``codes`` are the words of all runs, ``starts`` the position of each run's first word.
    """

    def __init__(self, codes, starts, size):
        runs = len(starts)
        shift = np.repeat(np.arange(runs), np.diff(np.append(starts, len(codes))))
        n = len(codes) + runs
        text = np.empty(n, np.int64)
        self.place = np.full(n, -1)  # position among the given words
        at = np.arange(len(codes)) + shift
        text[at] = codes + runs
        self.place[at] = np.arange(len(codes))
        ends = np.append(starts[1:], len(codes)) + np.arange(runs)
        text[ends] = np.arange(runs)  # a different end mark for each run
        order = suffix_order(text)
        symbols = np.where(text >= runs, text - runs + 1, 0)
        begins = np.zeros(n, bool)
        begins[starts + np.arange(runs)] = True
        before = symbols[order - 1]
        before[begins[order]] = 0
        self.tree = WaveletMatrix(before, size)
        counts = np.bincount(symbols, minlength=size + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:size + 2]
        self.base = self.tree.follow(np.arange(size + 1), np.zeros(size + 1, np.int64))
        self.sampled = (order % SAMPLING == 0) | begins[order]
        self.position = np.where(self.sampled, order, -1)
        self.n = n

    def step(self, symbol, at):
        return self.first[symbol] + self.tree.follow(symbol, at) - self.base[symbol]

    def search(self, phrases):
        """Row interval of each phrase (a matrix of codes, one phrase per row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j] + 1
            low[live] = self.step(symbol, low[live])
            high[live] = self.step(symbol, high[live])
            live = live[low[live] < high[live]]
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows):
        """The position among the given words at which each row's suffix starts."""
        out, steps = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows[live]]
            hit = live[done]
            out[hit] = self.position[rows[hit]] + steps[hit]
            live = live[~done]
            symbol, at = self.tree.access(rows[live])
            rows[live] = self.first[symbol] + at - self.base[symbol]
            steps[live] += 1
        return self.place[out]


def find(hashes, first, phrases):
    """Occurrences of all phrases in one shard: start word, length, and (text, item) pairs."""
    nothing = np.zeros(0, np.int64)
    codes = phrases.codes(hashes)
    own = W.owners(first)
    known = codes >= 0
    if not phrases.shortest or not known.any():
        return nothing, nothing, nothing, nothing
    breaks = np.ones(len(codes), bool)  # a run starts here
    breaks[1:] = ~known[:-1] | (own[1:] != own[:-1])
    begin = np.flatnonzero(known & breaks)
    stop = np.ones(len(codes), bool)
    stop[:-1] = ~known[1:] | (own[1:] != own[:-1])
    size = np.flatnonzero(known & stop) + 1 - begin
    long = size >= phrases.shortest
    begin, size = begin[long], size[long]
    if not len(begin):
        return nothing, nothing, nothing, nothing
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    where = np.arange(size.sum()) + np.repeat(begin - starts, size)
    index = FmIndex(codes[where], starts, len(phrases.vocabulary))
    at, lengths, texts, items = [], [], [], []
    for length, windows, spans, owners in phrases.groups:
        low, high = index.search(windows)
        count = high - low
        window = np.repeat(np.arange(len(windows)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[window]
        place = where[index.locate(rows)]
        at.append(place)
        lengths.append(np.full(len(place), length))
        many = spans[window + 1] - spans[window]
        texts.append(np.repeat(own[place], many))
        pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(spans[window], many)
        items.append(owners[pick])
    return tuple(np.concatenate(x) for x in (at, lengths, texts, items))


def _scan(blocks):
    """mapInArrow function: adds hit spans (byte positions in the text) and found items to (row..., text)."""
    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, "text", SHARD_BYTES):
                data, offsets = W.text_buffer(batch.column("text"))
                begins, ends, hashes, first = W.split_words(data, offsets, W.ALNUM_LOWER)
                cover = np.zeros(len(hashes) + 1, np.int64)
                names = [set() for _ in range(batch.num_rows)]
                for block in blocks:
                    phrases = block.value
                    at, size, text, item = find(hashes, first, phrases)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    for t, i in set(zip(text.tolist(), item.tolist())):
                        names[t].add(phrases.items[i])
                    if len(blocks) > 1 and hasattr(block, "_value"):
                        del block._value  # one block in memory at a time
                hit = np.cumsum(cover)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])[first]
                own = W.owners(first)
                edge = np.ones(len(hit), bool)
                edge[1:] = ~hit[:-1] | (own[1:] != own[:-1])
                last = np.ones(len(hit), bool)
                last[:-1] = ~hit[1:] | (own[1:] != own[:-1])
                left, right = np.flatnonzero(hit & edge), np.flatnonzero(hit & last)
                of = own[left]
                span = np.empty(2 * len(left), np.int64)
                span[0::2], span[1::2] = begins[left] - offsets[of], ends[right] - offsets[of]
                cut = 2 * np.searchsorted(of, np.arange(batch.num_rows + 1))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(span))
                items = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total), pa.int64()), spans, items],
                    [*batch.schema.names, "n_words", "n_hit", "hit_spans", "hit_items"])
    return run


def phrase_blocks(benchmark, item="item_id", text="text", window=WINDOW, limit=PHRASE_BYTES):
    """The benchmark as broadcast blocks of at most ``limit`` bytes of text (an item is never cut)."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text), F.lit("")).alias("t"))
    blocks, ids, texts, size = [], [], [], 0
    for row in rows.toLocalIterator():
        if ids and size + len(row.t) > limit:
            blocks.append(sc.broadcast(Phrases(ids, texts, window)))
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    return [*blocks, sc.broadcast(Phrases(ids, texts, window))]


def scan(documents: DataFrame, benchmark: DataFrame, carry=("doc_id",), text="text", item="item_id",
         benchmark_text="text", window=WINDOW) -> DataFrame:
    """Each document's columns ``carry`` and ``text`` with n_words, n_hit, hit_spans and hit_items.

    ``hit_spans`` holds merged (first byte, byte after the last) pairs of the UTF-8 text, flat and ascending.
    """
    rows = documents.select(*[F.col(c) for c in carry if c != text], F.col(text).alias("text"))
    blocks = phrase_blocks(benchmark, item, benchmark_text, window)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_scan(blocks), f"{fields}, n_words long, n_hit long, hit_spans array<long>, hit_items array<string>")


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_hits():
    """The text without its hit spans: the bytes between them, which begin and end at characters."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("hit_spans"), F.array(F.octet_length("text").cast("long")))
    raw = F.encode("text", "UTF-8")

    def part(i):
        a, b = F.get(edges, (2 * i).cast("int")), F.get(edges, (2 * i + 1).cast("int"))
        return F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    parts = F.transform(F.sequence(F.lit(0), (F.size("hit_spans") / 2).cast("int")), part)
    return F.when(F.size("hit_spans") > 0, F.array_join(parts, "")).otherwise(F.col("text"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text="text") -> DataFrame:
    """Documents without the contaminated ones, and with the remaining hits cut from the others' texts."""
    kept = scan(packed(documents, text), benchmark, ["row"]).filter(~is_contaminated())
    return unpacked(kept.withColumn("text", without_hits()), documents.columns, text)


def op3_benchmark_decontamination(spark, sf_dir):
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        is_contaminated().alias("contaminated"))


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP3_SQL = f"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w
  from documents),
b as (select coalesce(cast(item_id as varchar), '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w
  from benchmark),
p as (select distinct item, len(w[i:i + {WINDOW - 1}]) as size, array_to_string(w[i:i + {WINDOW - 1}], ' ') as phrase
  from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) as i from b where len(w) > 0)),
s as (select distinct size from p),
g as (select r, i, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, s where len(w) >= size)),
o as (select g.r, g.i, g.size, p.item from g join p using (size, phrase)),
h as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + size)) as j from o) group by r),
t as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from o group by r)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join h on d.r = h.r left join t on d.r = t.r
"""
