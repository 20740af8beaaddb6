"""Repeated passages by suffix automata of reference shards.

A word goes if it lies in a window of ``WINDOW`` consecutive words that also starts in a document with a
smaller id. All documents are references, so plain broadcasting would stream every document past the automaton
of every shard. Instead each window is named by the smallest hash among its ``GRAM``-word runs, its anchor.
Equal windows have equal anchors, so windows whose anchor is in a single document cannot repeat, and the rest
need only meet the windows of the same anchor:

1. Count each anchor's documents, and how many different runs of its windows they have (one row per document and anchor).
2. Cut the documents into frames: the words of consecutive windows with the same shared anchor. An anchor
   with over ``HOT`` different runs, or over ``HOT_WINDOWS`` windows in them, gets a frame for each window, named
   by the window, so that no group is large. Copies of a run are one frame in a group, however many there are.
3. The distinct frames of a shard of names are its references. Their suffix automaton keeps, for each state,
   the smallest document id; streaming the frames gives matching statistics, and for each window the first
   document that has it.
4. Back at the documents, the windows that an earlier document has are merged into maximal spans and removed.

Words are compared as text; hashes only route them. Each step sends a shard's references to the task that needs
them, which takes the place of a broadcast that would grow with the corpus.

Defined results: a null or empty text has no words and keeps none; a text shorter than a window keeps all its
words; a row without id keeps all its words and removes nobody's; rows that share an id do not remove each
other's words; an empty table gives an empty result; other columns play no part.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filingsift.llm import words as W
from filingsift.llm.tables import Tables, packed, unpacked

WINDOW = 13
GRAM = 4
HOT = 2000
HOT_WINDOWS = 16 * HOT
FRAME_WINDOWS = 64
PIECE = 1 << 20
SHARD_FRAMES = 2000
COMBINED = 1 << 24
_NONE = np.iinfo(np.int64).max


def window_anchors(hashes, own):
    """(window starts, anchor of each): the smallest run hash inside each window that lies in one text."""
    size = WINDOW - GRAM + 1
    runs = W.gram_hashes(hashes, GRAM)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width = runs, 1
    while 2 * width <= size:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < size:
        least = np.minimum(least[:len(least) - (size - width)], least[size - width:])
    at = np.flatnonzero(own[:n] == own[WINDOW - 1:])
    return at, least[at]


def _anchors(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text", PIECE):
            data, offsets = W.text_buffer(batch.column("text"))
            _, _, hashes, first = W.split_words(data, offsets, W.SPACED)
            own = W.owners(first)
            at, anchor = window_anchors(hashes, own)
            own = own[at]
            change = np.ones(len(at), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            begin = np.flatnonzero(change)
            windows = np.diff(np.append(begin, len(at)))
            code = _codes(hashes, at[begin], windows)
            anchor, own = anchor[change], own[change]
            order = np.lexsort((anchor, own))
            anchor, own, windows, code = anchor[order], own[order], windows[order], code[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            pick = pa.array(own[fresh])
            if len(windows):
                begin = np.flatnonzero(fresh)
                windows, code = np.add.reduceat(windows, begin), np.add.reduceat(code, begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(pick), pa.array(anchor[fresh].view(np.int64)), pa.array(windows, pa.int32()),
                 pa.array((code >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                ["rid", "anchor", "windows", "runs"])


def _codes(hashes, word, windows):
    """A hash of the words of each run of windows, which starts at a word."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes) * W.powers(W._BASE2, len(hashes)))])
    back = W.powers(pow(W._BASE2, -1, 1 << 64), len(hashes))[word]
    return W.mix((sums[word + windows + WINDOW - 1] - sums[word]) * back + windows.astype(np.uint64))


def _spaced(data, starts, ends):
    """All words joined by single spaces, and where each word starts in that (one more entry)."""
    size = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(place[-1]) - np.repeat(place[:-1] - starts, size)
    out = data[np.minimum(source, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    out[place[1:] - 1] = 0x20
    return out.tobytes(), place


def _lists(column):
    """(values, row of each value) of an Arrow column of lists of integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(column)), lengths)


def _in_rows(values, rows, anchors, of):
    """Whether each (row, value) is among the (row, anchor) pairs."""
    if not len(anchors):
        return np.zeros(len(values), bool)
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(W.mix(values + (rows.astype(np.uint64) + np.uint64(1)) * salt),
                   W.mix(anchors + (of.astype(np.uint64) + np.uint64(1)) * salt))


def _frames(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text", PIECE):
            data, offsets = W.text_buffer(batch.column("text"))
            starts, ends, hashes, first = W.split_words(data, offsets, W.SPACED)
            own = W.owners(first)
            at, anchor = window_anchors(hashes, own)
            row = own[at]
            hot = _in_rows(anchor, row, *_lists(batch.column("hot")))
            keep = hot | _in_rows(anchor, row, *_lists(batch.column("anchors")))
            at, anchor, row, hot = at[keep], anchor[keep], row[keep], hot[keep]
            if not len(at):
                continue
            name = np.where(hot, W.gram_hashes(hashes, WINDOW)[at], anchor)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            begin = np.flatnonzero(fresh)
            since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            fresh |= since % FRAME_WINDOWS == 0
            begin = np.flatnonzero(fresh)
            windows = np.diff(np.append(begin, len(at)))
            text, place = _spaced(data, starts, ends)
            word = at[begin]
            left, right = place[word], place[word + windows + WINDOW - 1] - 1
            pieces = [text[a:b] for a, b in zip(left.tolist(), right.tolist())]
            code = _codes(hashes, word, windows)
            pick = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pick), batch.column("tid").take(pick), pa.array(word - first[row[begin]]),
                 pa.array(name[begin].view(np.int64)), pa.array(code.view(np.int64)), pa.array(pieces, pa.binary())],
                ["id", "tid", "at", "name", "code", "frame"])


class SuffixAutomaton:
    """All substrings of the added word sequences, each with the smallest owner of an occurrence."""

    def __init__(self):
        self.next, self.link, self.length, self.owner = [{}], [-1], [0], [_NONE]

    def add(self, sequence, owner):
        nxt, link, length, least = self.next, self.link, self.length, self.owner
        last = 0
        for word in sequence:
            there = nxt[last].get(word)
            if there is not None and length[there] == length[last] + 1:
                last = there
            else:
                if there is None:
                    new = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    least.append(_NONE)
                    at = last
                    while at >= 0 and word not in nxt[at]:
                        nxt[at][word] = new
                        at = link[at]
                else:
                    new, at = None, last
                if at >= 0:
                    old = nxt[at][word]
                    if length[at] + 1 != length[old]:
                        clone = len(nxt)
                        nxt.append(dict(nxt[old]))
                        length.append(length[at] + 1)
                        link.append(link[old])
                        least.append(_NONE)
                        link[old] = clone
                        while at >= 0 and nxt[at].get(word) == old:
                            nxt[at][word] = clone
                            at = link[at]
                        old = clone
                    if new is None:
                        new = old
                    else:
                        link[new] = old
                last = new
            if owner < least[last]:
                least[last] = owner

    def finish(self):
        """Owners of longer substrings also own their suffixes."""
        link, least = self.link, self.owner
        for state in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]

    def first_owners(self, sequence, window):
        """For each full window of the sequence, the smallest owner of an occurrence (``_NONE`` without one)."""
        nxt, link, length, least = self.next, self.link, self.length, self.owner
        state = matched = 0
        out = []
        for i, word in enumerate(sequence):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                while length[link[state]] >= window:  # the state that holds the last `window` words
                    state = link[state]
                matched = min(matched, length[state])
                out.append(least[state])
            elif i >= window - 1:
                out.append(_NONE)
        return out


def _combined(batches):
    """Equal frames of up to about ``COMBINED`` bytes as one row with their smallest id, before they are sent."""
    def merged(held):
        table = pa.Table.from_batches(held).group_by(["name", "code", "frame"], use_threads=False).aggregate([("id", "min")])
        return table.select(["name", "code", "frame", "id_min"]).rename_columns(["name", "code", "frame", "first"]).to_batches(4096)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COMBINED:
            yield from merged(held)
            held, size = [], 0
    if held:
        yield from merged(held)


def _match(key, frame):
    automaton, texts = SuffixAutomaton(), [f.split(b" ") for f in frame["frame"]]
    for words, owner in zip(texts, frame["first"].tolist()):
        automaton.add(words, owner)
    automaton.finish()
    return pd.DataFrame({"name": frame["name"], "code": frame["code"],
                         "firsts": [automaton.first_owners(words, WINDOW) for words in texts]})


def _finish(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text", PIECE):
            data, offsets = W.text_buffer(batch.column("text"))
            starts, ends, _, first = W.split_words(data, offsets, W.SPACED)
            at, row = _lists(batch.column("starts"))
            cover = np.zeros(len(starts) + 1, np.int64)
            begin = first[row] + at.view(np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            stay = np.flatnonzero(~gone)
            text, place = _spaced(data, starts[stay], ends[stay])
            cut = place[first - removed[first]]
            kept = [text[a:b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tid"), pa.array(np.diff(first), pa.int64()),
                 pa.array(np.diff(removed[first]), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "tid", "n_words", "n_removed", "kept"])


def remove_repeats(documents: DataFrame, tables: Tables, id="doc_id", text="text") -> DataFrame:
    """One row per document: id, tid (a hash of the text), n_words, n_removed and kept (its words left, joined by
    one space)."""
    rows = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tid"), F.col(text).alias("text"))
    # a row goes by one number here; two rows that shared it would only get each other's frames as well
    named = rows.withColumn("rid", F.xxhash64("id", "tid"))
    anchors = named.filter("id is not null").select("rid", "text").mapInArrow(_anchors, "rid long, anchor long, windows int, runs int")
    # one exchange: the documents of an anchor are counted and marked where they meet, equal ones of them once
    group = Window.partitionBy("anchor")
    counted = (anchors.withColumn("kind", F.dense_rank().over(group.orderBy("runs")))
               .select("rid", "anchor", F.count("*").over(group).alias("n"), F.max("kind").over(group).alias("kinds"),
                       F.max("windows").over(group).alias("most")).filter("n > 1"))
    is_hot = (F.col("kinds") > HOT) | (F.col("kinds") * F.col("most") > HOT_WINDOWS)
    marked = (counted.select("rid", "anchor", is_hot.alias("is_hot")).groupBy("rid")
              .agg(F.collect_set(F.when(~F.col("is_hot"), F.col("anchor"))).alias("anchors"),
                   F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot")))
    marked = tables.write("marked", marked)
    frames = tables.write("frames", named.filter("id is not null").join(marked, "rid").mapInArrow(
        _frames, "id long, tid long, at long, name long, code long, frame binary"))
    tables.drop("marked")
    shards = max(1, frames.count() // SHARD_FRAMES)
    # frames travel once: the partitioning by shard also serves the grouping by frame
    sent = (frames.select("id", "name", "code", "frame").mapInArrow(_combined, "name long, code long, frame binary, first long")
            .withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))).repartition("shard"))
    distinct = sent.groupBy("shard", "name", "code", "frame").agg(F.min("first").alias("first"))
    firsts = distinct.groupBy("shard").applyInPandas(_match, "name long, code long, firsts array<long>")
    firsts = tables.write("firsts", firsts)
    starts = F.expr("transform(filter(sequence(0, size(firsts) - 1), i -> firsts[i] < id), i -> at + i)")
    spans = (frames.select("id", "tid", "at", "name", "code").join(firsts, ["name", "code"])
             .select("id", "tid", starts.alias("starts")).filter(F.size("starts") > 0)
             .groupBy("id", "tid").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    spans = tables.write("spans", spans)
    tables.drop("frames", "firsts")
    none = F.array().cast("array<long>")
    return (rows.join(spans, ["id", "tid"], "left").withColumn("starts", F.coalesce("starts", none))
            .mapInArrow(_finish, "id long, tid long, n_words long, n_removed long, kept string"))


def without_repeats(documents: DataFrame, id="doc_id", text="text") -> DataFrame:
    """The documents with repeated passages cut from their texts; a text without any stays byte for byte."""
    tables = Tables(documents.sparkSession, "substringdedup")
    cut = (remove_repeats(documents, tables, id, text).filter("n_removed > 0")
           .select(F.col("id").alias("_cut_id"), F.col("tid").alias("_cut_tid"), F.col("kept").alias("_cut_kept")).distinct())
    rows = packed(documents, text)
    here = (F.col(f"row.`{id}`").cast("long") == F.col("_cut_id")) & (F.xxhash64("text") == F.col("_cut_tid"))
    return unpacked(rows.join(cut, here, "left").withColumn("text", F.coalesce("_cut_kept", "text")), documents.columns, text)


def op10_substring_dedup(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(documents, Tables(spark, "op10")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g
  from (select r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW})),
f as (select g, min(doc_id) as first from g group by g),
x as (select distinct r, j from (select r, unnest(range(i, i + {WINDOW})) as j from g join f using (g) where first < doc_id)),
c as (select r, list(j) as gone from x group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w
    else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: not list_contains(gone, p[2])), lambda p: p[1]) end, ' ')) as kept_sha256
from d left join c using (r)
"""
