"""Cross-tokenizer alignment: which tokens of two tokenizers belong together, and how often corpus-wide.

Both tokenizers cut the same bytes. A matrix (tokens x bytes) has a 1 where a token covers a byte; the product
A . B^T of two such incidence matrices has an entry for each pair of tokens that overlap, the number of bytes they
share. With the last byte of each token alone, the product links the tokens that end together. Bytes where both
end cut the text into groups; (tokens x groups) incidence gives the pairs that share a group. Matrices are compressed
sparse rows, and products are taken row by row (Gustavson): row i of the product is the sum of the rows of B^T that
row i of A names.

Neither tokenizer joins a character to a following space, so a text falls apart before each run of spaces that stands
between two other characters, and both end a token there. Such units repeat all the time: each distinct unit of a block of
texts is encoded and aligned once, as a diagonal block of one large matrix, and a document is a row of unit numbers.

1. One pass over the texts writes, per document, the counts, the digest of its groups and its distinct links.
2. Links are summed corpus-wide by pair of ids, and each pair learns whether it is the most frequent of its B id.
3. A pair with more than 1 in ``HOT_PAIRS`` of all links is broadcast (there are at most ``HOT_PAIRS`` of them) and looked up
   where the documents are; the links of the other pairs are shuffled to their counts and summed by document.

Defined results: a text that is null or empty, or whose tokens do not spell a space and the text (a space mark of B
inside the text, say), has no tokens: zeros and an empty digest; special tokens' strings are plain text; a null id
keeps its row; repeated rows count as often as they come; an empty table gives an empty result; other columns
play no part.
"""
import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filingsift.llm import words as W
from filingsift.llm.tables import Tables

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
JOINED = 512
HOT_PAIRS = 1 << 18
PAIRS_AT_ONCE = 1 << 16
WIDTH = 1 << 32
MARK = "▁"


class Csr:
    """A sparse matrix in compressed rows."""

    def __init__(self, indptr, indices, data, columns):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    @classmethod
    def of(cls, rows, indices, n_rows, columns):
        """Ones at (row, index); rows ascend."""
        indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
        return cls(indptr, np.asarray(indices, np.int64), np.ones(len(indices), np.int64), columns)

    def transposed(self):
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)

    def times(self, other):
        """Row-wise product: for each entry (i, k) here, row k of ``other`` scaled, summed into row i."""
        size = np.diff(other.indptr)[self.indices]
        begin = np.repeat(np.cumsum(size) - size, size)
        source = np.repeat(other.indptr[self.indices], size) + np.arange(len(begin)) - begin
        row = np.repeat(np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), size)
        column, value = other.indices[source], np.repeat(self.data, size) * other.data[source]
        order = np.lexsort((column, row))
        row, column, value = row[order], column[order], value[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        at = np.flatnonzero(fresh)
        summed = np.add.reduceat(value, at) if len(at) else value
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(self.indptr) - 1))])
        return Csr(indptr, column[at], summed, other.columns)

    def entries(self):
        """(row, column, value) of all entries."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr)), self.indices, self.data


def _spans(lengths):
    """(token, byte) of every byte that a token covers."""
    token = np.repeat(np.arange(len(lengths)), lengths)
    return token, np.arange(len(token))


KINDS = ("overlap", "ends", "group")


def align(lengths_a, lengths_b, kinds=KINDS):
    """Links of two token sequences over the same bytes, given their tokens' byte lengths (all positive).

    Returns a dict of matrices (A tokens x B tokens): ``overlap`` (bytes shared), ``ends`` (1 where both end) and ``group``
    (1 where both are in one group), and the group of each A token and of each B token.
    """
    n, na, nb = int(np.sum(lengths_a)), len(lengths_a), len(lengths_b)
    end_a, end_b = np.cumsum(lengths_a) - 1, np.cumsum(lengths_b) - 1
    ends = Csr.of(np.arange(na), end_a, na, n).times(Csr.of(np.arange(nb), end_b, nb, n).transposed())
    cut = np.zeros(n + 1, np.int64)
    cut[end_a[ends.entries()[0]] + 1] = 1
    group = np.cumsum(cut)  # of each byte
    in_a, in_b = group[end_a], group[end_b]
    found = {"ends": ends}
    if "overlap" in kinds:
        a, b = (Csr.of(*_spans(x), len(x), n) for x in (lengths_a, lengths_b))
        found["overlap"] = a.times(b.transposed())
    if "group" in kinds:
        found["group"] = Csr.of(np.arange(na), in_a, na, n + 1).times(Csr.of(np.arange(nb), in_b, nb, n + 1).transposed())
    return found, in_a, in_b


def byte_alphabet():
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Pair:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a=BYTE_BPE, path_b=PIECE_BPE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in self.a.id_to_token(i) or "")
                        for i in range(self.a.get_vocab_size())]
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        if any(b" " in piece.lstrip(b" ") for piece in self.bytes_b):
            raise ValueError("a piece goes on after a word: texts cannot be cut before spaces")
        self.sizes = [np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b)]
        self.flat = [np.frombuffer(b"".join(of), np.uint8) for of in (self.bytes_a, self.bytes_b)]
        self.starts = [np.cumsum(x) - x for x in self.sizes]
        self.digits = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def encode(self, texts):
        """Ids by A and by B of texts that each begin with the space that B adds itself."""
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def spell(self, side, ids):
        """The bytes of tokens, one after the other."""
        size = self.sizes[side][ids]
        begin = np.cumsum(size) - size
        return self.flat[side][np.repeat(self.starts[side][ids] - begin, size) + np.arange(size.sum())]

    def encode_units(self, data, bounds, joined):
        """(ids, tokens in each unit) by A and by B; none for a unit that its tokens do not spell.

        The first ``joined`` units can follow each other in a text and are encoded ``JOINED`` at a time.
        """
        n = len(bounds) - 1
        cuts = [*range(0, joined, JOINED), *range(joined, n), n]
        while True:
            texts = [data[bounds[i]:bounds[j]] for i, j in zip(cuts, cuts[1:])]
            found, again = ([], []), []
            for i, j, text, *ids in zip(cuts, cuts[1:], texts, *self.encode([t.tobytes().decode() for t in texts])):
                ends = [np.cumsum(self.sizes[side][x]) for side, x in enumerate(ids)]
                want = bounds[i + 1:j + 1] - bounds[i]
                place = [np.searchsorted(e, want) for e in ends]
                good = all(len(e) and e[-1] == len(text) and (e[p] == want).all() and (self.spell(side, x) == text).all()
                           for side, (e, p, x) in enumerate(zip(ends, place, ids)))
                if not good and j - i > 1:
                    again.append((i, j))
                for side, (x, p) in enumerate(zip(ids, place)):
                    found[side].append((x, np.diff(p + 1, prepend=0)) if good else (x[:0], np.zeros(j - i, np.int64)))
            if not again:
                return [[np.concatenate(x) for x in zip(*of)] if of else (np.zeros(0, np.int64),) * 2 for of in found]
            cuts = sorted({*cuts, *(k for i, j in again for k in range(i, j))})


@functools.lru_cache(maxsize=1)
def pair(path_a=BYTE_BPE, path_b=PIECE_BPE):
    return Pair(path_a, path_b)


def _solid(last, last2):
    """Whether a character that ends in these two bytes is known to be no white space of any kind."""
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (last2 >= 0xC3) & (last2 <= 0xDF))


def unit_starts(data, offsets):
    """Where units begin in texts that each have a space in front.

    A unit begins with each text, and at a space that follows a printable ASCII character or one of two bytes from
    U+00C0 on (so no kind of white space) and is not among the spaces that end a text.
    """
    n = len(data)
    space = data == 0x20
    before, before2 = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], before2[2:] = data[:-1], data[:-2]
    place = np.flatnonzero(space & _solid(before, before2))
    solid = np.append(np.flatnonzero(~space), n)  # the next character that is no space must lie in the same text
    following = solid[np.searchsorted(solid, place)]
    place = place[following < offsets[1:][np.searchsorted(offsets, place, "right") - 1]]
    return np.union1d(place, offsets[:-1])


class Units:
    """What is known of each distinct unit of a block: token counts, groups as text, links as pair numbers.

    ``spelled`` is an Arrow array of the distinct units; numbers of units are places in it.
    """

    def __init__(self, tokenizers, spelled):
        n = len(spelled)
        data, bounds = self._buffers(spelled)
        before = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(np.searchsorted(bounds, np.flatnonzero(data != 0x20), "right") - 1, minlength=n), out=before[1:])
        last, last2 = data[bounds[1:] - 1], data[np.maximum(bounds[1:] - 2, 0)]
        joins = (np.diff(before) > 0) & _solid(last, last2) & (np.diff(bounds) > 1)
        joins[np.searchsorted(bounds, np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)), "right") - 1] = False
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        (a, self.n_a), (b, self.n_b) = tokenizers.encode_units(*self._buffers(spelled.take(pa.array(order))), int(joins.sum()))
        found, in_a, in_b = align(tokenizers.sizes[0][a], tokenizers.sizes[1][b], ("ends",))
        row, column, _ = found["ends"].entries()
        unit_a, unit_b = (np.repeat(np.arange(n), x) for x in (self.n_a, self.n_b))
        self.links = a[row] * WIDTH + b[column]
        self.n_links = np.bincount(unit_a[row], minlength=n)
        # a token is written with what follows it: more of its side, the other side, or the next group
        group, side = np.concatenate([in_a, in_b]), np.repeat([0, 1], [len(a), len(b)])
        written = np.lexsort((side, group))
        group, side, ids = group[written], side[written], np.concatenate([a, b])[written]
        ends = np.ones(len(ids), bool)
        ends[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        mark = np.where(ends, np.where(side == 0, 1, 2), 0).tolist()
        digits, marks = tokenizers.digits, (b",", b"|", b";")
        parts = [digits[i] + marks[m] for i, m in zip(ids.tolist(), mark)]
        cut = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        self.groups = [b"".join(parts[i:j]) for i, j in zip(cut, cut[1:])]
        fresh = np.ones(len(in_a), bool)
        fresh[1:] = in_a[1:] != in_a[:-1]
        self.n_groups = np.bincount(unit_a[fresh], minlength=n)
        self.good = self.n_a > 0
        self.first_link = np.cumsum(self.n_links) - self.n_links
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)

    @staticmethod
    def _buffers(spelled):
        _, bounds, data = spelled.buffers()
        bounds = np.frombuffer(bounds, np.int64)[spelled.offset:spelled.offset + len(spelled) + 1]
        return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.zeros(0, np.uint8), bounds - bounds[0]


def _prefixed(batch):
    """(bytes, offsets) of the texts with a space in front of each."""
    data, offsets = W.text_buffer(batch.column("text"))
    count = len(offsets) - 1
    out = np.full(len(data) + count, 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1] + np.arange(count)] = False
    out[keep] = data
    return out, offsets + np.arange(count + 1)


def _code(path_a, path_b):
    def run(batches):
        tokenizers = pair(path_a, path_b)
        for whole in batches:
            for batch in W.pieces(whole, "text", W.TEXTS // 2):
                data, offsets = _prefixed(batch)
                starts = unit_starts(data, offsets)
                n, first = batch.num_rows, np.searchsorted(starts, offsets)
                bounds = np.append(starts, len(data))
                spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
                coded = spelled.dictionary_encode()
                units = Units(tokenizers, coded.dictionary)
                number = units.place[coded.indices.to_numpy()]
                own = np.repeat(np.arange(n), np.diff(first))
                total = lambda values: np.bincount(own, values[number], n).astype(np.int64)
                whole_text = (total(units.good) == np.diff(first)) & (np.diff(offsets) > 1)
                used = number[whole_text[own]]
                sizes = units.n_links[used]
                begin = np.cumsum(sizes) - sizes
                links = units.links[np.repeat(units.first_link[used] - begin, sizes) + np.arange(sizes.sum())]
                of = np.repeat(own[whole_text[own]], sizes)
                order = np.lexsort((links, of))
                links, of = links[order], of[order]
                fresh = np.ones(len(of), bool)
                fresh[1:] = (links[1:] != links[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(fresh)
                times = np.diff(np.append(at, len(of)))
                cut = pa.array(np.searchsorted(of[at], np.arange(n + 1)), pa.int32())
                place, digests = number.tolist(), []
                for ok, i, j in zip(whole_text.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    digests.append(hashlib.sha256(b"".join([units.groups[u] for u in place[i:j]])[:-1]).hexdigest() if ok else "")
                columns = [pa.array(total(x) * whole_text) for x in (units.n_a, units.n_b, units.n_groups)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *columns, pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(cut, pa.array(links[at])), pa.ListArray.from_arrays(cut, pa.array(times))],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return run


def _sums(batches):
    """Links summed by pair over as many batches as ``PAIRS_AT_ONCE`` pairs allow."""
    held, n = [], 0

    def summed():
        pairs, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([y for _, y in held]), len(pairs)).astype(np.int64)
    for batch in batches:
        held.append([batch.column(c).flatten().to_numpy() for c in ("pairs", "times")])
        n += len(held[-1][0])
        if n > 16 * PAIRS_AT_ONCE:
            held = [summed()]
            n = len(held[0][0])
            if n > PAIRS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])


def _added(rows, values, n):
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, values)
    return out


def _look_up(hot):
    """Add up the hot pairs of each document; what is left are its cold ones."""
    def run(batches):
        pairs, counts, best = hot.value
        for batch in batches:
            lists = batch.column("pairs")
            values, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            n = batch.num_rows
            of = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            at = np.searchsorted(pairs, values)
            found = np.append(pairs, -1)[at] == values
            here, times_here, of_here = at[found], times[found], of[found]
            cut = pa.array(np.searchsorted(of[~found], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _DOCUMENT), pa.array(_added(of_here, times_here * best[here], n)),
                 pa.array(_added(of_here, times_here * counts[here], n)),
                 pa.ListArray.from_arrays(cut, pa.array(values[~found])), pa.ListArray.from_arrays(cut, pa.array(times[~found]))],
                [*_DOCUMENT, "n_best", "count_sum", "pairs", "times"])
    return run


_DOCUMENT = ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def link_counts(coded: DataFrame) -> DataFrame:
    """(pair, n, best): links by pair of ids (A's times ``WIDTH`` plus B's), and whether no pair of the B id has more."""
    counts = coded.select("pairs", "times").mapInArrow(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own_b = Window.partitionBy(F.pmod("pair", F.lit(WIDTH)))  # at most one row per A id
    return counts.withColumn("best", F.col("n") == F.max("n").over(own_b))


def align_documents(documents: DataFrame, tables: Tables, id="doc_id", text="text", path_a=BYTE_BPE, path_b=PIECE_BPE):
    """(documents, links): rows of id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum, and the table of
    :func:`link_counts`."""
    coded = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _code(path_a, path_b), f"id long, {_COUNTS}, pairs array<long>, times array<long>")
    coded = tables.write("coded", coded.withColumn("row", F.monotonically_increasing_id()))
    links = tables.write("links", link_counts(coded))
    total = links.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_PAIRS > F.lit(total)
    hot = links.filter(is_hot).orderBy("pair").toPandas()  # at most HOT_PAIRS rows
    hot = coded.sparkSession.sparkContext.broadcast(
        (hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool).astype(np.int64)))
    met = tables.write("met", coded.mapInArrow(
        _look_up(hot), f"row long, id long, {_COUNTS}, n_best long, count_sum long, pairs array<long>, times array<long>"))
    tables.drop("coded")
    rest = met.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    rest = (rest.join(links.filter(~is_hot), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    added = met.drop("pairs", "times").join(rest, "row", "left")
    return added.select(*_DOCUMENT[1:], *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
                                          for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]), links


def token_links(documents: DataFrame, id="doc_id", text="text", kind="overlap", path_a=BYTE_BPE, path_b=PIECE_BPE) -> DataFrame:
    """The links themselves: (id, a_place, b_place, a_id, b_id, value), ``kind`` one of ``overlap``, ``ends`` and ``group``."""
    def run(batches):
        tokenizers = pair(path_a, path_b)
        for whole in batches:
            for i in range(whole.num_rows):
                text_here = " " + (whole.column("text")[i].as_py() or "")
                (a,), (b,) = tokenizers.encode([text_here])
                if len(text_here) == 1 or any(tokenizers.spell(side, x).tobytes() != text_here.encode() for side, x in enumerate((a, b))):
                    continue
                matrices, _, _ = align(tokenizers.sizes[0][a], tokenizers.sizes[1][b], (kind,))
                row, column, value = matrices[kind].entries()
                yield pa.RecordBatch.from_arrays(
                    [whole.column("id").take(pa.array(np.full(len(row), i))), pa.array(row), pa.array(column),
                     pa.array(a[row]), pa.array(b[column]), pa.array(value)],
                    ["id", "a_place", "b_place", "a_id", "b_id", "value"])
    return documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, a_place long, b_place long, a_id long, b_id long, value long")


def op13_token_alignment(spark, sf_dir):
    found, _ = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "op13"))
    return found.withColumnRenamed("id", "doc_id")
