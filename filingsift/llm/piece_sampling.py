"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that spells a run of its characters, and for a
character that is no piece the edge of its byte pieces. A segmentation's weight is the product of its pieces'
probabilities to the power ``sharpness``. Forward filtering sums the weights of all ways to reach a position;
backward sampling then draws a segmentation from the exact distribution, piece by piece from the end. The
random numbers are hashes of seed, row key and position, so a row's sample does not depend on its task.

The vocabulary file is a byte-fallback BPE model. It is not trained here and has merge ranks in place of
probabilities, so a piece's probability follows Zipf's law in its rank.

No piece has a space after another character, so the lattice falls apart before each run of spaces. Filtering
runs once per distinct part of a block of texts, one position of all parts at a time; sampling runs over all
parts' occurrences at once.

Decoding is lossless: spaces travel as the space mark, a space mark in the text as its bytes.

Defined results: a null or empty text has no pieces and decodes to an empty text; a null row key counts as an
empty one; repeated rows get the same sample; other columns pass through, results replace clashing names.
"""
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from filingsift.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 0.5
SEED = 20
BLOCK_BYTES = 1 << 21
PART_CHARS = 1 << 17  # characters whose lattices are in memory at a time (or one longer part)
_MARK = 0x2581  # stands for a space in the pieces
_LITERAL = 0x110000  # a space mark in the text itself
_ZIPF = 2.7
_BASE = 0x9E3779B97F4A7C15
_MASK = np.uint64((1 << 20) - 1)


class Vocabulary:
    """Pieces of a SentencePiece model: their characters, bytes and log probabilities."""

    def __init__(self, path=MODEL):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled, self.bytes, byte_ids = {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                spelled[piece] = i
                self.bytes.append(piece.replace(chr(_MARK), " ").encode())
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.longest = max(map(len, spelled))
        order = sorted(spelled, key=spelled.get)
        weight = 1 / (np.arange(1, len(order) + 2) + _ZIPF)
        weight = np.log(weight / weight.sum())
        self.log = np.zeros(len(self.bytes))
        for rank, piece in enumerate(order):
            self.log[spelled[piece]] = weight[rank]
        self.log[self.byte_ids] = weight[-1]
        points = np.array([ord(c) for piece in order for c in piece], np.uint64)
        ends = np.cumsum([len(piece) for piece in order])
        starts = ends - [len(piece) for piece in order]
        hashes = _run_hashes(points, starts, ends - starts)
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], np.array([spelled[piece] for piece in order], np.int32)[by]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.mask = np.zeros(int(_MASK) + 1, bool)  # most runs are no piece, and most of those end here
        self.mask[self.hashes & _MASK] = True
        self.size = np.array([len(b) for b in self.bytes])
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def lookup(self, hashes):
        """Piece of each run of characters, -2 where it is none."""
        out = np.full(len(hashes), -2, np.int32)
        maybe = np.flatnonzero(self.mask[hashes & _MASK])
        found = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == found, self.ids[at], -2)
        return out


@functools.lru_cache(2)
def vocabulary(path=MODEL):
    return Vocabulary(path)


def _sums(points):
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * W.powers(_BASE, len(points)))])


def _run_hashes(points, starts, sizes, sums=None):
    sums = _sums(points) if sums is None else sums
    down = W.powers(pow(_BASE, -1, 1 << 64), len(points) + 1)[starts]
    return W.mix((sums[starts + sizes] - sums[starts]) * down + np.asarray(sizes).astype(np.uint64))


class Lattice:
    """The lattices of distinct parts, laid out one after another.

    ``way[p, l-1]`` is the probability that the last piece of a sample that ends after character p has at most
    l characters; ``piece[p, l-1]`` is that piece, -1 for the bytes of one character.
    """

    def __init__(self, points, starts, ends, vocab, sharpness):
        n, widest = len(points), min(vocab.longest, int((ends - starts).max(initial=1)))
        self.piece = np.full((n, widest), -2, np.int32)
        since = np.arange(n) - np.repeat(starts, ends - starts)  # characters of the part before each one
        sums, last = _sums(points), np.arange(n)
        for size in range(1, widest + 1):
            last = last[since[last] >= size - 1]
            self.piece[last, size - 1] = vocab.lookup(_run_hashes(points, last - size + 1, size, sums))
        lone = np.flatnonzero(self.piece[:, 0] < 0)  # no piece: its bytes
        self.piece[lone, 0] = -1
        weight = np.append(np.exp(sharpness * vocab.log), [0.0, 0.0])[self.piece]
        weight[lone, 0] = np.exp(sharpness * vocab.log[vocab.byte_ids[0]] * utf8_sizes(points[lone]))
        order = np.argsort(starts - ends, kind="stable")
        begin, size = starts[order], (ends - starts)[order]
        self.way = np.ones((n, widest), np.float32)
        # weights of all ways to the last positions of every part, the newest first, relative to the newest
        reach = np.zeros((len(begin), widest))
        reach[:, 0] = 1
        for j in range(int(size.max(initial=0))):
            many = int(np.searchsorted(-size, -j, "left"))  # parts that have a j-th character
            at = begin[:many] + j
            ways = np.cumsum(reach[:many] * weight[at], axis=1)
            total = ways[:, -1:]
            self.way[at] = ways / total  # exactly 1 from the last possible piece on
            reach[:many, 1:] = reach[:many, :-1] / total
            reach[:many, 0] = 1


def utf8_sizes(points):
    points = np.where(points == _LITERAL, _MARK, points)
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _uniform(keys, positions, seed):
    h = W.mix(keys + W.mix(positions.astype(np.uint64) + np.uint64(seed * _BASE % (1 << 64))))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def encode_block(texts, keys, vocab, sharpness=SHARPNESS, seed=SEED):
    """Sampled pieces of a column of texts: (ids, index of each text's first id)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    some = lengths > 0
    whole = lengths + some  # with the space mark before a text
    first = np.concatenate([[0], np.cumsum(whole)])
    own = np.repeat(np.arange(len(lengths)), whole)
    points = np.full(first[-1], _MARK, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[:-1][some]] = False
    points[inside] = np.where(raw == 0x20, np.uint64(_MARK), np.where(raw == _MARK, np.uint64(_LITERAL), raw))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(lengths) + 1, np.int64)
    space = points == _MARK
    cut = np.ones(len(points), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | (own[1:] != own[:-1])
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(points))
    one = _run_hashes(points, starts, ends - starts)
    _, pick, part = np.unique(one, return_index=True, return_inverse=True)
    size = (ends - starts)[pick]
    chosen = np.full(len(points), -2, np.int32)  # the piece that starts at a character
    group = (np.cumsum(size) - size) // PART_CHARS  # parts whose lattices are built together
    by_group = np.argsort(group[part], kind="stable")
    bounds = np.searchsorted(group[part][by_group], np.arange(group[-1] + 2))
    offset, left = np.zeros(len(starts), np.int64), ends.copy()
    for g in range(group[-1] + 1):
        parts = np.flatnonzero(group == g)
        if not len(parts):
            continue
        base = np.cumsum(size[parts]) - size[parts]
        spelled = points[np.arange(size[parts].sum()) + np.repeat(starts[pick[parts]] - base, size[parts])]
        lattice = Lattice(spelled, base, base + size[parts], vocab, sharpness)
        live = by_group[bounds[g]:bounds[g + 1]]
        offset[live] = base[part[live] - parts[0]] - starts[live]
        while len(live):
            last = left[live] - 1
            draw = _uniform(keys[own[last]], last - first[own[last]], seed)
            step = (lattice.way[last + offset[live]] <= draw[:, None]).sum(axis=1)
            left[live] = last - step
            chosen[left[live]] = lattice.piece[last + offset[live], step]
            live = live[left[live] > starts[live]]
    at = np.flatnonzero(chosen > -2)
    ids = chosen[at]
    # characters without a piece of their own become their bytes
    many = np.where(ids == -1, utf8_sizes(points[at]), 1)
    place = np.cumsum(many) - many
    out = np.repeat(ids, many)
    lone = np.flatnonzero(ids == -1)
    if len(lone):
        code = np.where(points[at[lone]] == _LITERAL, np.uint64(_MARK), points[at[lone]]).astype(np.uint32)
        spelled = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        sizes = many[lone]
        to = np.repeat(place[lone] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out[to] = vocab.byte_ids[spelled]
    count = np.bincount(own[at], weights=many, minlength=len(lengths)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(count)])


def decode_block(ids, first, vocab):
    """The text bytes of lists of pieces, and where each list's begin (one more entry)."""
    size = vocab.size[ids]
    place = np.concatenate([[0], np.cumsum(size)])
    data = vocab.data[np.arange(place[-1]) + np.repeat(vocab.first[ids] - place[:-1], size)]
    cut = place[first]
    mark = cut[:-1][np.diff(cut) > 0]  # the space mark before each text
    keep = np.ones(len(data), bool)
    keep[mark] = data[mark] != 0x20
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


def row_keys(column):
    """64-bit hashes of row keys of any type."""
    return np.array([int.from_bytes(hashlib.blake2b(("" if k is None else str(k)).encode(), digest_size=8).digest(), "little")
                     for k in column.to_pylist()], np.uint64)


def encode(documents: DataFrame, key="doc_id", text="text", model=MODEL, sharpness=SHARPNESS, seed=SEED, decoded=None) -> DataFrame:
    """Adds ``pieces``, a sampled segmentation of the text, and ``lossless``, whether decoding gives the text back.

    ``decoded`` names a further column for the text that the pieces decode to, made in the same pass.
    """
    vocab = documents.sparkSession.sparkContext.broadcast(vocabulary(model))
    names = [c for c in documents.columns if c not in ("pieces", "lossless", decoded)]
    where, by = names.index(text), names.index(key)

    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, names[where], BLOCK_BYTES):
                texts = batch.column(where)
                ids, first = encode_block(texts, row_keys(batch.column(by)), vocab.value, sharpness, seed)
                data, cut = decode_block(ids, first, vocab.value)
                plain, offsets = W.text_buffer(texts)
                same = np.diff(offsets) == np.diff(cut)
                if len(plain) == len(data) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(plain != data)])
                    same = np.diff(wrong[offsets]) == 0
                else:
                    same = [bool(s) and plain[a:b].tobytes() == data[c:d].tobytes()
                            for s, a, b, c, d in zip(same, offsets[:-1], offsets[1:], cut[:-1], cut[1:])]
                pieces = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                out = dict(zip([*names, "pieces", "lossless"], [*batch.columns, pieces, pa.array(same, pa.bool_())]))
                if decoded:
                    back = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data))
                    out[decoded] = back.cast(pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*names).schema)
    more = f", `{decoded}` string" if decoded else ""
    return documents.select(*names).mapInArrow(run, f"{fields}, pieces array<int>, lossless boolean{more}")


def decode(rows: DataFrame, pieces="pieces", text="text", model=MODEL) -> DataFrame:
    """Adds the text that the pieces spell (bytes that are no UTF-8 become replacement characters)."""
    vocab = rows.sparkSession.sparkContext.broadcast(vocabulary(model))
    names = [c for c in rows.columns if c != text]
    at = names.index(pieces)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            data, cut = decode_block(ids, np.concatenate([[0], np.cumsum(size)]), vocab.value)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names).mapInArrow(run, f"{fields}, `{text}` string")


def op5_sentencepiece(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(documents)
    return coded.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                        F.size("pieces").cast("long").alias("n_pieces"),
                        F.sha2(F.concat_ws(",", F.col("pieces").cast("array<string>")), 256).alias("pieces_sha256"), "lossless")
