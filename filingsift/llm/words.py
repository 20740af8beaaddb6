"""Words of whole texts as numbers, a column of texts at a time.

A task receives texts as Arrow columns. The bytes of such a column are classified through a table of
256 entries, so that finding, lower-casing and hashing the words of a few megabytes are a handful of
numpy calls and memory stays a small multiple of ``BLOCK`` (plus the longest single word).
"""
import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
TEXTS = 1 << 23
_BASE, _BASE2, _LENGTH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def byte_table(is_word, lower=True):
    """What each byte contributes to a word's hash: 0 outside words, else its (lower-cased) value plus one."""
    table = np.zeros(256, np.uint64)
    for b in range(256):
        if is_word(b):
            table[b] = (b + 32 if lower and 0x41 <= b <= 0x5A else b) + 1
    return table


def alphanumeric(b):
    """Inside ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lower-cased."""
    return 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80


def no_space(b):
    """Inside ``[^\\x20\\x09-\\x0D]``."""
    return not (b == 0x20 or 0x09 <= b <= 0x0D)


ALNUM_LOWER = byte_table(alphanumeric)
SPACED_LOWER = byte_table(no_space)
SPACED = byte_table(no_space, lower=False)


def mix(h):
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_powers = {}


def powers(base, n):
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def text_buffer(texts):
    """(bytes, offsets) of an Arrow column of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(data, offsets, table, prefixes=()):
    """All words of a column of texts, in order.

    Returns starts, ends (byte positions in ``data``), 64-bit hashes, for each length in ``prefixes`` the hashes
    of the words' first bytes (0 for shorter words), and the index of the first word of each text (one more
    entry than texts).
    """
    n = len(data)
    inside = (table != 0)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    up_to = (None, *prefixes)
    hashes = [np.zeros(len(starts), np.uint64) for _ in up_to]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        a, b = starts[at], ends[upto - 1]
        values = table[data[a:b]]
        s, e = starts[at:upto] - a, ends[at:upto] - a
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values * powers(_BASE, b - a + 1)[:b - a], out=sums[1:])
        down = powers(pow(_BASE, -1, 1 << 64), b - a + 1)[s]
        for size, out in zip(up_to, hashes):
            last = np.minimum(s + size, e) if size else e
            marked = np.uint64(size * _LENGTH % (1 << 64)) if size else (e - s).astype(np.uint64) * np.uint64(_LENGTH)
            h = mix((sums[last] - sums[s]) * down + marked)
            out[at:upto] = np.where(e - s >= size, h + np.uint64(size), 0) if size else h
        at = upto
    return (starts, ends, *hashes, first)


def gram_hashes(hashes, k, base=_BASE2):
    """A hash of each run of k consecutive words, for every position where one starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        out += hashes[j:j + n] * np.uint64(factor)
        factor = factor * base % (1 << 64)
    return mix(out)


def pieces(batch, text, limit=TEXTS):
    """Cut a record batch into row ranges of about ``limit`` bytes of text; a row is never cut."""
    _, offsets = text_buffer(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def owners(first):
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
