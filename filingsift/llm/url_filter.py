"""URL filtering by a few override rules and a Bloom filter cascade.

The cascade answers exactly whether a host is on a list, for every host of the corpus, without joining the
corpus with the list. Its first level is a Bloom filter of the listed keys; the unlisted keys of the corpus
that pass it by mistake fill the second level; the listed keys that pass that one by mistake fill the third;
and so on until a level has no false positives over the complete key universe of the corpus. The first level
that a key does not pass decides.

Keys travel as two 64-bit hashes. The universe is cut by hash into shards of about ``SHARD_KEYS`` keys, so
each cascade is built in one task of bounded size. A shard's cascade is a few bits per listed key. The
cascades reach the tasks in broadcast blocks of at most ``BLOCK_BYTES``, of which a task holds one at a time.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by
the cascade like any host; a null listed key is ignored; an empty list allows everything that no rule blocks;
repeated rows are judged one by one; other columns pass through, and results take the place of clashing names.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from filingsift.llm.words import mix

SHARD_KEYS = 1 << 18
BLOCK_BYTES = 32 << 20
MOST_LEVELS = 64

#: The given rules: prefix (host, then path) and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host, path, rules):
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    chain = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chain is None else chain


def _level_bits(n, rate):
    """Size in bits and number of hashes of a filter for n keys at a false positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2)), hashes


def _indices(a, b, level, hashes, bits):
    """Bit positions of keys: one column per hash function (``bits`` and ``hashes`` may differ by key)."""
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    one, two = mix(a ^ seed), mix(b + seed) | np.uint64(1)
    for j in range(int(np.max(hashes, initial=0))):
        yield j, ((one + np.uint64(j) * two) % bits).astype(np.int64)


def build_cascade(a, b, listed):
    """The levels (bits set, number of hashes) of one shard's cascade."""
    inside, outside = (a[listed], b[listed]), (a[~listed], b[~listed])
    levels = []
    while len(inside[0]):
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys with equal 128-bit hashes are both listed and not listed")
        n, others = len(inside[0]), len(outside[0])
        rate = 0.5 if levels else min(0.5, max(1e-6, n / (max(1, others) * math.sqrt(2))))
        bits, hashes = _level_bits(n, rate)
        table = np.zeros(bits, bool)
        for _, at in _indices(*inside, len(levels), hashes, np.uint64(bits)):
            table[at] = True
        passed = np.ones(others, bool)
        for _, at in _indices(*outside, len(levels), hashes, np.uint64(bits)):
            passed &= table[at]
        levels.append((table, hashes))
        inside, outside = (outside[0][passed], outside[1][passed]), inside
    return levels


def _build(key, frame):
    levels = build_cascade(frame["a"].to_numpy().view(np.uint64), frame["b"].to_numpy().view(np.uint64),
                           frame["listed"].to_numpy(bool))
    return pd.DataFrame({"shard": [key[0]], "bits": [[len(t) for t, _ in levels]], "hashes": [[h for _, h in levels]],
                         "levels": [b"".join(np.packbits(t).tobytes() for t, _ in levels)]})


class Block:
    """The cascades of a run of shards, laid out for looking up many keys at a time."""

    def __init__(self, rows, shards):
        depth = max(len(r.bits) for r in rows)
        self.bits, self.hashes, self.start = (np.zeros((shards, depth), np.int64) for _ in range(3))
        self.depth, self.has = np.zeros(shards, np.int64), np.zeros(shards, bool)
        parts, size = [], 0
        for r in rows:
            self.has[r.shard], self.depth[r.shard] = True, len(r.bits)
            self.bits[r.shard, :len(r.bits)], self.hashes[r.shard, :len(r.bits)] = r.bits, r.hashes
            at = 0
            for level, bits in enumerate(r.bits):
                self.start[r.shard, level] = (size + at) * 8
                at += (bits + 7) // 8
            parts.append(bytes(r.levels))
            size += at
        self.data = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def listed(self, a, b, shard):
        """Whether each key, of a shard in this block, is on the list."""
        failed = self.depth[shard].copy()  # first level that a key does not pass
        live = np.flatnonzero(failed > 0)
        for level in range(self.bits.shape[1]):
            live = live[self.depth[shard[live]] > level]
            s = shard[live]
            passed = np.ones(len(live), bool)
            for j, at in _indices(a[live], b[live], level, self.hashes[s, level], self.bits[s, level].astype(np.uint64)):
                at += self.start[s, level]
                set_ = (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                passed &= set_ | (j >= self.hashes[s, level])
            failed[live[~passed]] = level
            live = live[passed]
        return failed % 2 == 1


def _two_hashes(key):
    return F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")


class Cascade:
    """Exact membership of a column's values in a list, for all values of the given universe."""

    def __init__(self, universe: DataFrame, listed: DataFrame, shard_keys=SHARD_KEYS, block_bytes=BLOCK_BYTES):
        """``universe`` and ``listed`` have one string column each; both may repeat values."""
        u, l = universe.columns[0], listed.columns[0]
        keys = (universe.select(F.col(u).alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("used"))
                .unionByName(listed.select(F.col(l).alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("used")))
                .filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"), F.max("used").alias("used"))
                .filter("used"))
        self.shards = max(1, math.ceil(keys.count() / shard_keys))
        built = (keys.select(*_two_hashes(F.col("key")), "listed")
                 .withColumn("shard", F.pmod(F.shiftrightunsigned("a", 20), F.lit(self.shards)).cast("int"))
                 .groupBy("shard").applyInPandas(_build, "shard int, bits array<long>, hashes array<long>, levels binary"))
        sc = universe.sparkSession.sparkContext
        self.blocks, rows, size = [], [], 0
        for row in built.toLocalIterator():  # at most one block and one partition of shards at a time
            if rows and size + len(row.levels) > block_bytes:
                self.blocks.append(sc.broadcast(Block(rows, self.shards)))
                rows, size = [], 0
            rows.append(row)
            size += len(row.levels)
        if rows:
            self.blocks.append(sc.broadcast(Block(rows, self.shards)))

    def contains(self, key):
        blocks, shards = self.blocks, self.shards

        @F.pandas_udf("boolean")
        def member(a: pd.Series, b: pd.Series) -> pd.Series:
            x, y = a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)
            shard = ((x >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            out = np.zeros(len(x), bool)
            for block in blocks:
                part = np.flatnonzero(block.value.has[shard])
                out[part] = block.value.listed(x[part], y[part], shard[part])
                if len(blocks) > 1 and hasattr(block, "_value"):
                    del block._value  # one block in memory at a time
            return pd.Series(out)

        return member(*_two_hashes(key))


def filter_urls(pages: DataFrame, rules, listed: DataFrame = None, url="url") -> DataFrame:
    """Adds host, path, rule and verdict to each row: the longest rule's verdict, else ``block`` for a host in
    ``listed`` and ``allow`` for any other.

    Without ``listed``, the list is every host of which a rule blocks at least one page.
    """
    other = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = (pages.select(*[F.col(c) for c in other], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
              .withColumn("_fit", longest_rule(F.col("host"), F.col("path"), rules)))
    if listed is None:
        listed = judged.filter(F.col("_fit.verdict") == "block").select("host")
    cascade = Cascade(judged.select("host"), listed)
    method = F.when(cascade.contains(F.col("host")), "block").otherwise("allow")
    return judged.select(*other, "host", "path", F.col("_fit.rule").alias("rule"),
                         F.coalesce(F.col("_fit.verdict"), method).alias("verdict"))


def op2_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') as path from pages),
j as (select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from p),
v as (select *, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
    when rule is not null then 'allow' end as given from j)
select page_id, host, path, rule, coalesce(given,
    case when host in (select host from v where given = 'block') then 'block' else 'allow' end) as verdict
from v
"""
