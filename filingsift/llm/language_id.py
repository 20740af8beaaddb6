"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn by hashing its code point. A letter n-gram is
the elementwise product (binding) of its letters' vectors, each rotated by its place; a text is the sum
(bundling) of its n-grams' vectors; a language's prototype is the sum of the normalised vectors of its
training texts. A text gets the language whose prototype has the largest cosine with it.

Texts are lower-cased; everything between letters counts as one gap, which is a letter of its own.

The prototypes are fitted on about ``PER_LANGUAGE`` texts of each language, chosen by a hash of their id;
counting languages and predicting cover all rows.

Defined results: a null text and one without a letter are ``und`` with score 0; ties go to the first language
in alphabetical order; rows without a language are not learned from; without any learned language all is
``und``; repeated rows are judged one by one; other columns play no part.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from filingsift.llm import words as W
from filingsift.llm.tables import packed, unpacked

DIMENSIONS = 1024
NGRAM = 3
PER_LANGUAGE = 5000
BLOCK_BYTES = 2 << 20
LEAST_SCORE = 0.1  # three standard deviations of an unrelated text's cosine, 1 / sqrt(DIMENSIONS)
SURE_LENGTH = 60  # characters; shorter texts are kept whatever their score
UNKNOWN = "und"

_letters = []


def _is_letter():
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(points):
    """A row of DIMENSIONS signs for each code point (0 is the gap)."""
    with np.errstate(over="ignore"):
        seeds = W.mix(points.astype(np.uint64) + np.uint64(1))[:, None] + \
            np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(W.mix(seeds).view(np.uint8), axis=1)
    return (2 * bits.astype(np.int8) - 1)


def ngram_counts(texts):
    """(text index, n-gram code, count) triples of a column of texts, and the letters that the codes count in."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lowered = pc.utf8_lower(texts)
    # a gap before the first text too, so that no score depends on where a block begins
    points = np.frombuffer("".join(["\n", *(text + "\n" for text in lowered.to_pylist())]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    own = np.concatenate([[-1], np.repeat(np.arange(len(lengths)), lengths)])
    points = np.where(_is_letter()[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points, own = points[keep], own[keep]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    code = number[points].astype(np.int64)
    n = len(code) - NGRAM + 1
    if n <= 0 or len(letters) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    last = own[NGRAM - 1:]
    # a gap before the first letter may be the end mark of the text before
    good = (own[1:n + 1] == last) & ((own[:n] == last) | (points[:n] == 0))
    gram = np.zeros(n, np.int64)
    for j in range(NGRAM):
        gram = gram * len(letters) + code[j:j + n]
    size = len(letters) ** NGRAM
    key = np.sort(last[good] * size + gram[good])
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(fresh, len(key)))
    return key[fresh] // size, key[fresh] % size, count, letters


def text_vectors(texts):
    """One row of DIMENSIONS sums for each text."""
    row, gram, count, letters = ngram_counts(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not len(row):
        return out
    vectors = letter_vectors(letters)
    rolled = [np.roll(vectors, NGRAM - 1 - j, axis=1) for j in range(NGRAM)]
    grams, column = np.unique(gram, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column, count = row[order], column[order], count[order]
    for at in range(0, len(grams), 4096):
        part = grams[at:at + 4096]
        bound, rest = None, part
        for j in range(NGRAM - 1, -1, -1):
            factor = rolled[j][rest % len(letters)]
            bound = factor if bound is None else bound * factor
            rest = rest // len(letters)
        a, b = np.searchsorted(column, [at, at + len(part)])
        weights = np.zeros((len(texts), len(part)), np.float32)
        weights[row[a:b], column[a:b] - at] = count[a:b]
        out += weights @ bound.astype(np.float32)
    return out


def _unit(vectors):
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _bundle(batches):
    for whole in batches:
        for batch in W.pieces(whole, "text", BLOCK_BYTES):
            vectors = _unit(text_vectors(batch.column("text")))
            langs = np.array(batch.column("lang").to_pylist(), object)
            names = sorted(set(langs))
            sums = [vectors[langs == x].sum(0, dtype=np.float64).tolist() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))],
                                             ["lang", "sums"])


def _add(key, frame):
    return pd.DataFrame({"lang": [key[0]], "sums": [np.sum(np.stack(frame["sums"]), axis=0)]})


class Profiles:
    """Language names and unit prototypes."""

    def __init__(self, names, vectors):
        self.names = list(names)
        self.vectors = _unit(np.asarray(vectors, np.float64).reshape(len(self.names), DIMENSIONS)).astype(np.float32)

    def predict(self, texts):
        """(language, cosine) of each text; (und, 0) without letters."""
        vectors = text_vectors(texts)
        some = np.abs(vectors).sum(1) > 0
        if not self.names:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        cosine = _unit(vectors) @ self.vectors.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return np.where(some, np.array(self.names, object)[best], UNKNOWN), np.where(some, score, 0.0)


def learn(documents: DataFrame, id="doc_id", text="text", lang="lang", per_language=PER_LANGUAGE) -> Profiles:
    """Prototypes from rows with a language; one small vector per language reaches the driver."""
    rows = documents.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.coalesce("id", F.lit(""))), F.lit(1 << 30)) / F.lit(1 << 30)
    # one row per language, as the prototypes that reach the driver; the texts are not shuffled
    chosen = rows.join(F.broadcast(counts), "lang").filter(draw * F.col("n") < per_language).select("text", "lang")
    found = (chosen.mapInArrow(_bundle, "lang string, sums array<double>").groupBy("lang")
             .applyInPandas(_add, "lang string, sums array<double>").collect())
    found = sorted(found, key=lambda r: r.lang)
    return Profiles([r.lang for r in found], [r.sums for r in found])


def identify(documents: DataFrame, profiles: Profiles, carry=("doc_id",), text="text") -> DataFrame:
    """Columns ``carry`` and the text of every row with lang_pred and score."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, "text", BLOCK_BYTES):
                name, score = shared.value.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score, pa.float64())],
                                                 [*batch.schema.names, "lang_pred", "score"])

    rows = documents.select(*[F.col(c) for c in carry if c != text], F.col(text).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def accepted(documents: DataFrame, profiles: Profiles, text="text", least=LEAST_SCORE, sure=SURE_LENGTH) -> DataFrame:
    """The documents in a learned language: neither without letters nor, if long enough to tell, unlike every prototype."""
    doubtful = (F.col("score") < least) & (F.char_length("text") >= sure)
    found = identify(packed(documents, text), profiles, ["row"]).filter((F.col("lang_pred") != UNKNOWN) & ~doubtful)
    return unpacked(found, documents.columns, text)


def held_out(id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))), F.lit(5)) == 0


def op4_language_id(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(documents.filter(~held_out()))
    return identify(documents, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
