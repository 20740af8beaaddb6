"""Document vectors by a model that the caller brings.

A task builds its encoder once, when its first texts arrive, and keeps it for all its batches. Texts of several Arrow
batches are pooled and encoded in the order of their length, so that a batch of a padding model holds texts of like
length; results leave by row key, without the texts. Pool and batch bound what a task holds.
"""
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, POOL = 256, 4096
ELEMENTS = {"float32": "float", "float64": "double"}
POOL_BYTES = 32 << 20


def _encoded(make_encoder, batch, pool, pool_bytes, element):
    def run(batches):
        encoder = None
        held, texts, size = [], [], 0

        def encode():
            order = np.argsort([len(t) for t in texts], kind="stable")
            found = [None] * len(texts)
            for i in range(0, len(order), batch):
                some = order[i:i + batch].tolist()
                for place, row in zip(some, np.asarray(encoder([texts[j] for j in some]), dtype=element)):
                    found[place] = row
            return pa.RecordBatch.from_arrays([pa.chunked_array(held).combine_chunks(), pa.array(found, pa.list_(pa.from_numpy_dtype(element)))], ["key", "vector"])
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                here = min(whole.num_rows - at, pool - len(texts))
                part = whole.slice(at, here)
                at += here
                encoder = encoder or make_encoder()
                new = ["" if t is None else t for t in part.column("text").to_pylist()]
                held.append(part.column("key"))
                texts += new
                size += sum(map(len, new))
                if len(texts) >= pool or size >= pool_bytes:
                    yield encode()
                    held, texts, size = [], [], 0
        if texts:
            yield encode()
    return run


def encode_documents(df: DataFrame, key, text, make_encoder, out="embedding", batch=BATCH, pool=POOL, pool_bytes=POOL_BYTES, element="float32") -> DataFrame:
    """(key, vector) of every row; a null text counts as an empty one.

    ``make_encoder`` is called without arguments in the task and returns a function from a list of texts to a 2-D
    array; ``element`` is the type of its numbers. A row's vector may depend on its text alone, so batches can be cut anywhere.
    """
    kind = df.schema[key].dataType.simpleString()
    made = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _encoded(make_encoder, batch, pool, pool_bytes, np.dtype(element)), f"key {kind}, vector array<{ELEMENTS[element]}>")
    return made.select(F.col("key").alias(key), F.col("vector").alias(out))


def word_md5_encoder(dim):
    """A factory of a small deterministic encoder: signed counts of hashed words, of length one.

    The first eight hex digits of a word's MD5 choose the place, the ninth its sign. Zero without words.
    """
    def make():
        known = {}

        def place(word):
            found = known.get(word)
            if found is None:
                if len(known) >= 1 << 20:
                    known.clear()
                digest = hashlib.md5(word.encode()).hexdigest()
                found = known[word] = int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) % 2 else -1.0
            return found

        def encode(texts):
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                for word in re.findall(r"\w+", text.lower()):
                    at, sign = place(word)
                    row[at] += sign
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms > 0, norms, 1.0)
        return encode
    return make
