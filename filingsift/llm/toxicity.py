"""Toxicity scores by a counterfactual-regularised classifier.

A logistic regression over the presence of words and word beginnings. Besides the labelled texts it sees, for
each labelled text that mentions a group, the same text with the mentions swapped for each other group, and pays
``FAIRNESS`` times the mean squared change of its score. Weights that tell groups apart cost more than they
gain, so a neutral mention of a group does not raise a score.

Fitting takes at most about ``PER_CLASS`` labelled rows of each class, chosen by a hash of the id, and of
their features the ``FEATURES`` that differ most between the classes; what reaches the driver is bounded by
these two parameters. Scoring reads every word of every text.

Defined results: a null or empty text, or one without known features, scores the model's base rate; rows with
a null label are not learned from; without labels of both classes every score is the share of label 1 (0
without labels); repeated rows are scored one by one; an id with several labels is learned from with each;
other columns play no part.
"""
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from filingsift.llm import words as W
from filingsift.llm.language_id import held_out
from filingsift.llm.tables import Tables

PER_CLASS = 3000
FEATURES = 2048
LEAST_TEXTS = 4
PREFIXES = (3, 4, 5, 6, 8)
FAIRNESS = 4.0
RIDGE = 0.5
ROUNDS = 400

#: Groups whose mentions are neutral in themselves; terms of one list are swapped for each other.
GROUPS = [
    ["women", "men", "girls", "boys", "transgender"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual"],
    ["immigrants", "refugees", "citizens", "foreigners"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer"], ["christen", "muslime", "juden"], ["femmes", "hommes"], ["chrétiens", "musulmans", "juifs"],
    ["mujeres", "hombres"], ["cristianos", "musulmanes", "judíos"],
]
_GROUP_OF = {term: (g, i) for g, terms in enumerate(GROUPS) for i, term in enumerate(terms)}
_MENTION = re.compile(r"(?<![^\W_])(" + "|".join(sorted(_GROUP_OF, key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)


TURNS = max(map(len, GROUPS)) - 1


def swap(text, turn=1):
    """The text with each mention of a group replaced by the ``turn``-th next term of its list."""
    def other(match):
        g, i = _GROUP_OF[match[0].lower()]
        return GROUPS[g][(i + turn) % len(GROUPS[g])]
    return _MENTION.sub(other, text)


def text_features(texts):
    """(text index, feature hash) for every word and word beginning, repeated as they occur."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, offsets = W.text_buffer(lowered)
    _, _, *hashes, first = W.split_words(data, offsets, W.ALNUM_LOWER, PREFIXES)
    own = W.owners(first)
    for h in hashes:
        some = h != 0
        yield own[some], h[some]


def _distinct(texts):
    """Distinct (text index, feature) pairs."""
    parts = list(text_features(texts))
    own, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[fresh], h[fresh]


def _count(batches):
    """Per feature: texts of the batch with it, by label."""
    for whole in batches:
        for batch in W.pieces(whole, "text"):
            own, h = _distinct(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            values, at = np.unique(h, return_inverse=True)
            ones = np.bincount(at, weights=label[own], minlength=len(values)).astype(np.int64)
            every = np.bincount(at, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ones), pa.array(every)],
                                             ["feature", "ones", "every"])


class Model:
    """Features (ascending hashes), their weights and the base score."""

    def __init__(self, features, weights=None, base=0.0):
        self.features, self.weights, self.base = features, weights, base
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def present(self, texts):
        """Distinct (text index, feature number) pairs of the known features in the texts."""
        rows, numbers = [], []
        for own, h in text_features(texts):
            maybe = self.mask[(h & np.uint64(0xFFFF)).astype(np.int64)]
            own, h = own[maybe], h[maybe]
            if len(h):
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                known = self.features[at] == h
                rows.append(own[known])
                numbers.append(at[known])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(1, len(self.features))
        key = np.unique(np.concatenate(rows) * width + np.concatenate(numbers))
        return key // width, key % width

    def score(self, texts):
        row, number = self.present(texts)
        margin = self.base + np.bincount(row, weights=self.weights[number], minlength=len(texts))
        return 1 / (1 + np.exp(-margin))


def _present(model):
    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, "text"):
                texts = batch.column("text").to_pylist()
                row, number = model.present(batch.column("text"))
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                plain = [number[a:b] for a, b in zip(cut[:-1], cut[1:])]
                gained, lost = [[] for _ in texts], [[] for _ in texts]
                for i, text in enumerate(texts):
                    if text and _MENTION.search(text):
                        row, number = model.present(pa.array([swap(text, turn) for turn in range(1, TURNS + 1)], pa.string()))
                        for turn in range(TURNS):
                            other = number[row == turn]
                            gained[i].append(np.setdiff1d(other, plain[i]).tolist())
                            lost[i].append(np.setdiff1d(plain[i], other).tolist())
                nested = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([p.tolist() for p in plain], pa.list_(pa.int64())),
                                                  pa.array(gained, nested), pa.array(lost, nested)], ["label", "plain", "gained", "lost"])
    return run


def fit(x, change, columns, label, weight, fairness=FAIRNESS, ridge=RIDGE, rounds=ROUNDS):
    """Accelerated gradient descent on the weighted log loss, the ridge, and the mean squared score change of swaps.

    ``change`` holds what each swap changes in the features ``columns``. Rare features are scaled up, so that a word
    seen in few texts is learned in as many rounds as a common one.
    """
    n, width = x.shape
    scale = (1 / np.sqrt(x.mean(axis=0) + 0.002)).astype(np.float32)
    x = np.column_stack([x * scale, np.ones(n, np.float32)]).astype(np.float32)
    change = change * scale[columns]
    pay = 2 * fairness / max(1, len(change))
    share = (weight / weight.sum()).astype(np.float32)
    pull = np.append(np.full(width, ridge / n), 0).astype(np.float32)

    def curved(v, scale):
        slope = x.T @ (scale * (x @ v)) + pull * v
        slope[columns] += pay * (change.T @ (change @ v[columns]))
        return slope

    v, steep = np.full(width + 1, 1, np.float32), 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        v = curved(v / np.linalg.norm(v), 0.25 * share)
        steep = float(np.linalg.norm(v))
    w, v = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)
    for turn in range(rounds):
        error = share * (1 / (1 + np.exp(-np.clip(x @ v, -60, 60))) - label).astype(np.float32)
        slope = x.T @ error + pull * v
        slope[columns] += pay * (change.T @ (change @ v[columns]))
        new = v - slope / (1.1 * steep)
        v, w = new + turn / (turn + 3) * (new - w), new
    return (w[:-1] * scale).astype(np.float64), float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, id="doc_id", text="text", label="toxic", per_class=PER_CLASS,
          features=FEATURES, fairness=FAIRNESS) -> Model:
    """Fit on labelled documents; ``labels`` has the id and a 0/1 label."""
    tables = Tables(documents.sparkSession, "toxicity")
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    marks = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    counts = {r.label: r.n for r in rows.select("id").join(marks, "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if counts.get(1) else -40.0)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = marks.filter(draw < F.when(F.col("label") == 1, per_class / counts[1]).otherwise(per_class / counts[0]))
    # about 2 * per_class ids, whatever the size of the corpus
    chosen = tables.write("sample", rows.join(F.broadcast(chosen), "id").select("text", "label"))
    taken = {k: min(per_class, n) for k, n in counts.items()}
    one, all_ = F.sum("ones"), F.sum("every")
    zero = all_ - one
    rate1, rate0 = (one + 0.5) / (taken[1] + 1), (zero + 0.5) / (taken[0] + 1)
    # how much knowing the feature tells about the class, per labelled text
    gain = F.abs(F.log(rate1 / rate0)) * (one / taken[1] + zero / taken[0])
    found = (chosen.mapInArrow(_count, "feature long, ones long, every long").groupBy("feature")
             .agg(gain.alias("gain"), all_.alias("n")).filter(F.col("n") >= LEAST_TEXTS)
             .orderBy(F.desc("gain"), "feature").limit(features).select("feature").collect())
    mentions = np.concatenate([h for _, h in text_features(pa.array(sorted(_GROUP_OF)))])
    names = np.unique(np.concatenate([np.array([r.feature for r in found], np.int64).view(np.uint64), mentions]))
    model = Model(names)
    sample = chosen.mapInArrow(_present(model), "label int, plain array<long>, gained array<array<long>>, lost array<array<long>>").toPandas()
    tables.drop("sample")
    x = np.zeros((len(sample), len(names)), np.float32)
    for i, present in enumerate(sample["plain"]):
        x[i, np.asarray(present, np.int64)] = 1
    swaps = [(np.asarray(a, np.int64), np.asarray(b, np.int64)) for gained, lost in zip(sample["gained"], sample["lost"])
             for a, b in zip(gained, lost) if len(a) or len(b)]
    columns = np.unique(np.concatenate([np.zeros(0, np.int64), *[c for pair in swaps for c in pair]]))
    change = np.zeros((len(swaps), len(columns)), np.float32)
    for i, (gained, lost) in enumerate(swaps):
        change[i, np.searchsorted(columns, gained)], change[i, np.searchsorted(columns, lost)] = -1, 1
    label_of = sample["label"].to_numpy()
    weight = np.where(label_of == 1, counts[1] / max(1, (label_of == 1).sum()), counts[0] / max(1, (label_of == 0).sum()))
    model.weights, model.base = fit(x, change, columns, label_of, weight, fairness)
    return model


def score(documents: DataFrame, model: Model, carry=("doc_id",), text="text") -> DataFrame:
    """Columns ``carry`` and the text of every row with its score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in W.pieces(whole, "text"):
                values = shared.value.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "score"])

    rows = documents.select(*[F.col(c) for c in carry if c != text], F.col(text).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, score double")


def op6_toxicity(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(documents.filter(~held_out()), labels)
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score",
                                          F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
