"""Operator 6: toxicity by a linear classifier on character n-grams.

A text's features are the hashed character n-grams of its distinct words, each
counted once, scaled by their naive Bayes log-count ratio between toxic and
other texts. Logistic regression on a bounded sample of labelled texts gives
the weights; the product of weight and ratio is broadcast (a fixed-size table).

Cases: a null or empty text has no features and gets the intercept's score;
without labelled rows of both classes all texts get the share of toxic labels
(0 without any); labels above 0 count as 1; labelled texts of any length are
learned and scored whole; an empty table gives no rows; repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import bucket_of_id, map_texts
from usagelens.llm.fitting import labelled_sample
from usagelens.llm.quality import may_learn

#: Labelled documents of each class for fitting, about, and features of a class: documents beyond that are not used.
FIT_DOCUMENTS = 1500
FIT_FEATURES = 15_000_000
SIZES = (3, 4, 5)
FEATURES_BITS = 18
FEATURES = 1 << FEATURES_BITS
#: Features of fewer fitted texts than this have no weight.
LEAST_TEXTS = 3
SMOOTHING = 1.0
PENALTY = 1e-6
STEPS = 80
RATE = 0.02
THRESHOLD = 0.5
SLICE_BYTES = 2 << 20


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words between boundary marks: all in one array, and how many each word has."""
    told = np.frombuffer(("<" + ">\n<".join(words) + ">").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    word = np.cumsum(told == 10)
    padded = np.concatenate([told, np.full(max(SIZES), 10, dtype=np.uint64)])
    at_end = np.concatenate([word, np.full(max(SIZES), -1)])
    ids = np.empty((len(told), len(SIZES)), dtype=np.int32)
    inside = np.empty((len(told), len(SIZES)), dtype=bool)
    mixed = np.zeros(len(told), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        mixed = (mixed + padded[n - 1 : n - 1 + len(told)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in SIZES:
            k = SIZES.index(n)
            ids[:, k] = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FEATURES_BITS)
            inside[:, k] = (at_end[n - 1 : n - 1 + len(told)] == word) & (told != 10)
    return ids[inside], np.bincount(word, weights=inside.sum(axis=1), minlength=len(words)).astype(np.int64)


class Featurizer:
    """The distinct n-grams of the distinct words of texts, a slice of texts at a time."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = wanted
        self.stamp = np.full(FEATURES, -1, dtype=np.int64)

    def features(self, texts: list[str | None]):
        """An array of distinct features (of those wanted) of each text."""
        lowered = [(t or "").lower().replace(". ", " ").replace(", ", " ") for t in texts]
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = split.values.dictionary_encode()
        pool, size = _grams([w.strip(".,;:!?") for w in coded.dictionary.to_pylist()])
        if self.wanted is not None:
            keep = self.wanted[pool]
            size = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
            pool = pool[keep]
        first = np.cumsum(size) - size
        codes, edge = coded.indices.to_numpy(), split.offsets.to_numpy()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            word = np.unique(codes[a:b])
            each = size[word]
            ids = pool[np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            order = np.arange(len(ids))
            self.stamp[ids] = order  # of equal features the last one's place stays
            yield ids[self.stamp[ids] == order]


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = FIT_DOCUMENTS) -> Model:
    """Weights from documents (doc_id, text) and their labels (doc_id and the target)."""
    chosen, counts = labelled_sample(docs, labels, target, per_class, "toxicity")

    def make():
        featurizer = Featurizer()

        def work(rows):
            ids = [_packed(f) for f in featurizer.features([r[1] for r in rows])]
            return {"doc_id": [r[0] for r in rows], "label": [r[2] for r in rows], "ids": ids}

        return work

    told = map_texts(chosen.select(F.col("doc_id").cast("string"), "text", "label"), make, "doc_id string, label int, ids binary")
    told = sorted(((r["doc_id"] or "", r["label"], bytes(r["ids"])) for r in told.collect()), key=lambda r: zlib.crc32(r[0].encode()))
    found, size = [], {0: 0, 1: 0}
    for _, label, packed in told:
        if size[label] < FIT_FEATURES:
            found.append((label, ids := _unpacked(packed)))
            size[label] += len(ids)
    labels_ = np.array([label for label, _ in found], dtype=np.float64)
    if len(set(labels_.tolist())) < 2:
        share = labels_.mean() if len(found) else 0.0
        return Model(np.zeros(FEATURES, dtype=np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    weights, intercept = _regression([ids for _, ids in found], labels_, counts)
    return Model(weights, intercept)


def _packed(features: np.ndarray) -> bytes:
    """Features as sorted numbers, or as one bit each where that is shorter."""
    if 32 * len(features) < FEATURES:
        return np.sort(features).astype("<u4").tobytes()
    bits = np.zeros(FEATURES, dtype=bool)
    bits[features] = True
    return np.packbits(bits).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if 8 * len(packed) < FEATURES:
        return np.frombuffer(packed, dtype="<u4").astype(np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8))).astype(np.int32)


def _regression(ids: list[np.ndarray], labels: np.ndarray, counts: dict) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features; weights already multiplied by the ratios."""
    flat = np.concatenate(ids)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
    keep = np.bincount(flat, minlength=FEATURES)[flat] >= LEAST_TEXTS
    flat, owner = flat[keep], owner[keep]
    toxic = labels[owner] == 1
    p = SMOOTHING + np.bincount(flat[toxic], minlength=FEATURES)
    q = SMOOTHING + np.bincount(flat[~toxic], minlength=FEATURES)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    used = np.unique(flat)
    number = np.zeros(FEATURES, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    dense, scale = number[flat], ratio[used]
    share = np.array([counts[int(v)] / max(1, (labels == v).sum()) for v in labels])
    share /= share.sum()
    w, intercept = np.zeros(len(used)), 0.0
    speed, moved = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=(w * scale)[dense], minlength=len(ids)) + intercept
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        slope = np.append(np.bincount(dense, weights=error[owner], minlength=len(used)) * scale + PENALTY * w, error.sum())
        moved = 0.9 * moved + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope**2
        change = RATE * (moved / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-9)
        w, intercept = w - change[:-1], intercept - change[-1]
    full = np.zeros(FEATURES, dtype=np.float32)
    full[used] = w * scale
    return full, float(intercept)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs (all columns) with a score of 0 to 1 in `column`; a column of this name is replaced."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n.lower() != column.lower()]
    at = names.index("text")

    def make():
        model = told.value
        featurizer = Featurizer(model.weights != 0)

        def work(rows):
            out = {n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
            z = np.array([float(model.weights[f].sum(dtype=np.float64)) for f in featurizer.features([r[at] for r in rows])]) + model.intercept
            out[column] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return out

        return work

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return map_texts(docs.select(*(F.col(f"`{n}`") for n in names)), make, f"{schema}, `{column}` double", SLICE_BYTES)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = fit(docs, may_learn(labels))
    held_out = (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", predicted)
