"""Operator 5: quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed features of its words (the word, its shape and its
last characters), beside which stand shares of repeated, capital and symbol
words. A bounded sample of labelled texts gives feature weights
(inverse document frequency), latent axes (truncated singular value
decomposition) and labelled vectors, which are broadcast: their number is fixed.
Every document is projected, its cosines with all labelled vectors are computed
exactly in blocks, and the nearest vote, weighted by similarity.

Cases: a null, empty or featureless text gets the share of good labels; all
texts get 0.5 when no row is labelled; equal similarities keep the labelled row
that was sampled first; labels other than 0 and 1 count as 1 when positive;
labelled texts of any length are learned and scored whole; an empty table gives
no rows; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import bucket_of_id, kept_in_worker, map_texts
from usagelens.llm.fitting import labelled_sample

#: Labelled documents of each class that vote, about.
VOTERS_A_CLASS = 1000
FEATURES = 4096
#: Shares of the words, besides the hashed features: equal to the word before, equal to an earlier word, capitals, symbols.
STYLES = 4
STYLE_WEIGHT = 1.0
AXES = 48
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3
MEMO_WORDS = 200_000


def _features(word: str) -> tuple[int, int, int]:
    """Hashed features of a whitespace-separated word: itself, its shape, its ending."""
    shape = []
    for c in word[:32]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    told = (word.lower().strip(".,;:!?"), "s:" + "".join(shape), "e:" + word[-2:].lower())
    return tuple(zlib.crc32(t.encode()) % FEATURES for t in told)


def _styles(word: str) -> tuple[int, int]:
    """Whether a word is in capitals, and whether it ends in or consists of symbols."""
    return int(len(word) > 1 and word.isupper()), int(not word.rstrip(".,;:?!'\")")[-1:].isalnum())


class Featurizer:
    """Feature rows of texts; words are remembered as rows of a bounded table."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, 5), dtype=np.int64)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """Damped counts of hashed features, then the styles; a row a text."""
        words = [(t or "").split() for t in texts]
        if len(self.row) > MEMO_WORDS:
            self.__init__()
        new = list({w for found in words for w in found if w not in self.row})
        for w in new:
            self.row[w] = len(self.row)
        if new:
            self.table = np.concatenate([self.table, np.array([(*_features(w), *_styles(w)) for w in new], dtype=np.int64)])
        row = self.row
        out = np.zeros((len(texts), FEATURES + STYLES), dtype=np.float32)
        for i, found in enumerate(words):
            if found:
                ids = np.array([row[w] for w in found])
                told = self.table[ids]
                out[i, :FEATURES] = np.log1p(np.bincount(told[:, :3].ravel(), minlength=FEATURES))
                same, fresh = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0, len(np.unique(ids)) / len(ids)
                # In long natural texts words recur too: only recurrence beyond the square root counts.
                old = max(0.0, 1 - fresh * np.sqrt(len(ids)) / 2)
                out[i, FEATURES:] = (same, old, *told[:, 3:].mean(axis=0))
        return out

    def rows(self, texts: list[str | None], idf: np.ndarray) -> np.ndarray:
        return weighted(self.matrix(texts), idf)


def weighted(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows: weighted words of length 1 beside the weighted styles."""
    return _unit(np.concatenate([_unit(matrix[:, :FEATURES] * idf), STYLE_WEIGHT * matrix[:, FEATURES:]], axis=1))


class Model:
    """idf (feature weights), axes (features x latent), voters (unit rows), labels, weights, prior."""

    def __init__(self, idf, axes, voters, labels, weights, prior):
        self.idf, self.axes, self.voters = idf, axes, voters
        self.labels, self.weights, self.prior = labels, weights, prior


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = VOTERS_A_CLASS) -> Model | None:
    """A model from documents (doc_id, text) and their labels (doc_id and the target); None without labelled rows."""
    chosen, counts = labelled_sample(docs, labels, target, per_class, "quality")

    def make():
        featurizer = Featurizer()

        def work(rows):
            matrix = featurizer.matrix([r[1] for r in rows])
            ids = [np.flatnonzero(m) for m in matrix]
            return {
                "doc_id": [r[0] for r in rows], "label": [r[2] for r in rows],
                "ids": [i.tolist() for i in ids], "values": [m[i].tolist() for m, i in zip(matrix, ids, strict=True)],
            }

        return work

    told = map_texts(chosen.select(F.col("doc_id").cast("string"), "text", "label"), make, "doc_id string, label int, ids array<int>, values array<float>")
    found = sorted(told.collect(), key=lambda r: zlib.crc32((r["doc_id"] or "").encode()))
    if not found:
        return None
    dense = np.zeros((len(found), FEATURES + STYLES), dtype=np.float32)
    for i, r in enumerate(found):
        dense[i, r["ids"]] = r["values"]
    idf = np.log((1 + len(found)) / (1 + (dense[:, :FEATURES] > 0).sum(axis=0))).astype(np.float32) + 1
    dense = weighted(dense, idf)
    axes = _latent_axes(dense, AXES)
    labels = np.array([r["label"] for r in found], dtype=np.float64)
    sampled = {v: max(1, int((labels == v).sum())) for v in (0, 1)}
    weights = np.array([counts.get(int(v), 0) / sampled[int(v)] for v in labels])
    prior = float((weights * labels).sum() / weights.sum())
    return Model(idf, axes, _unit(dense @ axes), labels, weights, prior)


def _latent_axes(rows: np.ndarray, count: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    count = min(count, *rows.shape)
    basis = np.linalg.qr(rows.T @ np.random.default_rng(5).standard_normal((rows.shape[0], count + 8)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :count].astype(np.float32)


class Voter:
    def __init__(self, model: Model):
        self.model, self.featurizer = model, Featurizer()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        placed = _unit(self.featurizer.rows(texts, m.idf) @ m.axes)
        near = placed.astype(np.float64) @ m.voters.T.astype(np.float64)
        k = min(NEIGHBOURS, near.shape[1])
        nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, nearest, axis=1), 0, None) ** SHARPNESS * m.weights[nearest]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * m.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1), m.prior)


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs (all columns) with a score of 0 to 1 in `column`; a column of this name is replaced."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n.lower() != column.lower()]
    at = names.index("text")
    key = ("quality", None if model is None else hash(model.voters.tobytes()))

    def make():
        voter = None if told.value is None else kept_in_worker(key, lambda: Voter(told.value))

        def work(rows):
            out = {n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
            out[column] = [0.5] * len(rows) if voter is None else np.clip(voter.scores([r[at] for r in rows]), 0, 1)
            return out

        return work

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return map_texts(docs.select(*(F.col(f"`{n}`") for n in names)), make, f"{schema}, `{column}` double")


def may_learn(rows: DataFrame) -> DataFrame:
    """The rows (with doc_id) whose labels may be learned."""
    return rows.where(bucket_of_id(F.col("doc_id"), 5) != 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = fit(docs, may_learn(labels))
    held_out = (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", predicted)
