"""Operator 11: exact k-means over integer vectors by exponion search.

Every vector carries its cluster, an upper bound of the distance to that
cluster's centroid and a lower bound of the distance to any other. When
centroids move, the bounds move with them. A vector whose upper bound is below
its lower bound, or below half the way from its centroid to the nearest other,
stays where it is. For any other the upper bound is made exact, and if that does
not help, only the centroids in a ball around its own are compared: with the
distance u to its own and s from there to the nearest other, those within
2u + s, a prefix of a list sorted by distance. The ball holds the nearest and the
second nearest; its radius is inclusive, so of equally near ones none is lost.

Squared distances are exact integers and decide; bounds are doubles, rounded
outwards. A round reads the table of vectors and bounds that the last one wrote
and writes its own, without a shuffle. Sums are carried on: only the vectors that
changed their cluster are added and taken away, grouped on the map side, so that
a row a cluster and component reaches the driver.

Cases: vectors that are null, of another length, or hold null or non-finite
components are left out, as are components beyond +-2^19 before scaling, whose
squared distances no long could hold. A null vec_id counts as no digits when
centroids are chosen and stays null; rows of one vec_id are clustered each, and
chosen in the order of their components. Of equally near centroids the smaller
number wins; equal centroids are allowed, and empty ones stay where they are.
With fewer vectors than centroids each vector starts one. An empty table gives
no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import cut, discard, fresh_path

CENTROIDS, ROUNDS, SEED, LENGTH, SCALE = 40, 5, 2, 64, 256
#: Components before scaling; integers of twice this, times 256, have squares whose sum a long holds.
MOST_COMPONENT = float(1 << 19)
#: Integers up to this give exact inner products in doubles, for vectors of up to 512 components.
EXACT_IN_DOUBLES = 1 << 20
#: How far bounds are rounded outwards; a double's own error is a thousandth of it.
SLACK = 1e-12
STATE = "vec_id bigint, q array<int>, cluster int, before int, upper double, lower double"


@dataclass(frozen=True)
class Clusters:
    """Rows of vec_id, cluster and (squared) distance; the final centroids and the summed distances of each."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: np.ndarray


class Search:
    """Nearest centroids of blocks of vectors for one position of the centroids, and how far these moved to get there."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None):
        self.centroids, self.moved = centroids, moved
        k = len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # a centroid is first in its own list
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1) * (1 - SLACK)
        self.nearest_other = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        if moved is not None:
            # For the others of a cluster: the furthest that any of them went.
            top = np.argsort(moved)[::-1]
            self.others_moved = np.full(k, moved[top[0]])
            self.others_moved[top[0]] = moved[top[1]] if k > 1 else 0.0

    def full(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound by comparing all centroids."""
        return _two_nearest(squared(q, self.centroids), np.arange(len(self.centroids)))

    def again(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the bounds that held before the centroids moved."""
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others_moved[cluster], 0.0) * (1 - SLACK)
        safe = np.maximum(lower, self.nearest_other[cluster] / 2)
        open_ = np.flatnonzero(upper >= safe)
        own = ((q[open_] - self.centroids[cluster[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= safe[open_]]
        radius = (2 * upper[open_] + self.nearest_other[cluster[open_]]) * (1 + SLACK)
        for c in np.unique(cluster[open_]):
            rows = open_[cluster[open_] == c]
            within = np.searchsorted(self.apart[c], radius[cluster[open_] == c], side="right")
            # Vectors whose balls hold about as many centroids are compared together, at most twice as many as they need.
            reach = np.minimum(1 << np.ceil(np.log2(np.maximum(within, 2))).astype(np.int64), len(self.centroids))
            for width in np.unique(reach):
                some = rows[reach == width]
                ball = np.sort(self.order[c, :width])
                cluster[some], upper[some], lower[some] = _two_nearest(squared(q[some], self.centroids[ball]), ball)
        return cluster, upper, lower


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if most <= EXACT_IN_DOUBLES and a.shape[1] <= 512:
        products = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return (a * a).sum(axis=1)[:, None] - 2 * products + (b * b).sum(axis=1)[None, :]
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), dtype=np.int64)


def _two_nearest(distances: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of the least of each row, and bounds from it and from the second; numbers ascend."""
    rows = np.arange(len(distances))
    best = distances.argmin(axis=1)
    upper = np.sqrt(distances[rows, best].astype(np.float64)) * (1 + SLACK)
    if distances.shape[1] == 1:
        return numbers[best], upper, np.full(len(distances), np.inf)
    rest = distances.copy()
    rest[rows, best] = np.iinfo(np.int64).max
    return numbers[best], upper, np.sqrt(rest.min(axis=1).astype(np.float64)) * (1 - SLACK)


def integer_vectors(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q (floor of scale times each component) of the vectors that can be clustered."""
    whole = (F.size("embedding") == length) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= MOST_COMPONENT))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(whole).select("vec_id", scaled.alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest digests of a seed and their id: each task keeps k."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.q for r in kept.orderBy(digest, "q").limit(k).select("q").collect()], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, length: int = LENGTH, scale: int = SCALE) -> Clusters:
    """k-means of vectors (vec_id, embedding): `rounds` times assigned and moved, then assigned once more."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, length, scale)
    centroids = first_centroids(kept, k, seed)
    k = len(centroids)
    if not k:
        return Clusters(kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance").limit(0), np.zeros((0, length), dtype=np.int64), np.zeros(0, dtype=np.int64))
    sums, counts = np.zeros((k, length), dtype=np.int64), np.zeros(k, dtype=np.int64)
    rows, moved, path = kept.selectExpr("vec_id", "q", "-1 AS cluster", "-1 AS before", "0D AS upper", "0D AS lower"), None, None
    for _ in range(rounds):
        last, path = path, fresh_path(spark, "exponion")
        _assigned(rows, Search(centroids, moved)).write.parquet(path)
        rows = spark.read.schema(STATE).parquet(path)
        if last:
            discard(spark, last)
        _carry_on(rows, sums, counts)
        filled = counts > 0
        after = centroids.copy()
        after[filled] = sums[filled] // counts[filled, None]
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centroids = after
    final = Search(centroids, moved)
    rows = cut(_with_distance(_assigned(rows, final), centroids))
    if path:
        discard(spark, path)
    inertia = np.zeros(k, dtype=np.int64)
    for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect():  # a row a cluster
        inertia[r.cluster] = r.inertia
    return Clusters(rows, centroids, inertia)


def _assigned(rows: DataFrame, search: Search) -> DataFrame:
    """The state after one assignment. Centroids and their lists are of a fixed size and go with the function."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("q"))
            before = batch.column("cluster").to_numpy()
            if search.moved is None:
                cluster, upper, lower = search.full(q)
            else:
                cluster, upper, lower = search.again(q, before, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(before), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*names).mapInArrow(run, STATE)


def _with_distance(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, cluster = _matrix(batch.column("q")), batch.column("cluster")
                distance = ((q - centroids[cluster.to_numpy()]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def _matrix(lists) -> np.ndarray:
    """Equally long lists as rows."""
    return lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.int64)


def _carry_on(rows: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Bring the sums and counts of clusters up to date with the vectors that changed theirs."""
    changed = rows.where("cluster <> before").select("q", F.explode(F.array(
        F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")),
    )).alias("x")).where("x.c >= 0")
    totals = [F.sum(F.col("x.sign") * F.col("q")[i].cast("bigint")).alias(f"s{i}") for i in range(sums.shape[1])]
    for r in changed.groupBy("x.c").agg(F.sum("x.sign").alias("n"), *totals).collect():  # a row a cluster
        counts[r.c] += r.n
        sums[r.c] += np.array(r[2:], dtype=np.int64)


def classify(vectors: DataFrame, **parameters: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is clustered."""
    found = cluster_vectors(vectors, **parameters)
    total = int(found.inertia.sum())
    about = [
        (c, int(found.inertia[c]), total, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())
        for c, row in enumerate(found.centroids)
    ]
    told = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return found.rows.join(F.broadcast(told), "cluster").select(*columns)  # a row a centroid
