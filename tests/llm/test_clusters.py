import hashlib
import math

import numpy as np
import pytest

from usagelens.llm import exponion
from usagelens.llm.common import table
from usagelens.llm.queries import op11_exponion


def by_all_distances(rows, k=40, rounds=5, seed=2, length=64, scale=256):
    """(vec_id, q, cluster, distance) of rows (vec_id, embedding) and the centroids, in integers without any bound."""
    fit = []
    for vec_id, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 19 for x in v):
            fit.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    means = [q for _, q in sorted(fit, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for turn in range(rounds + 1):
        told = []
        for vec_id, q in fit:
            d, c = min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), c) for c, m in enumerate(means))
            told.append((vec_id, q, c, d))
        if turn < rounds:
            for c in range(len(means)):
                own = [q for _, q, x, _ in told if x == c]
                if own:
                    means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return told, means


def check(df, rows, **parameters):
    told, means = by_all_distances(rows, **parameters)
    per = {c: sum(d for _, _, x, d in told if x == c) for c in range(len(means))}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    want = [(i, c, d, per[c], sum(per.values()), digest[c]) for i, _, c, d in told]
    found = [tuple(r) for r in exponion.classify(df, **parameters).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_query_equals_all_distances(spark, small):
    rows = table(spark, small, "embeddings")
    found = {r.vec_id: (r.cluster, r.distance) for r in op11_exponion(spark, small).collect()}
    told, _ = by_all_distances([(r.vec_id, r.embedding) for r in rows.collect()])
    assert found == {i: (c, d) for i, _, c, d in told}


def test_ties_and_repeated_rows(spark):
    # Few distinct integer points on a line and a grid: many equally near centroids, equal centroids and empty clusters.
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(120)] + [(3, [0.0, 0.0, 0.0])] * 5
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for k in (1, 2, 7, 30, 200):
        check(df, rows, k=k, rounds=4, length=3, scale=1)


def test_odd_vectors(spark):
    good = [[float((i * j) % 5) / 4 for j in range(4)] for i in range(12)]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[3]), (None, good[4]), (20, None), (21, []), (22, [1.0] * 5), (23, [1.0, None, 0.0, 0.0]),
            (24, [float("nan"), 0.0, 0.0, 0.0]), (25, [float("inf"), 0.0, 0.0, 0.0]), (26, [0.0] * 4), (27, [-524288.0, 524288.0, 1e-9, -1e-9]), (28, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], "vec_id bigint, embedding array<double>, cluster int, q int, upper double")
    check(df, rows, k=5, length=4)
    assert exponion.classify(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert exponion.classify(df.where("embedding is null")).count() == 0


def test_a_ball_is_smaller_than_all_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (40, 64))
    q = centres[rng.integers(0, 40, 2000)] + rng.integers(-900, 900, (2000, 64))
    cluster, upper, lower = exponion.Search(centres, None).full(q)
    after = centres + rng.integers(-300, 300, centres.shape)
    moved = np.sqrt(((after - centres) ** 2).sum(axis=1)) * (1 + exponion.SLACK)
    asked = []
    plain = exponion.squared
    try:
        search = exponion.Search(after, moved)
        exponion.squared = lambda a, b: asked.append(len(a) * len(b)) or plain(a, b)
        found, upper, lower = search.again(q, cluster, upper, lower)
    finally:
        exponion.squared = plain
    d = plain(q, after)
    assert (found == d.argmin(axis=1)).all() and sum(asked) < 0.7 * d.size
    nearest = np.sort(np.sqrt(d), axis=1)
    assert (upper >= nearest[:, 0]).all() and (lower <= nearest[:, 1]).all()


@pytest.mark.parametrize("most", [10, 1 << 20, (1 << 20) + 1, 1 << 27])
def test_distances_are_exact(most):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-most, most + 1, (n, 64)) for n in (9, 4))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, r, strict=True)) for r in b] for p in a]
    assert exponion.squared(a, b).tolist() == want
