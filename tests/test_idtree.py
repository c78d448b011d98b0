import random

import pytest
from pyspark.sql import functions as F

from usagelens.plans import idtree

TREE = "dir_id bigint, parent_id bigint, name string"


def walked(rows):
    """path by id, and ids below each, one parent at a time."""
    parent, name = {r[0]: r[1] for r in rows}, {r[0]: r[2] or "" for r in rows}
    found, under = {}, {r[0]: set() for r in rows}
    for node in parent:
        parts, at, seen = [], node, set()
        while at is not None and at in parent and at not in seen:
            seen.add(at)
            under[at].add(node)
            parts.append(name[at])
            at = parent[at]
        found[node] = "/" + "/".join(reversed(parts)) if at is None else None
    return found, under


def random_tree(size, seed):
    r = random.Random(seed)
    ids = r.sample(range(10 * size), size)
    return [(d, None if i < 3 else ids[r.randrange(max(0, i - 40), i)], f"n{r.randrange(9)}!{i}") for i, d in enumerate(ids)]


CHAIN = [(i, i - 1 if i else None, f"c{i}") for i in range(200)] + [(1000 + i, 199, f"leaf{i}") for i in range(50)]
BROKEN = [(1, None, "a"), (2, 1, None), (3, 99, "lost"), (4, 3, "under"), (5, 6, "x"), (6, 5, "y"), (7, 6, "z"), (8, 8, "self"), (9, None, "")]


@pytest.mark.parametrize("most", [idtree.MOST_BROADCAST, 0])
@pytest.mark.parametrize("rows", [CHAIN, random_tree(400, 1), BROKEN], ids=["chain", "random", "broken"])
def test_paths_and_totals_equal_a_walk(spark, monkeypatch, rows, most):
    monkeypatch.setattr(idtree, "MOST_BROADCAST", most)
    found, under = walked(rows)
    tree = spark.createDataFrame(rows, TREE)
    told = {r.dir_id: r for r in idtree.paths(tree).collect()}
    assert {d: r.path for d, r in told.items()} == found
    assert all(r.depth == (None if r.path is None else r.path.count("/")) for r in told.values())
    if rows is not BROKEN:
        stats = spark.createDataFrame([(d, d % 7, d) for d, _, _ in rows[::2]], "dir_id bigint, files bigint, at bigint")
        got = {r.dir_id: (r.files, r.at) for r in idtree.rolled(tree, stats, sums=("files",), greatest=("at",)).collect()}
        have = {d for d, _, _ in rows[::2]}
        assert got == {d: (sum(x % 7 for x in u & have), max(u & have, default=None)) for d, u in under.items()}


def test_subtrees_are_ranges(spark, tmp_path):
    rows = random_tree(300, 2) + BROKEN[2:8][:0]
    found, under = walked(rows)
    path = f"file://{tmp_path}/tree"
    idtree.write(idtree.intervals(idtree.paths(spark.createDataFrame(rows, TREE))), path)
    table = spark.read.parquet(path)
    for d in [r[0] for r in rows[::60]]:
        assert {r.dir_id for r in idtree.below(table, [d]).collect()} == under[d]
        assert [r.dir_id for r in idtree.above(table, d).collect()] == sorted((a for a, u in under.items() if d in u), key=lambda a: len(found[a].split("/")))
    two = [rows[5][0], rows[9][0]]
    plan = idtree.below(table, two)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(low" in plan
    some = [found[r[0]] for r in rows[:4]]
    assert idtree.ids_of(table, [some[0] + "/", some[1], "/nowhere"]) == {some[0] + "/": rows[0][0], some[1]: rows[1][0]}


def test_odd_trees(spark):
    placed = idtree.intervals(idtree.paths(spark.createDataFrame(BROKEN, TREE)))
    rows = {r.dir_id: r for r in placed.collect()}
    assert len(rows) == len(BROKEN) and all((r.low is None) == (r.path is None) for r in rows.values())
    assert idtree.below(placed, [3]).count() == 0 and {r.dir_id for r in idtree.below(placed, [1]).collect()} == {1, 2}
    empty = spark.createDataFrame([], TREE)
    assert idtree.intervals(idtree.paths(empty)).count() == 0
    with pytest.raises(Exception, match="repeated"):
        idtree.paths(spark.createDataFrame([(1, None, "a"), (1, None, "b")], TREE))


def test_intervals_are_written_in_the_order_they_come_in(spark, tmp_path):
    """Paths are dealt once: sizes stand beside them before, and ranges of paths are ranges of low. Rounds don't multiply partitions."""
    rows = random_tree(60, 3) + [(5003, 5099, "lost"), (5004, 5003, "under")]
    tree = spark.createDataFrame(rows, TREE)
    placed = idtree.paths(tree, idtree.sizes(tree))
    assert placed.rdd.getNumPartitions() <= 32
    path = f"file://{tmp_path}/tree"
    idtree.write(idtree.intervals(placed), path, ordered=True)
    table = spark.read.parquet(path)
    told = {r.dir_id: (r.path, r.low, r.high) for r in table.collect()}
    found, under = walked(rows)
    assert table.columns == [*tree.columns, "path", "depth", "low", "high"] and {d: p for d, (p, _, _) in told.items()} == found
    assert all(low is None if p is None else h - low == len(under[d]) for d, (p, low, h) in told.items())
    order = sorted((low, p.replace("/", "\x01")) for p, low, _ in told.values() if p is not None)
    assert [low for low, _ in order] == list(range(60)) and [p for _, p in order] == sorted(p for _, p in order)
    ranges = sorted((r.a, r.b) for r in table.where("low IS NOT NULL").groupBy("_metadata.file_path").agg(F.min("low").alias("a"), F.max("low").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
