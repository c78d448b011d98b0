"""Operator 3: links between near vectors of a label, found by NN-descent.

Equal vectors of a label are one node. A first graph joins nodes that fall next
to each other when sorted by random-hyperplane codes. Then, round by round,
every node's neighbours and the nodes that name it are compared with each other
and better neighbours replace worse ones. A neighbour list that is full of links
(cosine at least the threshold) is saturated and grows; what even a grown list
can't hold is counted exactly, in blocks of the component, after components with
saturated lists have been compared with each other. Query nodes, more until
enough of them have links, are compared with all nodes to measure recall; while
it is too low, more codes and rounds follow, and if it stays so, an error.

Cases: rows with a null label or vec_id, and vectors that are null, empty, zero
or hold null or non-finite components, link with nothing (component_id is their
own vec_id); vectors of one label with different lengths don't link; repeated
rows count as vectors each; ties go to the smaller vec_id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import cut, groups
from usagelens.llm.graph import components

THRESHOLD = 0.98
#: Neighbours in a list, and in one that is saturated.
NEIGHBOURS, GROWN = 8, 24
#: Nodes besides itself whose members a node compares in a round.
COMPARED = 12
#: Sort orders of the first graph, bits of a code, nodes in a block.
TABLES, BITS, BLOCK = 4, 48, 128
#: More sort orders are made until a pair at the threshold misses every block with this chance; a bit agrees with chance AGREES.
UNSEEN, AGREES = 0.001, 0.936
LEAST_ROUNDS, MOST_ROUNDS = 2, 5
#: Rounds go on while they add more than this share of links.
WORTHWHILE = 0.001
#: Query nodes of the audit at first and at most, how many of them shall have links, the recall it asks for, and how often more is searched.
AUDITED, MOST_AUDITED, LINKED, RECALL, MORE_SEARCHES = 256, 65_536, 256, 0.99, 6
#: Query nodes that are compared with a batch at once.
QUERIES_AT_ONCE = 512
#: Members of a component, or components, that are compared with each other in one group: at least and at most, and
#: the blocks a component is dealt in while its blocks are between both, so that a small one is not one task.
MEMBERS, MOST_MEMBERS, SPREAD = 256, 4096, 16
#: Rows of a block whose cosines are held at once, and the least cosine of a neighbour for which the audit asks more nodes.
COSINES_AT_ONCE, NEAR = 512, 0.9

_LISTS = "node bigint, ids array<bigint>, sims array<double>"


def _blocks(count: Column) -> Column:
    """In how many blocks so many members are dealt. Copies of a vector sent to tasks are as many."""
    size = F.least(F.lit(MOST_MEMBERS), F.greatest(F.lit(MEMBERS), F.ceil(count / SPREAD)))
    return F.ceil(count / size).cast("int")


def _unit(raw: pa.Array, double: bool) -> np.ndarray:
    """Rows of unit length, in double precision, of vectors stored as bytes."""
    x = np.frombuffer(b"".join(raw.to_pylist()), dtype="<f8" if double else "<f4").reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = [pa.array(nodes), pa.ListArray.from_arrays(edges, pa.array(ids)), pa.ListArray.from_arrays(edges, pa.array(sims))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "ids", "sims"])


def _tables(most: int) -> int:
    """Sort orders for labels of at most so many nodes."""
    met = AGREES ** max(0.0, np.log2(max(most, 1) / BLOCK))
    return TABLES if met >= 1 else max(TABLES, int(np.ceil(np.log(UNSEEN) / np.log1p(-met))))


def _first_lists(nodes: DataFrame, double: bool, seed: int, tables: int) -> DataFrame:
    """Neighbour lists from blocks of nodes with like codes, one list a node and sort order."""

    def code(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column(2))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _unit(part.column(3), double)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((tables, x.shape[1], BITS))
                for t in range(tables):
                    codes = ((x @ planes[d][t]) > 0) @ (1 << np.arange(BITS, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t)), part.column(1), part.column(2), pa.array(codes), part.column(0), part.column(3)],
                        names=["t", "label", "dim", "code", "node", "vec"],
                    )

    def compare(batches):
        for block in groups(batches, 3, BLOCK):
            ids = np.asarray(block["node"])
            if len(ids) > 1:
                x = _unit(block["vec"].combine_chunks(), double)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                k = min(NEIGHBOURS, len(ids) - 1)
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield _lists(ids, ids[near].ravel(), np.take_along_axis(sims, near, axis=1).ravel(), np.full(len(ids), k))

    kind = dict(nodes.dtypes)["label"]
    coded = nodes.select("node", "label", "dim", "vec").mapInArrow(code, f"t bigint, label {kind}, dim int, code bigint, node bigint, vec binary")
    order = ["t", "label", "dim", "code", "node"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, _LISTS)


def _merged(lists: DataFrame, threshold: float, most: int, grown: int) -> DataFrame:
    """One list a node: its `most` nearest, and further links up to `grown`. Lists of a node are merged as they stream by."""

    def merge(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column(1).value_lengths())
            rows = np.stack([np.repeat(np.asarray(batch.column(0)), sizes), np.asarray(batch.column(1).flatten())])
            sims = np.asarray(batch.column(2).flatten())
            if held is not None:
                rows, sims = np.concatenate([held[0], rows], axis=1), np.concatenate([held[1], sims])
            rows, sims = nearest(rows, sims)
            if not len(sims):
                held = None
                continue
            last = rows[0] == rows[0, -1]
            held = rows[:, last], sims[last]
            if not last.all():
                yield from told(rows[:, ~last], sims[~last])
        if held is not None:
            yield from told(*held)

    def nearest(rows, sims):
        order = np.lexsort((-sims, rows[1], rows[0]))
        rows, sims = rows[:, order], sims[order]
        fresh = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])[: len(sims)]
        rows, sims = rows[:, fresh], sims[fresh]
        order = np.lexsort((rows[1], -sims, rows[0]))
        rows, sims = rows[:, order], sims[order]
        start = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])[: len(sims)]
        place = np.arange(len(sims))
        rank = place - np.maximum.accumulate(np.where(start, place, 0))
        keep = (rank < most) | ((rank < grown) & (sims >= threshold))
        return rows[:, keep], sims[keep]

    def told(rows, sims):
        nodes, sizes = np.unique(rows[0], return_counts=True)
        yield _lists(nodes, rows[1], sims, sizes)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(merge, _LISTS)


def _round(nodes: DataFrame, graph: DataFrame, double: bool, threshold: float) -> DataFrame:
    """New list entries from comparing each node's neighbours, and who names it, with each other."""
    one = lambda node, other: F.struct(node.alias("node"), F.array(other).alias("ids"), F.array("sim").alias("sims"))
    links = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("x")).select("node", F.col("x.ids").alias("id"), F.col("x.sims").alias("sim"))
    both = links.select(F.explode(F.array(one(F.col("node"), F.col("id")), one(F.col("id"), F.col("node")))).alias("x")).select("x.*")
    around = _merged(both, 2.0, COMPARED, COMPARED)
    asked = around.select("node", F.explode(F.concat(F.array("node"), "ids")).alias("member"))
    known = nodes.select(F.col("node").alias("member"), "vec").join(
        graph.select(F.col("node").alias("member"), "ids", "sims"), "member", "left"
    )
    rows = asked.join(known, "member").select("node", "member", "vec", "ids", "sims")

    def compare(batches):
        for group in groups(batches, 1):
            members = np.asarray(group["member"])
            if len(members) < 2:
                continue
            x = _unit(group["vec"].combine_chunks(), double)
            sims = x @ x.T
            had, had_sims = group["ids"].to_pylist(), group["sims"].to_pylist()
            out_ids, out_sims, sizes = [], [], []
            for i in range(len(members)):
                full = had_sims[i] is not None and len(had_sims[i]) >= NEIGHBOURS
                if full and len(had_sims[i]) >= GROWN and min(had_sims[i]) >= threshold:
                    sizes.append(0)
                    continue
                least = sorted(had_sims[i], reverse=True)[NEIGHBOURS - 1] if full else -2.0
                better = (sims[i] > least) | (sims[i] >= threshold)
                better &= ~np.isin(members, had[i] or []) & (members != members[i])
                out_ids.append(members[better])
                out_sims.append(sims[i][better])
                sizes.append(int(better.sum()))
            if sum(sizes):
                keep = np.array(sizes) > 0
                yield _lists(members[keep], np.concatenate(out_ids), np.concatenate(out_sims), np.array(sizes)[keep])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(compare, _LISTS)


def _links(graph: DataFrame, threshold: float) -> DataFrame:
    pairs = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("x"))
    return pairs.where(F.col("x.sims") >= threshold).select(F.col("node").alias("a"), F.col("x.ids").alias("b"))


def _link_count(graph: DataFrame, threshold: float) -> int:
    found = graph.agg(F.sum(F.size(F.filter("sims", lambda s: s >= threshold)))).first()[0]
    return found or 0


def _counted(nodes: DataFrame, membership: DataFrame, double: bool, threshold: float) -> DataFrame:
    """node and near: how many vectors of other nodes of its component it links with, exactly.

    A component is dealt in blocks of at most about MOST_MEMBERS; every pair of blocks
    is one bounded group, so a component of any size is spread over tasks.
    """
    sizes = membership.groupBy("component").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    dealt = membership.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = dealt.join(nodes.select("node", "vec", "copies"), "node")
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "vec"
    )

    def count(batches):
        for group in groups(batches, 3):
            ids, copies, block = np.asarray(group["node"]), np.asarray(group["copies"]), np.asarray(group["block"])
            x = _unit(group["vec"].combine_chunks(), double)
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            near = np.zeros(len(ids), dtype=np.int64)
            a, b = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
            for at in range(0, len(a), COSINES_AT_ONCE):
                some = a[at : at + COSINES_AT_ONCE]
                linked = (x[some] @ x[b].T) >= threshold
                if i == j:
                    linked[np.arange(len(some)), some] = False
                else:
                    near[b] += linked.T @ copies[some]
                near[some] += linked @ copies[b]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], names=["node", "near"])

    keys = ["component", "i", "j"]
    told = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "node bigint, near bigint")
    return told.groupBy("node").agg(F.sum("near").alias("near"))


def _crossing(nodes: DataFrame, graph: DataFrame, membership: DataFrame, double: bool, threshold: float) -> DataFrame:
    """Links (a, b) between components that have full lists, where links may have been evicted, by exact comparison.

    All members lie within a component's radius of its smallest node, so only
    components whose bounds allow a link are compared, in pairs of blocks.
    """
    full = graph.where((F.size("ids") >= GROWN) & (F.array_min("sims") >= threshold)).select("node")
    saturated = membership.join(full, "node").select("component").distinct()
    members = cut(membership.join(saturated, "component").join(nodes.select("node", "label", "dim", "vec"), "node"))
    middles = members.where("node = component").select("component", F.col("vec").alias("middle"))

    def spread(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                cosine = (_unit(part.column(2), double) * _unit(part.column(3), double)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["component", "angle"])

    radius = members.join(middles, "component").select("component", "dim", "vec", "middle").mapInArrow(spread, "component bigint, angle double")
    balls = members.where("node = component").join(radius.groupBy("component").agg(F.max("angle").alias("radius")), "component")
    per = balls.groupBy("label", "dim").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    keys = ["label", "dim", "i", "j"]
    block = F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int")
    dealt = balls.join(per, ["label", "dim"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", "radius", "vec")
    reach = np.arccos(threshold) + 1e-6

    def near(batches):
        for group in groups(batches, 4):
            ids, radii = np.asarray(group["component"]), np.asarray(group["radius"])
            x = _unit(group["vec"].combine_chunks(), double)
            for at in range(0, len(ids), COSINES_AT_ONCE):
                some = slice(at, at + COSINES_AT_ONCE)
                met = np.arccos(np.clip(x[some] @ x.T, -1, 1)) <= radii[some, None] + radii[None, :] + reach
                a, b = np.nonzero(met & (ids[some, None] < ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][a]), pa.array(ids[b])], names=["a", "b"])

    pairs = cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, "a bigint, b bigint").distinct())
    sizes = members.groupBy("component").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    held = members.join(sizes, "component").select("component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "node", "vec")
    told = pairs.join(sizes.select(F.col("component").alias("a"), F.col("blocks").alias("of_a")), "a").join(
        sizes.select(F.col("component").alias("b"), F.col("blocks").alias("of_b")), "b"
    )
    first = held.join(told, held["component"] == told["a"]).select("a", "b", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_b") - 1)).alias("j"), F.lit(0).alias("side"), "node", "vec")
    second = held.join(told, held["component"] == told["b"]).select("a", "b", F.explode(F.sequence(F.lit(0), F.col("of_a") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "node", "vec")
    keys = ["a", "b", "i", "j"]

    def join(batches):
        for group in groups(batches, 4):
            side, ids = np.asarray(group["side"]), np.asarray(group["node"])
            x = _unit(group["vec"].combine_chunks(), double)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for at in range(0, len(left), COSINES_AT_ONCE):
                a, b = np.nonzero(x[left[at : at + COSINES_AT_ONCE]] @ x[right].T >= threshold)
                if len(a):  # one link joins both components
                    yield pa.RecordBatch.from_arrays([pa.array(ids[left[at + a[:1]]]), pa.array(ids[right[b[:1]]])], names=["a", "b"])
                    break

    return first.union(second).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a bigint, b bigint")


def audit(nodes: DataFrame, counted: DataFrame, double: bool, threshold: float = THRESHOLD, graph: DataFrame | None = None) -> float:
    """The share of true links, of query nodes against all nodes, that were counted. There are more queries until enough have links.

    With the graph half of the queries are nodes with a near neighbour, where links are likelier. It is 1
    only where all nodes were asked, or where none of very many has a link.
    """
    asked = AUDITED
    while True:
        true, found, linked, queries = _audited(nodes, counted, double, threshold, asked, graph)
        if linked >= LINKED or queries < asked or asked >= MOST_AUDITED:
            return found / true if true else 1.0
        asked *= 4


def _audited(nodes: DataFrame, counted: DataFrame, double: bool, threshold: float, most: int, graph: DataFrame | None = None) -> tuple[int, int, int, int]:
    """True links, those counted, query nodes that have links, query nodes."""
    told = nodes.select("node", "label", "dim", "vec")
    if graph is None:
        asked = told.orderBy(F.xxhash64("node"), "node").limit(most)
    else:
        near = graph.where(F.array_max("sims") >= NEAR).select("node", F.lit(True).alias("near"))
        marked = told.join(near, "node", "left").withColumn("near", F.coalesce("near", F.lit(False)))
        order = [F.xxhash64("node"), F.col("node")]
        asked = marked.where("near").orderBy(*order).limit(most // 2).union(marked.where("not near").orderBy(*order).limit(most - most // 2))
    asked = asked.select("node", "label", "dim", "vec").collect()
    told = nodes.sparkSession.sparkContext.broadcast([tuple(r) for r in asked])

    def compare(batches):
        by: dict = {}
        for node, label, dim, vec in told.value:
            by.setdefault((label, dim), []).append((node, bytes(vec)))
        ready = {k: (np.array([n for n, _ in v]), _unit(pa.array([x for _, x in v]), double)) for k, v in by.items()}
        for batch in batches:
            labels, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            of = np.array([f"{a}|{b}" for a, b in zip(labels, dims, strict=True)])
            for key, (queries, q) in ready.items():
                mine = np.flatnonzero(of == f"{key[0]}|{key[1]}")
                if len(mine):
                    part = batch.take(pa.array(mine))
                    x = _unit(part.column(3), double)
                    for at in range(0, len(queries), QUERIES_AT_ONCE):
                        some = queries[at : at + QUERIES_AT_ONCE]
                        linked = (q[at : at + QUERIES_AT_ONCE] @ x.T) >= threshold
                        linked &= some[:, None] != np.asarray(part.column(0))[None, :]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some), pa.array(linked @ np.asarray(part.column(4)))], names=["node", "true"]
                        )

    exact = nodes.select("node", "label", "dim", "vec", "copies").mapInArrow(compare, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    row = exact.join(counted, "node", "left").agg(
        F.sum("true"), F.sum(F.least("true", F.coalesce("near", F.lit(0)))), F.count_if(F.col("true") > 0)
    ).first()
    return row[0] or 0, row[1] or 0, row[2] or 0, len(asked)


def near_links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding, label)."""
    double = "double" in dict(rows.dtypes)["embedding"]
    width = 8 if double else 4
    whole = F.col("embedding").isNotNull() & ~F.coalesce(
        F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)
    )
    nonzero = F.exists("embedding", lambda x: x != 0)
    fit = rows.withColumn("fit", F.coalesce(whole & nonzero & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    hashed = [F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")]
    keyed = fit.where("fit").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding", *hashed)
    alike = keyed.groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )

    def pack(batches):
        for batch in batches:
            values = batch.column(5)
            edge, flat = np.asarray(values.offsets), np.asarray(values.values)
            raw = flat.astype("<f8" if double else "<f4").tobytes()
            vec = [raw[width * a : width * b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(np.diff(edge).astype(np.int32)), pa.array(vec, pa.binary())],
                names=["label", "h1", "h2", "node", "copies", "dim", "vec"],
            )

    kind = dict(rows.dtypes)["label"]
    nodes = cut(alike.mapInArrow(pack, f"label {kind}, h1 bigint, h2 bigint, node bigint, copies bigint, dim int, vec binary"))
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    tables = _tables(most)
    graph = cut(_merged(_first_lists(nodes, double, 1, tables), threshold, NEIGHBOURS, GROWN))
    for search in range(1 + MORE_SEARCHES):
        if search:
            graph = cut(_merged(graph.union(_first_lists(nodes, double, 1 + search, tables)), threshold, NEIGHBOURS, GROWN))
        before = _link_count(graph, threshold)
        for turn in range(MOST_ROUNDS):
            graph = cut(_merged(graph.union(_round(nodes, graph, double, threshold)), threshold, NEIGHBOURS, GROWN))
            now = _link_count(graph, threshold)
            if turn + 1 >= LEAST_ROUNDS and now - before <= WORTHWHILE * now:
                break
            before = now
        links = _links(graph, threshold)
        membership = cut(components(links))
        crossing = cut(_crossing(nodes, graph, membership, double, threshold))
        if not crossing.isEmpty():
            membership = cut(components(links.union(crossing)))
        counted = cut(_counted(nodes, membership, double, threshold))
        recall = audit(nodes, counted, double, threshold, graph)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"near links: recall {recall:.4f} is below {RECALL} after {1 + MORE_SEARCHES} searches")
    placed = (
        nodes.select("label", "h1", "h2", "node", "copies")
        .join(membership, "node", "left").join(counted, "node", "left")
        .select("label", "h1", "h2", F.coalesce("component", "node").alias("component_id"),
                (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"))
    )
    found = keyed.select("vec_id", "label", "h1", "h2").join(placed, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    own = F.col("vec_id").cast("bigint")
    alone = fit.where("not fit").select(own.alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), own.alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.union(alone).select("vec_id", "n_links", "component_id", kept)
