import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import near_text, near_vectors
from usagelens.llm.graph import components
from usagelens.llm.queries import op3_nn_descent, op4_order_minhash


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    links = [(a, b) for a, b in links if a != b]
    nodes = {n for link in links for n in link}
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == roots(nodes, links)


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        most, told = rng.randint(0, 8), distance(a, b)
        assert near_text.edit_distance_within(a, b, most) == min(told, most + 1)


def test_order_counts_in_sketches():
    sketcher = near_text.Sketcher()
    words = [f"w{i}" for i in range(200)]
    same, _ = sketcher.sketch(sketcher.hashes(words))
    near, _ = sketcher.sketch(sketcher.hashes([*words[:100], "new", *words[101:]]))
    turned, _ = sketcher.sketch(sketcher.hashes([*words[100:], *words[:100]]))
    shared = lambda x: sum(a == b for a, b in zip(same, x, strict=True))
    assert shared(near) > 15 and shared(near) > shared(turned)


def text_classes(docs):
    told = [(d.doc_id, near_text.words_of(d.text)) for d in docs if d.doc_id is not None]
    links = []
    for i, (a, x) in enumerate(told):
        for b, y in told[:i]:
            longer = max(len(x), len(y))
            if x and y and abs(len(x) - len(y)) <= 0.2 * longer and near_text.edit_distance_within(x, y, int(0.2 * longer + 1e-9)) <= 0.2 * longer + 1e-9:
                links.append((a, b))
    return roots({a for a, _ in told}, links)


def test_text_classes_are_those_of_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    rows = op4_order_minhash(spark, medium).collect()
    told = text_classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == told
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows) and len(set(told.values())) < len(told)


def replaced(rng, words, at):
    return [f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]


@pytest.mark.parametrize("least, most", [(0.80, 0.80), (0.80, 0.85), (0.85, 0.90), (0.90, 1.0)])
def test_texts_of_each_band_of_similarity_share_a_key(least, most):
    rng, sketcher, met = random.Random(8), near_text.Sketcher(), 0
    keys = lambda words: set(sketcher.sketch(sketcher.hashes(words))[0])
    for k in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([7, 10, 20, 25, 30, 60, 200]))]
        edits = int((1 - rng.uniform(least, most)) * len(words) + 1e-9)
        at = {int((i + 0.5) * len(words) / edits) for i in range(edits)} if k % 2 else set(rng.sample(range(len(words)), edits))
        met += bool(keys(words) & keys(replaced(rng, words, at)))
    assert met >= 0.99 * 600


def test_texts_with_every_fifth_word_replaced_are_linked(spark):
    rng, rows = random.Random(9), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(25 + 5 * k)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(replaced(rng, words, set(range(2, len(words), 5)))))]
    found = {r.doc_id: r.class_id for r in near_text.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}


def test_texts_are_linked_whatever_the_smallest_of_their_bucket_is(spark):
    """Bucket 1: a common passage, whose smallest document is near none. 2: links that go by a text near the smallest. 3: many texts."""
    rng = random.Random(10)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, own, chain = new(60), new(40), new(100)
    texts = {1: passage + new(40), 2: passage + own, 3: passage + replaced(rng, own, set(range(0, 40, 2))), 4: passage + new(40), 5: passage + new(40)}
    texts |= {6: texts[5][:88] + new(12), 10: chain, 11: replaced(rng, chain, set(range(0, 15))), 12: replaced(rng, chain, set(range(0, 30)))}
    texts[12] = texts[11][:80] + texts[12][80:85] + new(15)
    texts[13] = texts[12][:20] + new(15) + texts[12][35:]
    texts |= {i: passage + new(rng.randrange(20, 90)) for i in range(100, 700)}
    texts |= {i + 1000: replaced(rng, texts[i], set(rng.sample(range(len(texts[i])), len(texts[i]) // 6))) for i in range(100, 700, 7)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    bucket = lambda i: 1 if i < 10 else 2 if i < 100 else 3
    rows = spark.createDataFrame([(bucket(i), i) for i in texts], "key bigint, node bigint")
    nodes = near_text.sketch_documents(docs).selectExpr("doc_id AS node", "words", "counts")
    found = {r.node: r.component for r in components(near_text.linked(rows, nodes, docs.withColumnRenamed("doc_id", "node"))).collect()}
    links = [(a, b) for a, x in texts.items() for b, y in texts.items() if a < b and bucket(a) == bucket(b) and near_text.similar(x, y)]
    assert {i: found.get(i, i) for i in texts} == roots(texts, links) and (2, 3) in links and (1, 2) not in links and (12, 13) in links and (10, 13) not in links


def test_long_texts_are_aligned_between_anchors():
    rng = random.Random(11)
    for share in (0.02, 0.1, 0.15, 0.25):
        a = [f"w{int(rng.paretovariate(0.6))}" for _ in range(900)]
        b = []
        for w in a:
            turn = rng.random()
            b += [] if turn < share / 3 else [w, "new"] if turn < 2 * share / 3 else ["other"] if turn < share else [w]
        least = near_text.edit_distance_within(a, b, 900)
        assert least <= near_text.anchored_distance(a, b, 900) <= 1.3 * least + 5
        assert near_text.similar(a, b) == (least <= 0.2 * max(len(a), len(b)))
    a = [f"w{rng.randrange(3000)}" for _ in range(200_000)]
    b = [w if rng.random() > 0.12 else f"x{rng.randrange(3000)}" for w in a]
    began = time.time()
    assert near_text.similar(a, b) and not near_text.similar(a, a[::-1][:170_000] + b[:1000])
    assert time.time() - began < 60


def test_rows_with_equal_ids_and_other_texts_stay_apart(spark):
    new = lambda seed: " ".join(f"w{random.Random(seed + i).randrange(10**6)}" for i in range(40))
    a, b, c, d = (new(1000 * k) for k in range(1, 5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, c + " more"), (5, d + " more"), (3, b + " end")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id, r.text) for r in near_text.deduplicate(table).collect())
    assert found == sorted([(1, a), (2, b), (3, c), (3, d)])
    told = [(r.doc_id, r.class_id, r.kept) for r in near_text.classes(table).collect()]
    assert sorted(told) == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (3, 2, False)])


def test_hubs_and_hot_keys_give_the_same_classes(spark, monkeypatch):
    """A third of all texts are near one text; hubs are dealt to several tasks and hot keys take no shuffle."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(replaced(rng, base, {rng.randrange(60), rng.randrange(60)}))) for i in range(120)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(near_text.classes(table).collect())
    monkeypatch.setattr(near_text, "PARTNERS", 7)
    monkeypatch.setattr(near_text, "HOT_ROWS", 8)
    monkeypatch.setattr(near_text, "HOT_SAMPLE", 2)
    monkeypatch.setattr(near_text, "MOST_ASKED", 0)
    sketched = near_text.sketch_documents(table)
    assert near_text.hot_keys(sketched) and sorted(near_text.classes(table).collect()) == plain
    assert {r.class_id for r in plain if r.doc_id < 120} == {0} and all(r.kept for r in plain if r.doc_id >= 1000)


def test_pairs_ruled_out_by_word_counts_are_not_similar(spark):
    rng = random.Random(21)
    texts = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    texts += [replaced(rng, t, set(rng.sample(range(len(t)), len(t) // 6))) for t in texts] + [["w1"] * 300, ["w1"] * 400]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    nodes = near_text.sketch_documents(docs).selectExpr("doc_id AS node", "words", "counts")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    left = {tuple(r) for r in near_text._possible(spark.createDataFrame(pairs, "a bigint, b bigint"), nodes).collect()}
    alike = {(i, j) for i, j in pairs if near_text.similar(texts[i], texts[j])}
    assert alike <= left and len(alike) >= 20 and len(left) < len(pairs) / 2


@pytest.mark.parametrize("block", [4096, 40])
def test_crossing_pairs_of_small_and_of_large_buckets(spark, monkeypatch, block):
    """A bucket of one group, and one that is dealt in blocks: all pairs across components that may be similar, each once."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(70)]
    texts = {i: [*passage, *(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 30)))] for i in range(120)}
    texts |= {200 + i: replaced(rng, texts[i], set(rng.sample(range(60), 4))) for i in range(0, 120, 5)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    nodes = near_text.sketch_documents(docs).selectExpr("doc_id AS node", "words", "counts")
    component = {i: 0 if i < 50 else 60 if i in (60, 70) else i for i in texts}
    placed = spark.createDataFrame([(1, i, component[i]) for i in texts] + [(2, 0, 0), (2, 1, 0), (3, 5, 0)], "key bigint, node bigint, component bigint")
    found = [tuple(r) for r in near_text.crossing_pairs(placed, nodes).collect()]
    alike = {(a, b) for a in texts for b in texts if a < b and component[a] != component[b] and near_text.similar(texts[a], texts[b])}
    assert len(found) == len(set(found)) and alike <= set(found) and len(alike) >= 20
    assert all(a < b and component[a] != component[b] for a, b in found)


def test_a_node_meets_the_others_of_many_shared_buckets_in_one_group(spark):
    """Texts that share 100 keys are sent to one comparison, not to 100; pairs of later buckets are found there too."""
    rng = random.Random(37)
    base = [f"w{i}" for i in range(60)]
    texts = {i: replaced(rng, base, set(rng.sample(range(60), 3))) for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    nodes = near_text.sketch_documents(docs).selectExpr("doc_id AS node", "words", "counts")
    keys_of = {i: [k for k in range(100) if i == 0 or rng.random() < 0.5] for i in texts}
    component = {i: 0 if i < 20 else i for i in texts}
    placed = spark.createDataFrame([(k, i, component[i]) for i in texts for k in keys_of[i]], "key bigint, node bigint, component bigint")
    path = near_text.fresh_path(spark, "near-found")
    found = [tuple(r) for r in near_text.crossing_pairs(placed, nodes, path).collect()]
    alike = {(a, b) for a in texts for b in texts if a < b and component[a] != component[b] and set(keys_of[a]) & set(keys_of[b]) and near_text.similar(texts[a], texts[b])}
    assert len(found) == len(set(found)) and alike <= set(found) and len(alike) >= 100
    assert spark.read.parquet(path).count() == len(texts)


@pytest.mark.parametrize("block", [4096, 30, 8])
def test_buckets_of_a_leader_that_overlap_or_do_not(spark, monkeypatch, block):
    """Leaders of overlapping and of disjoint buckets, small and large: the pairs that share a bucket, and no others."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = random.Random(41)
    base = [f"w{i}" for i in range(60)]
    texts = {i: replaced(rng, base, set(rng.sample(range(60), 2))) for i in range(90)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    nodes = near_text.sketch_documents(docs).selectExpr("doc_id AS node", "words", "counts")
    buckets = [{0, *rng.sample(range(1, 40), 30)} for _ in range(12)] + [{40, *range(41 + 12 * n, min(90, 53 + 12 * n))} for n in range(5)] + [{7, 50, 80}, {50, 80, 81}]
    component = {i: i // 2 for i in texts}
    placed = spark.createDataFrame([(k, i, component[i]) for k, b in enumerate(buckets) for i in b], "key bigint, node bigint, component bigint")
    found = [tuple(r) for r in near_text.crossing_pairs(placed, nodes).collect()]
    together = {(a, b) for bucket in buckets for a in bucket for b in bucket if a < b and component[a] != component[b]}
    alike = {(a, b) for a, b in together if near_text.similar(texts[a], texts[b])}
    assert len(found) == len(set(found)) and alike <= set(found) <= together and len(alike) >= 300


@pytest.mark.parametrize("room", [near_text.HELD_WORDS, 100])
def test_texts_of_a_dense_set_are_sent_to_few_groups(spark, monkeypatch, room):
    """Pairs grow with the square of a set, the texts that are sent do not: each goes to one group for so many partners."""
    monkeypatch.setattr(near_text, "HELD_WORDS", room)
    rng = random.Random(43)
    base = [f"w{i}" for i in range(60)]
    texts = {i: replaced(rng, base, set(rng.sample(range(60), 7))) for i in range(100)} | {100 + i: texts_i.split() for i, texts_i in enumerate(["one two three", "one two four"])}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "node bigint, text string")
    pairs = [(a, b) for a in range(100) for b in range(a + 1, 100)] + [(100, 101)]
    table = spark.createDataFrame(pairs, "a bigint, b bigint")
    sent = near_text.meetings(table).collect()
    assert {(a, r.node) for r in sent for a in r.near} == set(pairs) and sum(len(r.near) for r in sent) == len(pairs)
    assert len(sent) <= len(pairs) / 4
    alike = {(a, b) for a, b in pairs if near_text.similar(texts[a], texts[b])}
    assert {tuple(r) for r in near_text.verified(table, docs).collect()} == alike and 0 < len(alike) < len(pairs) - 100


def test_audit_counts_pairs_that_were_missed(spark):
    base = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(12)], "node bigint, text string")
    nodes = near_text.sketch_documents(docs.withColumnRenamed("node", "doc_id")).selectExpr("doc_id AS node", "words", "counts")
    merged = spark.createDataFrame([(i, 0) for i in range(6)], "node bigint, component bigint")
    assert near_text.audit(nodes, docs, merged) == (66, 15)


def test_text_classes_of_odd_and_no_documents(odd_documents, no_documents):
    rows = near_text.classes(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: r.class_id for r in rows}
    assert found[6] == found[7] == 5 and found[8] == 8 and found[None] is None
    assert all(found[k] == k for k in (1, 2, 3, 4, -9, 10))
    kept = near_text.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-9, 1, 2, 3, 4, 5, 8, 10]
    assert kept.where("doc_id is null").count() == 1
    assert near_text.classes(no_documents).count() == 0 and near_text.deduplicate(no_documents).count() == 0


def vectors(seed, groups, size, noise, dims=24):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dims) for _ in range(120)]
    for _ in range(groups):
        middle = rng.standard_normal(dims)
        out += [middle + noise * rng.standard_normal(dims) for _ in range(size)]
    out += [out[0]] * 40
    return [v.astype(np.float32) for v in out]


def vector_links(rows):
    told = {}
    for r in rows:
        v = r.embedding
        fit = r.vec_id is not None and r.label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        told.setdefault((r.label, len(v)) if fit else ("alone", id(r)), []).append((r.vec_id, None if not fit else np.array(v, dtype=np.float64)))
    counts, links, nodes = [], [], set()
    for group in told.values():
        if group[0][1] is None:
            counts += [(group[0][0], 0)]
            nodes.add(group[0][0])
            continue
        ids = [i for i, _ in group]
        x = np.array([v for _, v in group])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        counts += list(zip(ids, near.sum(axis=1).tolist(), strict=True))
        nodes |= set(ids)
        links += [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if ids[i] != ids[j]]
    return counts, roots(nodes, links)


def check_vectors(rows, found):
    counts, classes = vector_links(rows)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.vec_id, r.n_links) for r in found), key=key) == sorted(counts, key=key)
    assert all(r.component_id == classes[r.vec_id] for r in found)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in found)


def test_vector_links_are_those_of_brute_force(spark):
    made = vectors(1, 6, 45, 0.05)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2, "x", 1) for i, v in enumerate(made)], "vec_id bigint, embedding array<float>, label int, node string, copies int")
    check_vectors(rows.collect(), near_vectors.near_links(rows).collect())


def test_dense_groups_that_are_near_each_other_are_one_component(spark):
    rng = np.random.default_rng(3)
    middle, way = np.eye(24)[0], np.eye(24)[1]
    made = [middle + side * 0.16 * way + 0.004 * rng.standard_normal(24) for side in (0, 1) for _ in range(60)]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(made)], "vec_id bigint, embedding array<double>, label int")
    found = near_vectors.near_links(rows).collect()
    check_vectors(rows.collect(), found)
    assert {r.component_id for r in found} == {0}


def test_audit_asks_until_enough_nodes_have_links(spark):
    rng = np.random.default_rng(4)
    made = [rng.standard_normal(24) for _ in range(3000)]
    made += [v + 0.001 for v in made[:60]]
    nodes = [(i, 0, 24, 1, v.astype("<f8").tobytes()) for i, v in enumerate(made)]
    nodes = spark.createDataFrame(nodes, "node bigint, label int, dim int, copies bigint, vec binary").select("node", "label", "dim", "vec", "copies")
    assert near_vectors._audited(nodes, spark.createDataFrame([], "node bigint, near bigint"), True, 0.98, 100_000)[2] == 120
    half = spark.createDataFrame([(i, 1) for i in range(60)], "node bigint, near bigint")
    assert near_vectors.audit(nodes, half, True) == 0.5


def test_sort_orders_grow_with_the_nodes_of_a_label():
    assert near_vectors._tables(100) == near_vectors.TABLES < near_vectors._tables(10_000) < near_vectors._tables(10_000_000)


def test_vector_query(spark, small):
    check_vectors(spark.read.parquet(f"{small}/embeddings.parquet").collect(), op3_nn_descent(spark, small).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_and_no_vectors(spark, kind):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0),
        (8, [float("inf"), 1.0], 0), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [-0.0, 1.0], 0), (13, [0.0, 1.0], 0),
        (14, [1.0, 0.0], 1), (15, [1.0, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    check_vectors(table.collect(), near_vectors.near_links(table).collect())
    assert near_vectors.near_links(table.limit(0)).count() == 0


def test_recall_is_checked_where_pairs_are_rare(spark, monkeypatch):
    rng = random.Random(8)
    made = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(300)]
    pairs = made + [" ".join([*made[i].split()[:-1], "other"]) for i in range(4)]  # about one text in a hundred has a near copy
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id bigint, text string")
    nodes = near_text.text_nodes(near_text.sketch_documents(docs)).cache()
    texts = near_text.node_texts(docs, near_text.sketch_documents(docs), nodes)
    apart = nodes.select("node", F.col("node").alias("component"))
    whole = nodes.select("node", F.lit(1).alias("component"))
    asked = []
    monkeypatch.setattr(near_text, "audit", lambda *a, plain=near_text.audit: asked.append(a[3:]) or plain(*a))
    true, found = near_text.check_recall(nodes, texts, whole)
    assert 4 <= true == found <= 8  # a pair is met from one end or both
    assert asked == [(64, 0), (256, 64), (1024, 256)]  # of 304 nodes all are asked
    with pytest.raises(RuntimeError, match="0 of "):
        near_text.check_recall(nodes, texts, apart)
