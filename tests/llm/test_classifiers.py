import itertools
import math
import zlib

import numpy as np
import pytest

from usagelens.llm import language_id, quality, toxicity
from usagelens.llm.queries import op2_language_id, op5_quality, op6_toxicity


def held_out(doc_id, divisor, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == rest


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    p = np.array([[0.1], [0.2], [0.05], [0.15], [0.3], [0.1], [0.1], [1e-7]])
    segmenter = language_id.Segmenter(pieces)
    words = ["abab", "b", "aac"]
    lattice = segmenter.lattice(words)
    found = segmenter.forward(lattice, p)[lattice[-1], 0]
    for word, value in zip(words, found, strict=True):
        marked, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            total += math.prod(p[pieces.index(x), 0] if x in pieces else (1e-7 if len(x) == 1 else 0) for x in parts)
        assert value == pytest.approx(total)


def test_expected_uses_add_up():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    segmenter = language_id.Segmenter(pieces)
    lattice = segmenter.lattice(["ab", "ba"])
    p = np.array([0.2, 0.2, 0.2, 0.2, 0.2, 1e-7])
    uses = segmenter.expected(lattice, p, np.array([3.0, 2.0]))
    lengths = np.array([1, 1, 1, 2, 2, 1])
    assert (uses * lengths).sum() == pytest.approx(3 * 3 + 2 * 3)


def test_languages_of_held_out_documents(spark, medium):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = op2_language_id(spark, medium).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean(tested) > 0.97


def test_languages_of_odd_and_no_documents(spark, odd_documents, no_documents):
    rows = language_id.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.identify(no_documents).count() == 0
    unlearned = language_id.identify(odd_documents.withColumn("lang", odd_documents.lang.substr(9, 1)).where("lang is null"))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_signs_for_numbers_are_no_letters():
    assert language_id.words_of("½ ² ① Ⅷ 12 __ \u0301\u0308 ٣") == [] and language_id.words_of("a½ Ⅷth Größe\u0301") == ["a½", "ⅷth", "größe"]


@pytest.mark.parametrize(("query", "target", "least"), [(op5_quality, "quality", 0.95), (op6_toxicity, "toxic", 0.9)])
def test_labels_of_held_out_documents(spark, medium, query, target, least):
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = query(spark, medium).collect()
    limit = quality.THRESHOLD if target == "quality" else toxicity.THRESHOLD
    assert len(rows) == spark.read.parquet(f"{medium}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in rows)
    tested = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(tested) > 50 and np.mean(tested) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_of_odd_and_no_documents(spark, odd_documents, no_documents, module):
    kinds = "doc_id bigint, quality int, toxic int, text string"
    labels = spark.createDataFrame([(5, 1, 0, "clash"), (5, 0, 1, None), (7, 0, 1, ""), (-9, None, None, ""), (None, 1, 1, ""), (99, 1, 0, "")], kinds)
    for told in (labels, labels.limit(0)):
        rows = module.classify(odd_documents, told).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(no_documents, told).count() == 0


def test_votes_are_exact_cosines():
    model = quality.Model(None, None, np.eye(3), np.array([1.0, 0.0, 1.0]), np.ones(3), 0.5)
    voter = quality.Voter(model)
    voter.featurizer.rows = lambda texts, idf: np.array([[0.8, 0.6, 0.0], [0.0, 0.0, 0.0]])
    model.axes = np.eye(3)
    scores = voter.scores(["a", None])
    assert scores == pytest.approx([0.8**4 / (0.8**4 + 0.6**4), 0.5])


def test_grams_of_words():
    ids, sizes = toxicity._grams(["ab", "xyz", ""])
    assert sizes.tolist() == [3, 6, 0] and len(ids) == 9
    again, _ = toxicity._grams(["xyz"])
    assert ids[3:].tolist() == again.tolist()


TOXIC_WORDS, OTHER_WORDS = ["scum", "vermin", "clown", "idiot"], ["house", "river", "green", "walks", "table", "music"]


def small_labelled(spark, long=1):
    """Documents with labels that words tell, mostly; `long` repeats each text."""
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        words = [OTHER_WORDS[k] for k in rng.integers(0, len(OTHER_WORDS), 12)] + ([TOXIC_WORDS[k] for k in rng.integers(0, 4, 3)] if bad else [])
        docs.append((i, " ".join(words[k] for k in rng.permutation(len(words))) + (" " + " ".join(words)) * (long - 1)))
        labels.append((i, int(bad), int(bad)))
    docs.append((60, "scum river " * 5))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_is_that_of_a_plain_ratio_scaled_regression(spark):
    docs, labels = small_labelled(spark)
    told = {r.doc_id: r.toxic for r in labels.collect() if not held_out(r.doc_id, 5, 0)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams = {}  # sets of hashed n-grams, from each word alone
    for i, text in texts.items():
        grams[i] = {int(g) for w in set(text.lower().split()) for g in toxicity._grams([w])[0]}
    many = {}
    for i in told:
        for g in grams[i]:
            many[g] = many.get(g, 0) + 1
    used = sorted(g for g, n in many.items() if n >= toxicity.LEAST_TEXTS)
    p = {g: 1 + sum(g in grams[i] for i, y in told.items() if y) for g in used}
    q = {g: 1 + sum(g in grams[i] for i, y in told.items() if not y) for g in used}
    rest = toxicity.FEATURES - len(used)  # the smoothing of features that no text has
    of_p, of_q = sum(p.values()) + rest, sum(q.values()) + rest
    ratio = np.array([math.log(p[g] / of_p) - math.log(q[g] / of_q) for g in used])
    rows = np.array([[g in grams[i] for g in used] for i in told]) * ratio
    y = np.array(list(told.values()), dtype=float)

    def loss(w):
        z = rows @ w[:-1] + w[-1]
        return (np.log1p(np.exp(z)) - y * z).mean() + toxicity.PENALTY / 2 * (w[:-1] ** 2).sum()

    def slope(w):
        error = (1 / (1 + np.exp(-(rows @ w[:-1] + w[-1]))) - y) / len(y)
        return np.append(rows.T @ error + toxicity.PENALTY * w[:-1], error.sum())

    w = np.random.default_rng(1).standard_normal(len(used) + 1) * 0.1
    for k in (0, 5, len(used)):  # the slope is that of the loss
        step = np.eye(len(w))[k] * 1e-6
        assert slope(w)[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)
    w, first, second = np.zeros(len(used) + 1), 0, 0
    for step in range(1, toxicity.STEPS + 1):
        g = slope(w)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - toxicity.RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    for r in toxicity.classify(docs, labels).collect():
        z = sum((dict(zip(used, w * np.append(ratio, 1))).get(g, 0.0)) for g in grams[r.doc_id]) + w[-1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and r.predicted == (r.score >= 0.5)


def test_quality_is_that_of_a_plain_vote(spark):
    docs, labels = small_labelled(spark)
    told = {r.doc_id: r.quality for r in labels.collect() if not held_out(r.doc_id, 5, 0)}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def raw(text):
        words, out = text.split(), [0.0] * (quality.FEATURES + 4)
        for w in words:
            for f in quality._features(w):
                out[f] += 1
        same = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        old = max(0.0, 1 - len(set(words)) / len(words) * math.sqrt(len(words)) / 2)
        signs = [sum(quality._styles(w)[k] for w in words) / len(words) for k in (0, 1)]
        return [math.log1p(x) for x in out[:-4]] + [same, old, *signs]

    def unit(v):
        size = math.sqrt(sum(x * x for x in v))
        return [x / size if size else 0.0 for x in v]

    rows = {i: raw(t) for i, t in texts.items()}
    idf = [math.log((1 + len(told)) / (1 + sum(rows[i][k] > 0 for i in told))) + 1 for k in range(quality.FEATURES)]
    full = {i: np.array(unit([*unit([x * f for x, f in zip(r, idf)]), *r[-4:]])) for i, r in rows.items()}
    _, size, right = np.linalg.svd(np.array([full[i] for i in told]), full_matrices=False)
    axes = right[size > 1e-6]
    assert len(axes) < quality.AXES  # the axes span all labelled rows
    placed = {i: np.array(unit(axes @ v)) for i, v in full.items()}
    weight = {v: sum(r.quality == v for r in labels.collect() if not held_out(r.doc_id, 5, 0)) / sum(y == v for y in told.values()) for v in (0, 1)}
    for r in quality.classify(docs, labels).collect():
        near = sorted(((float(placed[r.doc_id] @ placed[i]), y) for i, y in told.items()), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(0.0, c) ** quality.SHARPNESS * weight[y], y) for c, y in near]
        assert r.score == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=2e-3)


def test_languages_are_those_of_plain_segmentations(spark):
    texts = {"en": ["the cat sat", "a cat and the hat", "hats sat on the mat"], "xx": ["oku lumi aku", "lumi oku taka", "taka aku tomi"]}
    rows = [(10 * k + i, t, lang) for k, (lang, some) in enumerate(texts.items()) for i, t in enumerate(some)] + [(97, "the lumi mat", None), (98, "aku", "xx"), (99, "cat hat", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    pieces = language_id.vocabulary()
    known = {x: i for i, x in enumerate(pieces)}

    def ways(word):
        marked = "▁" + word
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if all(x in known for x in parts):
                yield [known[x] for x in parts]

    model = {}
    for lang in texts:
        words = [w for d, t, of in rows if of == lang and not held_out(d, 3, 1) for w in t.split()]
        p = np.full(len(pieces), 1 / len(pieces))
        for _ in range(language_id.ROUNDS):
            uses = np.full(len(pieces), language_id.PSEUDO_COUNT)
            for w in words:
                told = [(way, math.prod(p[way])) for way in ways(w)]
                for way, chance in told:
                    np.add.at(uses, way, chance / sum(c for _, c in told))
            p = uses / uses.sum()
        model[lang] = p
    for r in language_id.identify(docs).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        likely = {lang: sum(math.log(sum(math.prod(p[way]) for way in ways(w))) for w in text.split()) for lang, p in model.items()}
        best = max(likely, key=likely.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(x - likely[best]) for x in likely.values()), abs=1e-6)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_long_labelled_texts_are_learned(spark, module):
    docs, labels = small_labelled(spark, long=400)
    assert min(len(r.text) for r in docs.where("doc_id < 60").collect()) > 25_000
    told = {r.doc_id: r.toxic for r in labels.collect()}
    found = [(r.predicted, told[r.doc_id]) for r in module.classify(docs, labels).collect() if r.doc_id < 60]
    assert np.mean([a == b for a, b in found]) > 0.9


def test_one_id_of_many_rows_counts_once(spark):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(300)] + [(i, f"other words {i}") for i in range(6, 26)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 26)] * 3, "doc_id bigint, toxic int")
    from usagelens.llm.fitting import labelled_sample

    chosen, counts = labelled_sample(docs, labels, "toxic", 100, "x")
    assert chosen.count() == 21 and counts == {0: 10, 1: 11}


def test_dense_features_are_packed_as_bits():
    some = np.random.default_rng(2).permutation(toxicity.FEATURES)
    for size in (0, 5, 8191, 8192, 100_000):
        packed = toxicity._packed(some[:size])
        assert len(packed) <= toxicity.FEATURES // 8 and toxicity._unpacked(packed).tolist() == sorted(some[:size].tolist())
