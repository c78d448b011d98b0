import hashlib
import random
import time

import pytest

from usagelens.llm import decontaminate
from usagelens.llm.decontaminate import Flat, Matcher, SuffixAutomaton, clean, hits, words_of
from usagelens.llm.queries import op8_decontamination


def brute(words, items, window=10):
    """(hit words, items) by comparing every place with every window."""
    hit, owners = set(), set()
    for item, told in items:
        size = min(window, len(told))
        for i in range(len(told) - size + 1):
            for j in range(len(words) - size + 1):
                if told[i : i + size] == words[j : j + size]:
                    hit |= set(range(j, j + size))
                    owners.add(item)
    return hit, owners


def test_automaton_knows_the_parts_of_its_items_and_no_others():
    rng = random.Random(3)
    for _ in range(200):
        items = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        parts = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        built = SuffixAutomaton(items)
        for _ in range(40):
            some = rng.choice(sorted(parts)) if rng.random() < 0.5 else tuple(rng.randrange(4) for _ in range(rng.randint(1, 6)))
            state = 0
            for word in some:
                state = -1 if state < 0 else built.follow[state].get(word, -1)
            assert (state >= 0) == (some in parts)


def test_spans_are_those_of_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        items = [(str(i), [rng.choice("abc") for _ in range(rng.randint(1, 9))]) for i in range(4)]
        words = [rng.choice("abcd" if rng.random() < 0.2 else "abc") for _ in range(40)]
        spans, owners = Matcher(Flat(items, 4)).spans(words)
        hit = {k for a, b in spans for k in range(a, b)}
        assert (hit, owners) == brute(words, items, 4)


def test_an_automaton_of_many_words_is_small_and_fast():
    rng = random.Random(5)
    items = [(str(i), [f"w{int(rng.paretovariate(0.8))}" for _ in range(1000)]) for i in range(400)]
    began = time.time()
    flat = Flat(items, 10)
    assert time.time() - began < 60 and len(flat.length) <= 800_000
    size = sum(x.nbytes for x in (flat.length, flat.link, flat.first_word, flat.first_target, flat.more, *flat.groups.values(), *flat.owners.values()))
    assert size < 64 << 20
    text = [w for i in range(3) for w in ["x", *items[i][1][100:140], "y"]]
    assert sum(b - a for a, b in Matcher(flat).spans(text)[0]) >= 3 * 31 * 10


def test_several_passes_give_the_same(spark, small, items, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    benchmark = benchmark.select("item_id", "text").union(items)
    plain, cleaned = sorted(map(str, hits(docs, benchmark).collect())), sorted(map(str, clean(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", sum(len(words_of(r.text)) for r in benchmark.collect()) // 3)
    assert len(list(decontaminate.automata(benchmark, 10, decontaminate.WORDS_A_PASS))) > 2
    assert sorted(map(str, hits(docs, benchmark).collect())) == plain
    assert sorted(map(str, clean(docs, benchmark).collect())) == cleaned


def test_long_items_are_read_in_pieces(spark):
    words = [f"w{i}" for i in range(95)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, "few words")], "item_id int, text string")
    pieces = list(decontaminate.item_pieces(table, 10, 20))
    assert max(len(p) for _, p in pieces) == 29 and {i for i, _ in pieces} == {"1", "2"}
    found = {tuple(p[i : i + 10]) for _, p in pieces if len(p) >= 10 for i in range(len(p) - 9)}
    assert found == {tuple(words[i : i + 10]) for i in range(86)} and all(len(p) >= 10 or p == ["few", "words"] for _, p in pieces)


def check(rows, docs, items):
    told = {}
    for d in docs:
        words = words_of(d.text)
        hit, owners = brute(words, items)
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        told.setdefault((d.doc_id, len(words), len(hit), len(owners), digest, bool(hit)), []).append(d)
    assert sorted(map(str, told)) == sorted({str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows})
    assert len(rows) == len(docs)


def test_query(spark, small):
    items = [(str(r.item_id), words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [d for d in spark.read.parquet(f"{small}/documents.parquet").collect() if len(d.text or "") < 3000]
    rows = [r for r in op8_decontamination(spark, small).collect() if r.doc_id in {d.doc_id for d in docs}]
    check(rows, docs, items)
    assert any(r.contaminated for r in rows)


@pytest.fixture(scope="module")
def items(spark):
    text = "ONE two three four five six seven eight nine ten eleven"
    return spark.createDataFrame([(1, text), (2, text), (3, "café naïve"), (4, None), (5, "..."), (None, "row without")], "item_id bigint, text string")


def test_odd_and_no_documents(odd_documents, no_documents, items):
    told = [(str(r.item_id) if r.item_id is not None else "", words_of(r.text)) for r in items.collect() if words_of(r.text)]
    docs = [d for d in odd_documents.collect() if len(d.text or "") < 10_000]
    rows = [r for r in hits(odd_documents, items).collect() if r.doc_id != 8]
    check(rows, docs, told)
    assert hits(no_documents, items).count() == 0
    assert not hits(odd_documents, items.limit(0)).where("contaminated").count()


def test_clean_removes_passages(spark, items):
    docs = spark.createDataFrame(
        [(1, "Keep. One, two three four five six seven eight nine ten; rest", "x"), (2, "untouched  text", "y"), (3, None, "z"),
         (4, "one two three four five six seven eight nine ten eleven", "w")], "doc_id bigint, text string, hit string")
    left = {r.doc_id: (r.text, r.hit) for r in clean(docs, items, most_hit=10, most_share=0.9).collect()}
    assert left == {1: ("Keep. ; rest", "x"), 2: ("untouched  text", "y"), 3: (None, "z")}
