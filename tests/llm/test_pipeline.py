import hashlib

import pytest

import corpus_pipeline
from usagelens.llm import decontaminate, language_id, near_text, quality
from usagelens.llm.common import table


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "tokens"]


def test_stages_apply_the_operators_decisions(spark, medium):
    docs = table(spark, medium, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, medium)
        assert left.dtypes == docs.dtypes
        kept = {r.doc_id: r for r in left.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            scored = quality.score(docs, quality.fit(docs, quality.may_learn(table(spark, medium, "labels"))))
            assert set(kept) == {r.doc_id for r in scored.collect() if r.score >= quality.THRESHOLD}
        elif name == "language":
            told = language_id.predict(docs, language_id.fit(language_id.training_rows(docs)))
            assert set(kept) == {r.doc_id for r in told.collect() if r.lang_pred != "und" and r.score >= 0.5 and r.rarity <= 4}
        elif name == "near_duplicates":
            assert set(kept) == {r.doc_id for r in near_text.classes(docs).collect() if r.kept}
        else:
            hit = {r.doc_id for r in decontaminate.hits(docs, table(spark, medium, "benchmark")).collect() if r.contaminated}
            assert hit and all(kept[d].text == before[d].text for d in kept if d not in hit)
            assert not [d for d in before if d not in hit and d not in kept]
            again = decontaminate.hits(left, table(spark, medium, "benchmark"))
            assert again.where("contaminated").count() == 0
            assert all(r.n_chars == len(r.text) for r in kept.values())
        assert 0 < len(kept) <= len(before)
        docs = spark.createDataFrame(left.collect(), docs.schema)


def test_run_gives_tokens_of_what_is_left(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    ids = {r.doc_id for r in table(spark, small, "documents").collect()}
    assert rows and {r.doc_id for r in rows} <= ids and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, small, odd_documents, no_documents, empty):
    docs = no_documents if empty else odd_documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() <= docs.count()
        if name != "tokens":
            assert out.dtypes == docs.dtypes


def test_languages_that_were_not_learned_go(spark, medium):
    docs = table(spark, medium, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    greek = "Η γλώσσα των εγγράφων αυτών δεν έχει μαθευτεί ποτέ από το μοντέλο και γι αυτό φεύγει"
    junk = "xqzjkw vbnqxz kqjxwz zzqxjv wkjqxv qxzvbn jqxzkw vqzjxk wqzxjv kzqjxw"
    more = spark.createDataFrame([(10**9, greek, None, "x", 5), (10**9 + 1, junk, None, "x", 5), (10**9 + 2, "12 34 - 56", None, "x", 5)], docs.schema)
    kept = corpus_pipeline.known_language(spark, docs.union(more), medium)
    assert {r.doc_id for r in kept.where("doc_id >= 1000000000").collect()} == set()
    assert kept.count() == docs.where("text rlike '[a-zA-ZÀ-ÿ]'").count()


def test_decontamination_without_n_chars(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    assert corpus_pipeline.without_benchmark(spark, docs, small).columns == ["doc_id", "text"]


def test_digest_of_tokens_is_stable(spark, small):
    told = [hashlib.sha256(str(sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, small).collect())).encode()).hexdigest() for _ in range(2)]
    assert told[0] == told[1]
