import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from usagelens.llm.queries import op7_jump_sharding
from usagelens.llm.sharding import jump_shard, shard_documents


def jump(key, shards):
    key %= 2**64
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_shards_are_those_of_the_published_algorithm(spark):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, *range(100, 400), *[i * 7919**3 for i in range(200)]]
    keys = [k if k < 2**63 else k - 2**63 for k in keys]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 40, 41, 1000):
        found = {r[0]: r[1] for r in rows.select("k", jump_shard(F.col("k"), shards)).collect()}
        assert found == {k: jump(k, shards) for k in keys}


def check(rows, docs):
    by = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 40)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    told = sorted((d.doc_id if d.doc_id is not None else 10**18, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert told == sorted((r.doc_id if r.doc_id is not None else 10**18, r.size, r.text_crc32) for r in rows)


def test_query_over_all_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    check(op7_jump_sharding(spark, medium).collect(), docs.collect())


def test_odd_and_no_documents(spark, odd_documents, no_documents):
    check(shard_documents(odd_documents, slices=2).collect(), odd_documents.collect())
    assert shard_documents(no_documents).count() == 0


def test_plan_has_no_python(spark, odd_documents):
    assert "Python" not in (plan := shard_documents(odd_documents)._jdf.queryExecution().toString()) and "Arrow" not in plan
