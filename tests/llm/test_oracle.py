from pathlib import Path

import duckdb
import pytest

from usagelens.llm import oracle, queries, sharding
from usagelens.llm.common import table


def rows_of(columns, rows):
    order = sorted(columns)
    return order, sorted((tuple(r[list(columns).index(c)] for c in order) for r in rows), key=repr)


def told(sql, **views):
    base = duckdb.connect()
    for name, source in views.items():
        base.execute(f"create view {name} as select * from {source}")
    found = base.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle_agrees(spark, small, name):
    df = queries.queries()[name](spark, small)
    views = {f.stem: f"'{f}'" for f in Path(small).glob("*.parquet")}
    assert rows_of(df.columns, df.collect()) == told(queries.oracle_sql()[name], **views)


def test_sharding_of_odd_rows_agrees(spark, odd_documents, tmp_path):
    odd_documents.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    df = sharding.shard_documents(spark.read.parquet(str(tmp_path / "d")), 7, 3)
    assert rows_of(df.columns, df.collect()) == told(oracle.op7(7, 3), documents=f"'{tmp_path}/d/*.parquet'")


def test_many_texts_of_one_id_are_dealt_over_slices(spark, small):
    docs = table(spark, small, "documents").selectExpr("1 as doc_id", "text")
    told_slots = sorted(r.slot for r in sharding.shard_documents(docs).select("slot").collect())
    assert told_slots == list(range(docs.count()))
