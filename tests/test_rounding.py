"""Doubles are rounded as the SQL's ROUND does."""

import duckdb

from usagelens.queries import rounded


def test_rounded_as_the_oracle_does(spark):
    # 4.67625 is a tie in decimal digits, but its double times 10,000 is below 46,762.5.
    values = [4.67625, 6.06875, -4.67625, 1.00005, 0.0, 1e15, 2.5, None] + [(i * 18432 + 9216) / 3686400 / 100 for i in range(400)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (4, 6):
        told = {r.i: r.v for r in rounded(rows, places).collect()}
        want = [r[0] for r in duckdb.sql(f"SELECT ROUND(v, {places}) FROM (SELECT UNNEST($v::DOUBLE[]) AS v)", params={"v": values}).fetchall()]
        assert [told[i] for i in range(len(values))] == want
