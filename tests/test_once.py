"""Lines are split once a row, and give the pairs that the pattern alone would."""

import re

from pyspark.sql import functions as F

from tests.test_ingest import line
from usagelens.sources import records, scan_log, scheduler_log

ODD = [
    'user=a account="P1" ctime=5', 'user=a b', 'a="x y" user=b', 'user="a', 'user=" b" ctime=1', 'a="x"user=b', 'user=a\tctime=7', "user=a user=b", "=user=a", "user", "user==a", "user=", "",
    ' user=a  ctime=3 ', 'a=b"c user=d', 'x="a=b" ctime=2', 'x="" user=z', 'user=é account="ü"',
]


def told(spark, pattern):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, attributes string")
    kept = scheduler_log.with_pairs(rows, pattern).select("i", "pairs").collect()
    return {r.i: (r.pairs.names[::-1], r.pairs["values"][::-1]) for r in kept}


def test_pairs_are_those_of_the_pattern(spark):
    for pattern in (r'(?:^|\s)([^\s=]+)=("[^"]*"|\S*)', r'([^\s=]+)=("[^"]*"|\S*)'):
        got = told(spark, pattern)
        for i, text in enumerate(ODD):
            found = re.findall(pattern, text, re.ASCII)
            assert got[i] == ([k for k, _ in found], [v for _, v in found]), text


def test_archive_keeps_the_last_of_a_key_and_tells_submit_without_its_map(spark):
    rows = records.archive(spark.createDataFrame([('t;E;1.srv;a=1 b="x y" a=2 ctime=60',), ("t;E;2.srv;",)], "value string"))
    first, second = rows.orderBy("job_id").collect()
    assert first.record == {"b": "x y", "a": "2", "ctime": "60"} and first.submit.minute == 1 and second.record == {} and second.submit is None
    plan = rows.select("job_id", "submit")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan and "map_concat" not in plan


def test_lines_are_split_once(spark):
    logs = scheduler_log.parse(spark.createDataFrame([(line(), "f", 1)], "value string, file string, line bigint"), "casper")
    plan = scheduler_log.in_order(logs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(attributes") == 2 and plan.count("split(value") == 1
    scan = scan_log.parse_gpfs(spark.createDataFrame([("<1> 42 7 0  s=1 a=2  u=3 g=4 p=d ac=2020-01-01 00:00:01 --  /a -- b",)], "value string"))
    assert scan._jdf.queryExecution().optimizedPlan().toString().count(r"\s+") == 1
    row = scan.first()
    assert (row.path, row.size, row.allocated, row.uid, row.gid, row.is_dir, row.atime.second) == ("/a -- b", 1, 2048, 3, 4, True, 1)
