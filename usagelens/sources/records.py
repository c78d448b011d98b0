"""The archive of raw scheduler records: all attributes of a job in a map, and filters over them.

Filters on fields that the job table has become column predicates (and reach the
Parquet scan); all others look into the map. A record without the field never
passes, negated or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.sources.scheduler_log import last_of, of_ended, with_pairs

#: Record fields that are columns of the job table.
COLUMN_OF = {"user": "user", "account": "account", "queue": "queue", "jobname": "name", "priority": "priority", "Exit_status": "status"}
TESTS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "contains": lambda a, b: a.contains(b),
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


def archive(lines: DataFrame) -> DataFrame:
    """job_id, submit and record (all key=value pairs, the last of a key) of E records among lines."""
    bare = lambda v: F.when(v.startswith('"'), F.regexp_replace(v, '^"(.*)"$', "$1")).otherwise(v)
    last = lambda key: bare(last_of(key))
    names = F.reverse(F.array_distinct("pairs.names"))
    record = F.map_from_arrays(names, F.transform(names, last))
    told = with_pairs(of_ended(lines), r'([^\s=]+)=("[^"]*"|\S*)')
    # submit is told without the map, so who needs no record makes none.
    return told.select("job_id", F.timestamp_seconds(last(F.lit("ctime")).try_cast("bigint")).cast("timestamp_ntz").alias("submit"), record.alias("record"))


def _value(field: str) -> Column:
    """A field of a record; Resource_List[ncpus] is the key Resource_List.ncpus."""
    return F.col("record").getItem(re.sub(r"\[(.*)\]$", r".\1", field))


def _test(value: Column, test: str, wanted, negated: bool) -> Column:
    if test not in TESTS:
        raise ValueError(f"unknown test {test!r}")
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) or test in ("gt", "ge", "lt", "le"):
        value, wanted = value.try_cast("double"), F.lit(wanted).cast("double")
    passed = TESTS[test](value, wanted)
    return F.coalesce(~passed if negated else passed, F.lit(False))


def find(jobs: DataFrame, records: DataFrame, ids: Sequence[str] = (), filters: Iterable[tuple[bool, str, str, object]] = (),
         hosts: Sequence[str] = (), between: tuple[str, str] | None = None) -> DataFrame:
    """Jobs with their records, by ids (array index and server are ignored) and (negated, test, field, value) filters.

    hosts: one of them is in the record's exec_host; between: times of day (HH:MM:SS) of the job's end, both included.
    """
    rows, later = jobs, []
    if ids:
        rows = rows.where(F.col("short_id").isin(*[int(m.group()) for i in ids if (m := re.match(r"\d+", i))]))
    for negated, test, field, wanted in filters:
        if field in COLUMN_OF and test in ("eq", "ne", "contains"):
            passed = TESTS[test](F.col(COLUMN_OF[field]), str(wanted))
            rows = rows.where(~passed if negated else passed)
        else:
            later.append(_test(_value(field), test, wanted, negated))
    if between:
        rows = rows.where(F.date_format("end_ts", "HH:mm:ss").between(*between))
    found = rows.join(records.select("job_id", "submit", "record"), ["job_id", "submit"])
    for passed in later:
        found = found.where(passed)
    if hosts:
        own = F.transform(F.split(F.col("record").getItem("exec_host"), r"\+"), lambda h: F.regexp_extract(h, r"^([^./]+)", 1))
        found = found.where(F.arrays_overlap(own, F.array(*[F.lit(h) for h in hosts])))
    return found


def without_record(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Jobs whose record is not archived."""
    return jobs.join(records.select("job_id", "submit"), ["job_id", "submit"], "left_anti")
