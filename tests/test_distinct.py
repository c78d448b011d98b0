import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usagelens.operators.jobs import JobQueries
from usagelens.plans import distinct

JOBS = "id int, user string, account string, queue string, end_ts timestamp_ntz, machine string"


def test_bitmaps_equal_counts_of_jobs(spark):
    rng = random.Random(3)
    start = datetime(2024, 2, 20)
    rows = [(i, rng.choice([None, *(f"u{k}" for k in range(40))]), f"a{rng.randrange(5)}", "q", start + timedelta(minutes=rng.randrange(60 * 24 * 20)) if i % 50 else None, "casper") for i in range(900)]
    rows.append((901, None, None, None, datetime(2024, 3, 30, 12), "casper"))
    jobs = spark.createDataFrame(rows, JOBS)
    # Two halves by day: names of the second are numbered after those of the first.
    dictionary, bitmaps = None, None
    for part in (F.col("end_ts") < F.lit(datetime(2024, 2, 25, 7)), F.col("end_ts") >= F.lit(datetime(2024, 2, 25, 7))):
        daily = distinct.names_by_day(jobs.where(part))
        new = distinct.new_numbers(daily, dictionary).cache()
        dictionary = new if dictionary is None else dictionary.union(new)
        made = distinct.day_bitmaps(daily, dictionary)
        bitmaps = made if bitmaps is None else bitmaps.union(made)
    ids = {}
    for r in dictionary.collect():
        ids.setdefault(r.kind, {})[r.name] = r.id
    assert all(sorted(told.values()) == list(range(1, len(told) + 1)) for told in ids.values()) and len(ids["user"]) == 40
    plain = JobQueries(jobs.selectExpr("*", "0L AS reqmem", "0L AS memory"))
    for kind in ("user", "account"):
        for window in ((None, None), (date(2024, 2, 23), date(2024, 3, 3)), (date(2024, 3, 30), None), (date(2025, 1, 1), None)):
            for period in ("day", "month", "quarter", "year"):
                want = [tuple(r) for r in plain.unique_by_period(kind, *window, period).collect()]
                assert [tuple(r) for r in distinct.unique_by_period(bitmaps, kind, *window, period).collect()] == want
    with pytest.raises(ValueError):
        distinct.unique_by_period(bitmaps, "machine")


def test_many_names_fill_several_buckets(spark):
    day = datetime(2024, 5, 5, 12)
    jobs = spark.range(70_000).select(F.concat(F.lit("u"), "id").alias("user"), F.lit("a").alias("account"), F.lit("q").alias("queue"), F.lit(day).cast("timestamp_ntz").alias("end_ts"))
    daily = distinct.names_by_day(jobs)
    bitmaps = distinct.day_bitmaps(daily, distinct.new_numbers(daily, None))
    assert bitmaps.where("kind = 'user'").count() == 3
    assert distinct.unique_by_period(bitmaps, "user", period="year").first().n == 70_000
    assert distinct.unique_by_period(bitmaps.limit(0), "user").count() == 0
