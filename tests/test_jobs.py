import inspect
from dataclasses import fields, replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from usagelens.functions import buckets, timewin
from usagelens.operators.filters import BOUNDED, JobFilters
from usagelens.operators.jobs import COLUMNS, METRICS, JobQueries
from usagelens.plans import reports, rollup
from usagelens.sources import adapters

WINDOW = JobFilters(start=date(1996, 3, 1), end=date(1996, 5, 31))
PARAMETER = {"wait": "eligible_secs", "duration": "elapsed", "reqmem": "reqmem", "memory_used": "memory_used", "memory_wasted": "memory_wasted", "nodes": "nodes", "cpus": "cpus", "gpus": "gpus"}


@pytest.fixture(scope="module")
def q(spark, small):
    return JobQueries(adapters.jobs(spark, small).cache())


def count(q, f):
    return q.count(f).first()[0]


@pytest.mark.parametrize("dimension", list(buckets.DIMENSIONS))
def test_every_band_replays_to_its_own_count(q, dimension):
    rows = q.histogram(dimension, WINDOW).orderBy("position").collect()
    assert sum(r.job_count for r in rows) == count(q, WINDOW)
    stem = PARAMETER[dimension]
    for r in rows[:-1]:
        again = replace(WINDOW, **{f"min_{stem}": r.low if r.low is not None else -(2**62), f"max_{stem}": r.high})
        lowest = replace(again, **{f"min_{stem}": None}) if r.low in (0, None) else again
        assert r.job_count == count(q, again if r.low is not None else lowest)
    assert rows[-1].label is None


def test_owners_of_a_band_add_up_to_it(q):
    bands = {r.label: r.job_count for r in q.histogram("nodes", WINDOW).collect()}
    owners = q.histogram("nodes", WINDOW, owners_limit=10_000).groupBy("label").agg(F.sum("job_count")).collect()
    unnamed = q.jobs.where(WINDOW.predicate() & F.col("user").isNull()).count()
    assert sum(r[1] for r in owners) + unnamed == sum(bands.values())
    assert all(r[1] <= bands[r[0]] for r in owners)


@pytest.mark.parametrize("period", timewin.PERIODS)
def test_every_time_band_replays_to_its_own_count(q, period):
    told = timewin.bands(WINDOW.start, WINDOW.end, period)
    rows = q.timeseries(period, WINDOW.start, WINDOW.end).orderBy("position").collect()
    assert [r.label for r in rows] == [b["label"] for b in told]
    assert sum(r.job_count for r in rows) == count(q, WINDOW)
    for r, b in list(zip(rows, told, strict=True))[:12]:
        assert r.job_count == count(q, JobFilters(start=b["start"], end=b["end"]))


def test_series_of_owners_have_one_legend(q):
    rows = q.timeseries("month", WINDOW.start, WINDOW.end, owners_limit=3).collect()
    legends = {}
    for r in rows:
        legends.setdefault(r.label, set()).add(r.owner)
    assert len(set(map(frozenset, legends.values()))) == 1 and len(legends["1996-03"]) == 4
    assert sum(r.job_count for r in rows) == count(q, WINDOW)


@pytest.mark.parametrize("options", [{}, {"filters": JobFilters(user="u7")}, {"filters": JobFilters(account=["UNIV3", "CESM1"], queue="htc")}, {"owners_limit": 3}, {"owners_limit": 2, "owners_by": "account", "sort_by": "charges"}])
@pytest.mark.parametrize("period", timewin.PERIODS)
def test_rollup_and_jobs_give_one_series(q, period, options):
    named = JobQueries(q.jobs.where("user is not null and account is not null and queue is not null"))
    summary = rollup.daily_summary(named.jobs, WINDOW.start, WINDOW.end)
    assert rollup.covers(summary, named, WINDOW.start, WINDOW.end, options.get("filters", JobFilters()))
    fast = rollup.timeseries(summary, named, period, WINDOW.start, WINDOW.end, **options)
    slow = named.timeseries(period, WINDOW.start, WINDOW.end, **options)
    key = [c for c in ("position", "owner") if c in fast.columns]
    told = [[tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*key, *METRICS).orderBy(*key).collect()] for df in (fast, slow)]
    assert told[0] == told[1]


def test_rollup_is_used_only_where_it_covers(q):
    start, end = WINDOW.start, WINDOW.end
    summary = rollup.daily_summary(q.jobs, start, end)
    assert not rollup.covers(summary, q, start, end, JobFilters(qos="economy"))
    assert not rollup.covers(summary, q, start, end, JobFilters(min_nodes=0))
    busy = summary.where("user is not null").select("date").orderBy("date").first()[0]
    assert not rollup.covers(summary.where(F.col("date") != F.lit(busy)), q, start, end, JobFilters())
    assert rollup.covers(summary.where("user is not null"), q, start, end, JobFilters())  # gaps without jobs
    assert not rollup.covers(summary.limit(0), q, start, end, JobFilters())


def test_rollup_marks_days_without_jobs(q):
    day = date(1980, 1, 1)
    rows = rollup.daily_summary(q.jobs, day, day).collect()
    assert [(r.date, r.user, r.job_count) for r in rows] == [(day, None, 0)]
    assert rollup.report(rollup.daily_summary(q.jobs, day, day)).count() == 0
    assert rollup.contiguous([date(2020, 1, 1), date(2020, 1, 3), date(2020, 1, 2)]) == [(date(2020, 1, 1), date(2020, 1, 3))]


def test_facets_leave_their_own_filter_alone(q):
    accounts = ("CESM1", "WXYZ4", "NMMM2", "SCIS3", "SCIS5")
    f = JobFilters(queue="htc", exit_status="1", account=accounts)
    rows = q.facets(f, ("queue", "exit_status", "account")).collect()
    told = {}
    for r in rows:
        told.setdefault(r.facet, {})[r.value] = r["count"]
    assert set(told["account"]) <= set(accounts)
    assert told["queue"].get("htc", 0) == count(q, f) == told["exit_status"].get("1", 0)
    for value, n in told["queue"].items():
        if value is not None:
            assert n == count(q, replace(f, queue=value))
    assert {r.value for r in q.facets(f, ("queue",), self_exclude=False).collect()} <= {"htc"}
    with pytest.raises(ValueError):
        q.facets(f, ("colour",))


def test_filters_are_shared_and_have_no_defaults():
    assert all(f.default in (None, False) for f in fields(JobFilters))
    assert {f"{side}_{stem}" for stem in BOUNDED for side in ("min", "max")} <= {f.name for f in fields(JobFilters)}
    for method in ("search", "count", "facets", "histogram", "usage_by", "usage_totals", "timeseries"):
        assert "filters" in inspect.signature(getattr(JobQueries, method)).parameters


def test_search_is_checked(q):
    assert q.search(columns=COLUMNS[:14], limit=0).count() == 0
    for options in ({"limit": -1}, {"offset": -1}, {"sort_by": "colour"}, {"columns": ("colour",)}):
        with pytest.raises(ValueError):
            q.search(**options)
    first, second = q.search(WINDOW, limit=5).collect(), q.search(WINDOW, limit=5, offset=5).collect()
    assert [r.id for r in q.search(WINDOW, limit=10).collect()] == [r.id for r in first + second]


def test_bounds_drop_nulls_and_zero_counts(q):
    known = q.jobs.where("eligible_secs is not null").count()
    assert count(q, JobFilters(min_eligible_secs=0)) == known < q.jobs.count()
    assert count(q, JobFilters(account=[])) == 0 and count(q, JobFilters(name=[])) == count(q, JobFilters(account="")) == q.jobs.count()


def test_reports_are_all_there(q, spark, small):
    casper = JobQueries(q.jobs, "casper")
    assert len(reports.REPORTS) == 21 and len(reports.HISTORY) == 5
    for name in reports.REPORTS:
        assert reports.run(name, casper, WINDOW.start, WINDOW.end, "month").columns
    with pytest.raises(ValueError):
        reports.run("nothing", casper, WINDOW.start, WINDOW.end)
    assert reports.file_name("usage_history", "derecho", date(2025, 1, 1), date(2025, 1, 31), "dat") == "De_usage_history_2025-01-01_2025-01-31.dat"
    assert reports.file_name("job_waits", None, date(2025, 1, 1), date(2025, 1, 31), "csv").startswith("All_job_waits")
