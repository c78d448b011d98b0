"""The registry of resource and history reports: a name, and the query it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from usagelens.operators.jobs import JobQueries


@dataclass(frozen=True)
class Report:
    name: str
    base: str
    run: Callable[[JobQueries, date, date, str], DataFrame]


def _pie(kind: str, group: str):
    return lambda q, a, b, p: q.usage_by_facility(kind, a, b) if group == "facility" else q.usage_by_group(kind, group, a, b)


REPORTS: dict[str, Report] = {}
for _name, _group in (("proj", "account"), ("user", "user"), ("group", "account"), ("facility", "facility")):
    for _kind in ("cpu", "gpu"):
        REPORTS[f"pie-{_name}-{_kind}"] = Report(f"pie-{_name}-{_kind}", f"pie_{_name}_{_kind}", _pie(_kind, _group))
for _kind, _sizes in (("cpu", "node"), ("gpu", "gpu")):
    REPORTS[f"{_kind}-job-durations"] = Report(f"{_kind}-job-durations", f"{_kind}_job_durations", lambda q, a, b, p, k=_kind: q.job_durations(k, a, b, p))
    REPORTS[f"{_kind}-job-memory-per-rank"] = Report(f"{_kind}-job-memory-per-rank", f"{_kind}_job_memory_per_rank", lambda q, a, b, p, k=_kind: q.job_memory_per_rank(k, a, b, p))
    REPORTS[f"{_kind}-job-waits"] = Report(f"{_kind}-job-waits", f"{_kind}_job_waits", lambda q, a, b, p, k=_kind, s=_sizes: q.job_waits(k, s, a, b))
    REPORTS[f"{_kind}-job-sizes"] = Report(f"{_kind}-job-sizes", f"{_kind}_job_sizes", lambda q, a, b, p, k=_kind, s=_sizes: q.job_sizes(k, s, a, b))
REPORTS["job-waits"] = Report("job-waits", "job_waits", lambda q, a, b, p: q.job_waits("all", "core", a, b))
REPORTS["job-sizes"] = Report("job-sizes", "job_sizes", lambda q, a, b, p: q.job_sizes("all", "core", a, b))
REPORTS["memory-job-waits"] = Report("memory-job-waits", "memory_job_waits", lambda q, a, b, p: q.job_waits("all", "memory", a, b))
REPORTS["memory-job-sizes"] = Report("memory-job-sizes", "memory_job_sizes", lambda q, a, b, p: q.job_sizes("all", "memory", a, b))
REPORTS["usage-history"] = Report("usage-history", "usage_history", lambda q, a, b, p: q.usage_history(a, b, p))
HISTORY = {
    "unique-projects": lambda q, a, b, p: q.unique_by_period("account", a, b, p),
    "unique-users": lambda q, a, b, p: q.unique_by_period("user", a, b, p),
    "jobs-per-project": lambda q, a, b, p: q.collapsed_history("account", a, b, p),
    "jobs-per-user": lambda q, a, b, p: q.collapsed_history("user", a, b, p),
    "jobs-per-user-account": lambda q, a, b, p: q.by_entity_period("user", a, b, p),
}


def run(name: str, queries: JobQueries, start: date, end: date, period: str = "day") -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}")
    return REPORTS[name].run(queries, start, end, period)


def across(machines: dict[str, JobQueries], method: str, *args, **kwargs) -> DataFrame:
    """A method of each machine's queries, its rows tagged with the machine and put together."""
    from functools import reduce

    from pyspark.sql import functions as F

    told = [getattr(q, method)(*args, **kwargs).withColumn("machine", F.lit(m)) for m, q in machines.items()]
    return reduce(lambda a, b: a.unionByName(b), told)


def file_name(base: str, machine: str | None, start: date, end: date, ending: str) -> str:
    """Two letters of the machine (or All), the report, its window and its ending."""
    return f"{machine[:2].capitalize() if machine else 'All'}_{base}_{start}_{end}.{ending}"
