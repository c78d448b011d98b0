"""The shared job filter set, compiled to one predicate.

All job methods take the same filters, so a count can never drift from the rows
it counts. Bounds are inclusive and drop nulls; zero is a real bound. A missing
or empty text filter is no filter, but an empty sequence of accounts is no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens.functions.patterns import matches_any
from usagelens.functions.timewin import SITE_ZONE, in_site_days

#: Filter stem to the column it bounds.
BOUNDED = {
    "eligible_secs": "eligible_secs", "nodes": "numnodes", "cpus": "numcpus", "gpus": "numgpus", "elapsed": "elapsed",
    "reqmem": "reqmem", "memory_used": "memory", "memory_wasted": "memory_wasted",
}


@dataclass(frozen=True)
class JobFilters:
    start: date | None = None
    end: date | None = None
    user: str | None = None
    account: str | Sequence[str] | None = None
    queue: str | None = None
    qos: str | None = None
    exit_status: str | None = None
    job_id: str | None = None
    name: str | Sequence[str] | None = None
    ignore_case: bool = False
    min_eligible_secs: int | None = None
    max_eligible_secs: int | None = None
    min_nodes: int | None = None
    max_nodes: int | None = None
    min_cpus: int | None = None
    max_cpus: int | None = None
    min_gpus: int | None = None
    max_gpus: int | None = None
    min_elapsed: int | None = None
    max_elapsed: int | None = None
    min_reqmem: int | None = None
    max_reqmem: int | None = None
    min_memory_used: int | None = None
    max_memory_used: int | None = None
    min_memory_wasted: int | None = None
    max_memory_wasted: int | None = None

    def parts(self, zone: str = SITE_ZONE) -> dict[str, Column]:
        """One predicate for each filter that is set, by its name."""
        out: dict[str, Column] = {}
        if self.start is not None or self.end is not None:
            out["window"] = F.col("end_ts").isNotNull() & in_site_days(F.col("end_ts"), self.start, self.end, zone)
        for name in ("user", "queue", "qos"):
            if getattr(self, name):
                out[name] = F.col(name) == getattr(self, name)
        if self.account is not None and self.account != "":
            wanted = [self.account] if isinstance(self.account, str) else list(self.account)
            out["account"] = F.col("account").isin(wanted) if wanted else F.lit(False)
        if self.exit_status:
            out["exit_status"] = F.col("status") == self.exit_status
        if self.job_id and (wanted_id := self.job_id.strip()):
            job = F.col("job_id")
            out["job_id"] = job == wanted_id if "." in wanted_id else job.startswith(wanted_id + ".") | job.startswith(wanted_id + "[")
        if self.name:
            patterns = [self.name] if isinstance(self.name, str) else list(self.name)
            if any(patterns):
                out["name"] = matches_any(F.col("name"), patterns, self.ignore_case)
        for stem, column in BOUNDED.items():
            low, high = getattr(self, f"min_{stem}"), getattr(self, f"max_{stem}")
            if low is not None:
                out[f"min_{stem}"] = F.col(column) >= low
            if high is not None:
                out[f"max_{stem}"] = F.col(column) <= high
        return out

    def predicate(self, without: Sequence[str] = (), zone: str = SITE_ZONE) -> Column:
        kept = [p for name, p in self.parts(zone).items() if name not in without]
        return reduce(and_, kept, F.lit(True))

    def set_names(self) -> set[str]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name for name, v in values.items() if v is not None and v is not False and v != ""}
