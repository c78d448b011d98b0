"""Questions about finished jobs: rows, counts, facets, histograms, usage, time series and the older reports.

A JobQueries wraps one table with a row a job: identity (id, job_id, name, user,
account, queue, qos, status, machine), times in naive UTC (submit, eligible,
start, end_ts), sizes, memory, and charges (hours and qos_factor, null where a
job has no charge row). Charges stand in the job's row, so no query joins them.
Every method returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import buckets, timewin
from usagelens.functions.charging import with_charge
from usagelens.operators.filters import JobFilters

METRICS = ("job_count", "cpu_hours", "gpu_hours", "cpu_charges", "gpu_charges")
# The queues of a machine's CPU and GPU reports, and which facet never excludes itself.
QUEUES = {
    "derecho": {"cpu": ("cpu", "cpudev"), "gpu": ("gpu", "gpudev", "pgpu")},
    "casper": {"cpu": ("htc", "gdex", "largemem", "vis", "rda"), "gpu": ("nvgpu", "gpgpu", "a100", "h100", "l40", "amdgpu")},
}
DEFAULT_FACETS, SCOPE_FACETS = ("queue", "qos", "exit_status"), ("account",)
FACET_COLUMNS = {"user": "user", "account": "account", "queue": "queue", "qos": "qos", "exit_status": "status"}
# Facilities by the beginning of the account; the first match counts.
FACILITIES = (("U", "UNIV"), ("P35", "UNIV"), ("W", "WNA"), ("C", "CSL"), ("P933", "CSL"), ("S", "CISL"))
DEFAULT_FACILITY = "NCAR"
# The keys of a listing's columns.
COLUMNS = (
    "job_id", "user", "account", "queue", "qos", "exit_status", "numnodes", "numcpus", "numgpus", "start", "end", "elapsed", "cpu_hours",
    "gpu_hours", "short_id", "name", "priority", "submit", "queued", "eligible", "eligible_secs", "run_count", "walltime", "mpiprocs",
    "ompthreads", "reqmem", "memory", "vmemory", "cputype", "gputype", "resources", "memory_hours", "qos_factor", "charge_version",
    "cpu_charges", "gpu_charges", "memory_charges",
)
DEFAULT_COLUMNS = COLUMNS[:4] + COLUMNS[6:14]
_TIMES = {"start": "start", "end": "end_ts", "submit": "submit", "queued": "queued", "eligible": "eligible"}
_SORTS = {
    "job_count": ("job_count",), "cpu_hours": ("cpu_hours",), "gpu_hours": ("gpu_hours",), "cpu_charges": ("cpu_charges",),
    "gpu_charges": ("gpu_charges",), "hours": ("cpu_hours", "gpu_hours"), "charges": ("cpu_charges", "gpu_charges"),
}


def raw_column(key: str) -> Column:
    """A listing's column, unformatted."""
    if key not in COLUMNS:
        raise ValueError(f"unknown column {key!r}")
    if key in _TIMES:
        return F.col(_TIMES[key])
    if key == "exit_status":
        return F.col("status")
    if key.endswith("_charges"):
        return with_charge(key.replace("_charges", "_hours"))
    return F.col(key)


def metrics() -> list[Column]:
    """The metric vector of a group of jobs; jobs without charges count, and add nothing."""
    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("job_count"), total(F.col("cpu_hours")).alias("cpu_hours"), total(F.col("gpu_hours")).alias("gpu_hours"),
        total(with_charge("cpu_hours")).alias("cpu_charges"), total(with_charge("gpu_hours")).alias("gpu_charges"),
    ]


def ranking(sort_by: str) -> Column:
    if sort_by not in _SORTS:
        raise ValueError(f"sort_by must be one of {tuple(_SORTS)}")
    keys = [F.col(c) for c in _SORTS[sort_by]]
    return keys[0] if len(keys) == 1 else keys[0] + keys[1]


def facility(account: Column) -> Column:
    out = F.when(account.isNull() | (account == ""), F.lit(DEFAULT_FACILITY))
    for start, name in FACILITIES:
        out = out.when(account.startswith(start), F.lit(name))
    return out.otherwise(F.lit(DEFAULT_FACILITY))


class JobQueries:
    def __init__(self, jobs: DataFrame, machine: str | None = None, zone: str = timewin.SITE_ZONE):
        self.jobs = jobs if machine is None else jobs.where(F.col("machine") == machine)
        if "memory_wasted" not in jobs.columns:
            self.jobs = self.jobs.withColumn("memory_wasted", F.col("reqmem") - F.col("memory"))
        self.machine, self.zone = machine, zone

    def _filtered(self, filters: JobFilters | None, without: Sequence[str] = ()) -> DataFrame:
        return self.jobs.where((filters or JobFilters()).predicate(without, self.zone))

    # rows and counts

    def search(self, filters: JobFilters | None = None, columns: Sequence[str] = DEFAULT_COLUMNS, limit: int | None = None,
               offset: int = 0, sort_by: str = "end", descending: bool = True) -> DataFrame:
        """Matching jobs as listing columns; times are text. The id breaks ties."""
        if (limit is not None and limit < 0) or offset < 0:
            raise ValueError("limit and offset must not be negative")
        key = raw_column(sort_by)
        order = key.desc_nulls_last() if descending else key.asc_nulls_first()
        rows = self._filtered(filters).orderBy(order, F.col("id"))
        if offset:
            rows = rows.offset(offset)
        if limit is not None:
            rows = rows.limit(limit)
        shown = [(F.date_format(raw_column(c), "yyyy-MM-dd HH:mm:ss") if c in _TIMES else raw_column(c)).alias(c) for c in columns]
        return rows.select("id", *shown)

    def by(self, dimension: str, value: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """All jobs of a user, account or queue."""
        return self._filtered(JobFilters(**{dimension: value}, start=start, end=end)).orderBy(F.col("end_ts").desc_nulls_last(), "id")

    def count(self, filters: JobFilters | None = None) -> DataFrame:
        return self._filtered(filters).agg(F.count(F.lit(1)).alias("job_count"))

    def facets(self, filters: JobFilters | None = None, facets: Sequence[str] = DEFAULT_FACETS, self_exclude: bool = True,
               limit: int | None = None) -> DataFrame:
        """facet, value and count. A facet that excludes itself ignores its own filter; account never does.

        One pass: jobs are grouped by all facets at once under the filters no
        facet may leave out, then folded by each facet under the others' filters.
        """
        filters = filters or JobFilters()
        unknown = set(facets) - set(FACET_COLUMNS)
        if unknown:
            raise ValueError(f"unknown facets {sorted(unknown)}")
        own = filters.parts(self.zone)
        loose = [f for f in facets if self_exclude and f in own and f not in SCOPE_FACETS]
        tests = {f: F.coalesce(own[f], F.lit(False)) for f in loose}
        grouped = (
            self._filtered(filters, loose).groupBy(*[FACET_COLUMNS[f] for f in facets]).agg(F.count(F.lit(1)).alias("n"))
            .withColumns({f"ok_{f}": t for f, t in tests.items()})
        )
        fold = F.explode(F.array(*[
            F.struct(F.lit(f).alias("facet"), F.col(FACET_COLUMNS[f]).alias("value"),
                     _all([F.col(f"ok_{o}") for o in loose if o != f]).alias("ok")) for f in facets
        ]))
        counts = grouped.select("n", fold.alias("x")).where("x.ok").groupBy("x.facet", "x.value").agg(F.sum("n").alias("count"))
        if limit is not None:
            order = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
            counts = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")
        return counts.orderBy("facet", F.col("count").desc(), F.col("value").asc_nulls_last())

    # distributions

    def histogram(self, dimension: str, filters: JobFilters | None = None, owners_limit: int = 0, owners_by: str = "user",
                  sort_by: str = "job_count") -> DataFrame:
        """A row for each band in order, empty ones too, and a last one (label null) for jobs without a value.

        With owners_limit, rows a band for its top owners instead (owner, place).
        """
        bands = buckets.histogram_bands(dimension, self.machine)
        label = buckets.band_label(F.col(buckets.DIMENSIONS[dimension][1]), bands).alias("label")
        if owners_limit:
            grouped = self._filtered(filters).groupBy(label, F.col(owners_by).alias("owner")).agg(*metrics())
            order = Window.partitionBy("label").orderBy(ranking(sort_by).desc(), F.col("owner").asc())
            ranked = grouped.where("label is not null and owner is not null").withColumn("place", F.row_number().over(order))
            return ranked.where(F.col("place") <= owners_limit)
        found = self._filtered(filters).groupBy(label).agg(*metrics())
        table = self.jobs.sparkSession.createDataFrame(
            [(i, *b) for i, b in enumerate([*bands, (None, None, None)])], "position int, label string, low bigint, high bigint"
        )
        joined = F.broadcast(table).alias("t").join(found.alias("f"), F.col("t.label").eqNullSafe(F.col("f.label")), "left")
        filled = [F.coalesce(F.col(f"f.{m}"), F.lit(0)).alias(m) for m in METRICS]
        return joined.select("position", "t.label", "low", "high", *filled)

    def usage_by(self, dimension: str, filters: JobFilters | None = None, limit: int | None = None, sort_by: str = "hours") -> DataFrame:
        """value and metrics, the largest first; nulls of equal rank last."""
        grouped = self._filtered(filters).groupBy(F.col(FACET_COLUMNS[dimension]).alias("value")).agg(*metrics())
        ordered = grouped.orderBy(ranking(sort_by).desc(), F.col("value").asc_nulls_last())
        return ordered if limit is None else ordered.limit(limit)

    def usage_totals(self, filters: JobFilters | None = None) -> DataFrame:
        return self._filtered(filters).agg(*metrics())

    def window(self, filters: JobFilters | None = None) -> DataFrame:
        """First and last end, and how many jobs have none, over what the filters but the window leave."""
        return self._filtered(filters, ["window"]).agg(
            F.min("end_ts").alias("first_end"), F.max("end_ts").alias("last_end"), F.count(F.when(F.col("end_ts").isNull(), 1)).alias("null_count")
        )

    # time series

    def timeseries(self, period: str, start: date, end: date, filters: JobFilters | None = None, owners_limit: int = 0,
                   owners_by: str = "user", sort_by: str = "job_count") -> DataFrame:
        """A row for each calendar band of site days, empty ones too.

        With owners_limit, rows a band for the window's top owners and one (owner
        null) for all others: every band has the same owners.
        """
        bands = timewin.bands(start, end, period, self.zone)
        day = timewin.site_day(F.col("end_ts"), self.zone)
        from dataclasses import replace

        rows = self._filtered(replace(filters or JobFilters(), start=start, end=end)).withColumn("period", timewin.period_start(day, period))
        return fill_bands(rows, bands, owners_limit, owners_by, sort_by)

    # older reports

    def _report_rows(self, resource: str, start: date | None, end: date | None) -> DataFrame:
        """Charged jobs of a resource's queues within site days."""
        return self._queue_rows(resource, start, end).where(F.col("cpu_hours").isNotNull())

    def _queue_rows(self, resource: str, start: date | None, end: date | None) -> DataFrame:
        return self._filtered(JobFilters(start=start, end=end)).where(F.col("queue").isin(*self.queues(resource)))

    def queues(self, resource: str) -> tuple[str, ...]:
        known = QUEUES.get(self.machine or "", QUEUES["derecho"])
        return known[resource] if resource in known else known["cpu"] + known["gpu"]

    @staticmethod
    def hours(resource: str) -> Column:
        if resource in ("cpu", "gpu"):
            return F.col(f"{resource}_hours")
        return F.coalesce("cpu_hours", F.lit(0)) + F.coalesce("gpu_hours", F.lit(0))

    def usage_by_group(self, resource: str, group_by: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """label, usage_hours and job_count; whatever isn't user groups by account."""
        group = F.col("user" if group_by == "user" else "account").alias("label")
        told = [F.coalesce(F.sum(self.hours(resource)), F.lit(0.0)).alias("usage_hours"), F.count(F.lit(1)).alias("job_count")]
        return self._report_rows(resource, start, end).groupBy(group).agg(*told).orderBy(F.desc("usage_hours"), "label")

    def usage_by_facility(self, resource: str, start: date | None = None, end: date | None = None) -> DataFrame:
        told = [F.coalesce(F.sum(self.hours(resource)), F.lit(0.0)).alias("usage_hours"), F.count(F.lit(1)).alias("job_count")]
        return self._report_rows(resource, start, end).groupBy(facility(F.col("account")).alias("facility")).agg(*told).orderBy(F.desc("usage_hours"), "facility")

    def _sized(self, rows: DataFrame, kind: str) -> DataFrame:
        value = {"gpu": F.col("numgpus"), "node": F.col("numnodes"), "core": F.col("numcpus"), "memory": F.col("reqmem") / float(buckets.GIB)}[kind]
        return rows.withColumn("range_label", buckets.range_label(value, kind))

    def job_waits(self, resource: str, kind: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """range_label, avg_wait_hours and job_count of jobs whose wait is known."""
        rows = self._sized(self._queue_rows(resource, start, end).where("eligible_secs is not null"), kind)
        told = rows.groupBy("range_label").agg(F.avg(F.col("eligible_secs") / 3600.0).alias("avg_wait_hours"), F.count(F.lit(1)).alias("job_count"))
        return told.orderBy(buckets.range_rank(F.col("range_label"), kind))

    def job_sizes(self, resource: str, kind: str, start: date | None = None, end: date | None = None) -> DataFrame:
        rows = self._sized(self._report_rows(resource, start, end), kind)
        told = rows.groupBy("range_label").agg(
            F.count(F.lit(1)).alias("job_count"), F.countDistinct("user").alias("user_count"), F.coalesce(F.sum(self.hours(resource)), F.lit(0.0)).alias("hours")
        )
        return told.orderBy(buckets.range_rank(F.col("range_label"), kind))

    def job_durations(self, resource: str, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        """Hours by run time: a row a period, a column a band."""
        bands = buckets.DIMENSIONS["duration"][0]
        label = buckets.band_label(F.col("elapsed"), bands)
        columns = [F.sum(F.when(label == b[0], self.hours(resource)).otherwise(0.0)).alias(b[0]) for b in bands]
        return self._report_rows(resource, start, end).groupBy(timewin.utc_label(F.col("end_ts"), period).alias("date")).agg(*columns).orderBy("date")

    def job_memory_per_rank(self, resource: str, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        """Hours by memory a rank: a row a period, a column a half-open band."""
        rank = F.try_divide(F.col("memory").cast("double"), (F.col("mpiprocs") * F.col("ompthreads") * F.col("numnodes")).cast("double"))
        columns, low = [], None
        for label, top in buckets.RANK_ENDS_MIB:
            inside = F.lit(True) if low is None else rank >= low
            if top is not None:
                inside = inside & (rank < top * 1024.0**2)
            columns.append(F.sum(F.when(inside, self.hours(resource)).otherwise(0.0)).alias(label))
            low = None if top is None else top * 1024.0**2
        return self._report_rows(resource, start, end).groupBy(timewin.utc_label(F.col("end_ts"), period).alias("date")).agg(*columns).orderBy("date")

    def usage_history(self, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        """Users, projects, jobs and hours a period of the stored clock, in one pass; CPU and GPU columns count charged jobs."""
        rows = self.jobs.where(F.col("end_ts").isNotNull() & timewin.in_utc_days(F.col("end_ts"), start, end))
        kinds = ("cpu", "gpu")
        # A row a period, user, account and kind first: distinct counts then work on that small table.
        small = rows.groupBy(
            timewin.utc_label(F.col("end_ts"), period).alias("date"), "user", "account",
            *[(F.col("queue").isin(*self.queues(k)) & F.col("cpu_hours").isNotNull()).alias(f"is_{k}") for k in kinds],
        ).agg(F.count(F.lit(1)).alias("jobs"), *[F.sum(f"{k}_hours").alias(f"{k}_sum") for k in kinds])
        told = [F.countDistinct("user").alias("users"), F.countDistinct("account").alias("projects")]
        for kind in kinds:
            mine = F.col(f"is_{kind}")
            told += [
                F.countDistinct(F.when(mine, F.col("user"))).alias(f"{kind}_users"), F.countDistinct(F.when(mine, F.col("account"))).alias(f"{kind}_projects"),
                F.coalesce(F.sum(F.when(mine, F.col("jobs"))), F.lit(0)).alias(f"{kind}_jobs"), F.coalesce(F.sum(F.when(mine, F.col(f"{kind}_sum"))), F.lit(0.0)).alias(f"{kind}_hours"),
            ]
        return small.groupBy("date").agg(*told).orderBy("date")

    def summary_of(self, dimension: str, value: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """One row: jobs, hours and elapsed of an account (with its users) or a user (with their accounts)."""
        other = "user" if dimension == "account" else "account"
        rows = self.jobs.where((F.col(dimension) == value) & timewin.in_utc_days(F.col("end_ts"), start, end) & F.col("cpu_hours").isNotNull())
        return rows.agg(
            F.count(F.lit(1)).alias("total_jobs"), F.coalesce(F.sum("elapsed"), F.lit(0)).alias("total_elapsed"),
            *[F.coalesce(F.sum(f"{h}_hours"), F.lit(0.0)).alias(f"total_{h}_hours") for h in ("cpu", "gpu", "memory")],
            F.concat_ws(",", F.sort_array(F.collect_set(other))).alias(f"{other}s"), F.concat_ws(",", F.sort_array(F.collect_set("queue"))).alias("queues"),
        )

    def by_entity_period(self, entity: str = "user", start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        """Jobs a period, user and account, ordered by the primary entity first."""
        first, second = ("user", "account") if entity == "user" else ("account", "user")
        rows = self._filtered(JobFilters(start=start, end=end)).where("end_ts is not null")
        return rows.groupBy(timewin.utc_label(F.col("end_ts"), period).alias("period"), "user", "account").agg(F.count(F.lit(1)).alias("job_count")).orderBy("period", first, second)

    def unique_by_period(self, entity: str, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        rows = self._filtered(JobFilters(start=start, end=end)).where("end_ts is not null")
        return rows.groupBy(timewin.utc_label(F.col("end_ts"), period).alias("period")).agg(F.countDistinct(entity).alias("n")).orderBy("period")

    def collapsed_history(self, entity: str, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
        """by_entity_period without the secondary entity."""
        return self.by_entity_period(entity, start, end, period).groupBy("period", entity).agg(F.sum("job_count").alias("job_count"))

    def top_users(self, start: date | None = None, end: date | None = None, limit: int = 10) -> DataFrame:
        rows = self.jobs.where(timewin.in_utc_days(F.col("end_ts"), start, end))
        return rows.groupBy("user").agg(F.count(F.lit(1)).alias("job_count")).orderBy(F.desc("job_count"), "user").limit(limit)

    def queue_statistics(self, start: date | None = None, end: date | None = None) -> DataFrame:
        rows = self.jobs.where(timewin.in_utc_days(F.col("end_ts"), start, end))
        return rows.groupBy("queue").agg(F.count(F.lit(1)).alias("job_count"), F.sum("elapsed").alias("total_elapsed"), F.avg("elapsed").alias("avg_elapsed")).orderBy("queue")

    def pie(self, resource: str, group_by: str, start: date | None = None, end: date | None = None, top: int = 14) -> DataFrame:
        """The largest groups with their share, and one row for all others."""
        grouped = self.usage_by_group(resource, group_by, start, end)
        # Groups are as many as users or accounts; only their sums are ranked here.
        place = F.row_number().over(Window.orderBy(F.desc("usage_hours"), "label"))
        named = grouped.withColumn("place", F.least(place, F.lit(top + 1)))
        folded = named.groupBy("place").agg(F.min("label").alias("one"), F.count(F.lit(1)).alias("groups"), F.sum("usage_hours").alias("usage_hours"), F.sum("job_count").alias("job_count"))
        label = F.when(F.col("place") > top, F.concat(F.lit("Others ("), F.col("groups").cast("string"), F.lit(")"))).otherwise(F.col("one"))
        whole = F.sum("usage_hours").over(Window.partitionBy())
        return folded.select("place", label.alias("label"), "usage_hours", "job_count", F.try_divide(F.col("usage_hours"), whole).alias("share"))

    def utilisation(self, kind: str, nodes: int, units_a_node: int, start: date, end: date, period: str = "day") -> DataFrame:
        """Used share of a machine's unit hours a period."""
        day_hours = {"day": 24.0, "month": 24.0 * 365 / 12, "year": 24.0 * 365}[period]
        return self.usage_history(start, end, period).select("date", (F.col(f"{kind}_hours") / (nodes * units_a_node * day_hours)).alias("utilisation"))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def fill_bands(rows: DataFrame, bands: list[dict], owners_limit: int = 0, owners_by: str = "user", sort_by: str = "job_count", sums: list[Column] | None = None) -> DataFrame:
    """Metrics of rows (with their period's first day) for every band in order; with owners, for each of the same owners."""
    spark = rows.sparkSession
    sums = sums or metrics()
    table = F.broadcast(spark.createDataFrame([(i, b["label"], b["period"]) for i, b in enumerate(bands)], "position int, label string, period date"))
    filled = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in METRICS]
    if not owners_limit:
        return table.join(rows.groupBy("period").agg(*sums), "period", "left").select("position", "label", *filled)
    owner = F.col(owners_by)
    grouped = rows.groupBy("period", owner.alias("owner")).agg(*sums)
    over_all = grouped.where("owner is not null").groupBy("owner").agg(*[F.sum(m).alias(m) for m in METRICS])
    top = over_all.orderBy(ranking(sort_by).desc(), "owner").limit(owners_limit).select("owner", F.lit(True).alias("listed"))
    folded = (
        grouped.join(F.broadcast(top), "owner", "left").withColumn("owner", F.when(F.col("listed"), F.col("owner")))
        .groupBy("period", "owner").agg(*[F.sum(m).alias(m) for m in METRICS])
    )
    named = top.select("owner").union(spark.createDataFrame([(None,)], "owner string"))
    # Bands and owners are bounded by the caps on both, so every pair of them is a small table.
    grid = named.select("owner", F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(b["label"]).alias("label"), F.lit(b["period"]).alias("period")) for i, b in enumerate(bands)])).alias("b")).select("owner", "b.*")
    same = (F.col("g.period") == F.col("f.period")) & F.col("g.owner").eqNullSafe(F.col("f.owner"))
    return grid.alias("g").join(folded.alias("f"), same, "left").select("g.position", "g.label", "g.owner", *[F.coalesce(F.col(f"f.{m}"), F.lit(0)).alias(m) for m in METRICS])


def list_qos(qos: DataFrame, active_only: bool = True) -> DataFrame:
    """Names of the qualities of service, in order."""
    return (qos.where("active") if active_only else qos).select("name").orderBy("name")
