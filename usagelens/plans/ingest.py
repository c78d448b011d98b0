"""Sync of parsed job records into the job table (Parquet partitioned by machine and UTC end day).

A job is told by its id and submit time and stands in the table once, wherever
its records end: a requeued job has several. Beside the table stands an index of
keys, partitioned by submit day: a sync reads only the days on which its records
were submitted there, and learns which jobs are known and in which partitions
they stand. Only partitions that get new jobs, or in an upsert hold known ones,
are read and rewritten; jobs, keys and roll-up are replaced by one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.charging import charged
from usagelens.functions.timewin import SITE_ZONE, in_site_days, site_day
from usagelens.plans import distinct, rollup
from usagelens.session import stored
from usagelens.sinks.commit import Change, file_system, recover
from usagelens.sources.scheduler_log import days_with_logs, first_of_each, in_order, parse, read_days, times_in_order

KEY = ("job_id", "submit")
# The fields a later record of a job may change.
UPDATABLE = ("priority", "eligible_secs", "run_count", "cputype", "gputype", "resources", "reqmem", "memory", "vmemory", "mpiprocs", "ompthreads", "walltime")
CHARGES = ("cpu_hours", "gpu_hours", "memory_hours", "qos", "qos_factor", "charge_version")
#: Beside a job table's folder: the index of its keys, and changes under way.
KEYS, CHANGES = "-keys", "-changes"
MODES = ("plain", "upsert", "incremental", "resummarize", "recalculate")


def _same(left: str, right: str):
    return (F.col(f"{left}.job_id") == F.col(f"{right}.job_id")) & F.col(f"{left}.submit").eqNullSafe(F.col(f"{right}.submit"))


def clean(records: DataFrame) -> DataFrame:
    """Records in time order, the first of each job."""
    return first_of_each(in_order(records)).drop("file", "line")


def clean_for_upsert(records: DataFrame) -> DataFrame:
    """Records in time order, one a job as if its log files were taken up one after another: the first, with the updatable fields of its last file's first."""
    ordered = in_order(records)
    fields = [c for c in UPDATABLE if c in ordered.columns]
    told = ordered.select(*KEY, "file", "line", F.struct(*fields).alias("last"))
    first_of_files = F.row_number().over(Window.partitionBy(*KEY, "file").orderBy("line"))
    last = told.withColumn("place", first_of_files).where("place = 1").groupBy(*KEY).agg(F.max_by("last", "file").alias("last"))
    joined = first_of_each(ordered).drop("file", "line").alias("r").join(last.alias("l"), _same("r", "l"))
    return joined.select("r.*", "l.last").withColumns({c: F.col(f"last.{c}") for c in fields}).drop("last")


def rejected(records: DataFrame) -> DataFrame:
    """How many records are dropped for their times."""
    return records.agg(F.count(F.when(~times_in_order(), 1)).alias("rejected"))


def added(existing: DataFrame, new: DataFrame, machine: str) -> DataFrame:
    """existing with the new jobs it lacks, charged; what it has stays as it is."""
    fresh = new.alias("n").join(existing.alias("e"), _same("n", "e"), "left_anti")
    return existing.unionByName(charged(fresh, machine), allowMissingColumns=True)


def upserted(existing: DataFrame, new: DataFrame, machine: str) -> DataFrame:
    """existing with new jobs added and the updatable fields of known ones replaced; updated jobs are charged anew."""
    fields = [c for c in UPDATABLE if c in new.columns and c in existing.columns]
    told = new.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("known"))
    joined = existing.alias("e").join(told.alias("n"), _same("e", "n"), "left")
    kept = joined.select("known", *[
        F.when(F.col("known"), F.col(f"n.new_{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in fields else F.col(f"e.{c}").alias(c) for c in existing.columns
    ])
    again = charged(kept.where("known").drop("known", *[c for c in CHARGES if c in kept.columns]), machine)
    merged = kept.where("known is null").drop("known").unionByName(again, allowMissingColumns=True)
    return added(merged, new, machine)


def with_missing_charges(jobs: DataFrame, machine: str) -> DataFrame:
    """jobs with charges where they have none or a placeholder (version 0)."""
    lacks = F.col("charge_version").isNull() | (F.col("charge_version") == 0)
    again = charged(jobs.where(lacks).drop(*CHARGES), machine)
    return jobs.where(~lacks).unionByName(again, allowMissingColumns=True)


def recalculated(jobs: DataFrame, machine: str, start: date | None = None, end: date | None = None, zone: str = SITE_ZONE) -> DataFrame:
    """jobs with the charges of a window of site days computed anew."""
    inside = F.coalesce(in_site_days(F.col("end_ts"), start, end, zone), F.lit(False))
    return jobs.where(~inside).unionByName(charged(jobs.where(inside).drop(*CHARGES), machine), allowMissingColumns=True)


def sync(existing: DataFrame, records: DataFrame | None, machine: str, mode: str = "plain", start: date | None = None, end: date | None = None,
         summary: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The job table and roll-up after a sync. Incremental leaves days alone that the roll-up already has."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "recalculate":
        jobs = recalculated(existing, machine, start, end)
    elif mode == "resummarize":
        jobs = existing
    else:
        new = clean(records)
        if mode == "incremental" and summary is not None:
            new = new.withColumn("date", site_day(F.col("end_ts"))).join(rollup.summarized_days(summary), "date", "left_anti").drop("date")
        jobs = (upserted if mode == "upsert" else added)(existing, new, machine)
    if start is None or end is None:
        return jobs, summary
    fresh = rollup.daily_summary(jobs, start, end)
    if summary is None:
        return jobs, fresh
    outside = (F.col("date") < F.lit(start)) | (F.col("date") > F.lit(end))
    return jobs, summary.where(outside).unionByName(fresh)


def _partitioned(jobs: DataFrame) -> DataFrame:
    """A day's rows go to few files, large days to several, sorted by user for min/max skipping."""
    by_day = jobs.withColumn("end_date", F.to_date("end_ts")).hint("rebalance", "machine", "end_date")
    return by_day.sortWithinPartitions("machine", "end_date", "user")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Write whole partitions; others stay. The index of keys goes, so the next sync makes it anew."""
    fs, where = file_system(jobs.sparkSession, path)
    fs.delete(where(path + KEYS), True)
    _partitioned(jobs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("machine", "end_date").parquet(path)


def _stored(spark: SparkSession, path: str, machine: str | None) -> DataFrame | None:
    """A machine's partitions of a stored table; None before it is first written."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows if machine is None else rows.where(F.col("machine") == machine)


def open_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The stored job table, after what a lost driver has left undone."""
    recover(spark, path + CHANGES)
    return spark.read.parquet(path)


def _among(column: str, days: set[date | None]) -> Column:
    """Whether a partition's day is one of some, of which one may be null."""
    known = F.col(column).isin([d for d in days if d is not None])
    return known | F.col(column).isNull() if None in days else F.coalesce(known, F.lit(False))


def _days(rows: DataFrame, day: Column) -> set[date | None]:
    """Distinct days: as many as there are partitions to read."""
    return {r[0] for r in rows.select(day).distinct().collect()}


def _keys(jobs: DataFrame) -> DataFrame:
    return jobs.select("machine", *KEY, "end_ts", F.to_date("submit").alias("submit_date"))


def _index(spark: SparkSession, path: str, machine: str) -> DataFrame | None:
    """The keys of a machine's stored jobs; made from the whole table once, where it was written without them."""
    index, jobs = _stored(spark, path + KEYS, machine), _stored(spark, path, None)
    if index is None and jobs is not None:
        change = Change(spark, path + CHANGES)
        change.put(_keys(jobs).hint("rebalance", "machine", "submit_date"), path + KEYS, "machine", "submit_date")
        change.commit()
        index = _stored(spark, path + KEYS, machine)
    return index


@dataclass(frozen=True)
class Taken:
    """The machine's job table as it will be, and the site days on which jobs come in or change."""

    jobs: DataFrame
    days: set[date]


def take_up(change: Change, records: DataFrame, path: str, machine: str, mode: str) -> Taken:
    """Stage the partitions of jobs and keys that records change: jobs the index lacks come in, in an upsert those it has change."""
    spark, upsert = change.spark, mode == "upsert"
    new = stored((clean_for_upsert if upsert else clean)(records))
    table, index = _stored(spark, path, machine), _index(spark, path, machine)
    if table is None or index is None:
        fresh, changed = new, new.limit(0)
    else:
        held = index.where(_among("submit_date", _days(new, F.to_date("submit"))))
        known = stored(new.select(*KEY).alias("n").join(held.alias("h"), _same("n", "h")).select("h.job_id", "h.submit", "h.end_ts"))
        fresh = new.alias("n").join(known.alias("h"), _same("n", "h"), "left_anti")
        changed = known if upsert else known.limit(0)
    coming = fresh.select("end_ts").unionByName(changed.select("end_ts"))
    touched = _days(coming, F.to_date("end_ts"))
    if not touched:
        return Taken(charged(fresh, machine).withColumn("end_date", F.to_date("end_ts")) if table is None else table, set())
    if table is None:
        after, rest = charged(fresh, machine), None
    else:
        own, rest = table.where(_among("end_date", touched)).drop("end_date"), table.where(~_among("end_date", touched))
        after = upserted(own, new, machine) if upsert else own.unionByName(charged(fresh, machine), allowMissingColumns=True)
    staged = spark.read.parquet(change.put(_partitioned(after), path, "machine", "end_date"))
    keys, submitted = _keys(fresh), _days(fresh, F.to_date("submit"))
    if index is not None:
        keys = index.where(_among("submit_date", submitted)).select(*keys.columns).unionByName(keys)
    change.put(keys.hint("rebalance", "machine", "submit_date"), path + KEYS, "machine", "submit_date")
    days = {d for d in _days(coming, site_day(F.col("end_ts"))) if d is not None}
    return Taken(staged if rest is None else rest.unionByName(staged, allowMissingColumns=True), days)


def put_summary(change: Change, jobs: DataFrame, days: list[date], machine: str, path: str) -> None:
    """Stage the roll-up's days, a partition each, and with them the bitmaps of their names and the numbers of new ones."""
    parts = [(_ending(jobs, first, last + timedelta(days=1)), first, last) for first, last in rollup.contiguous(days)]
    if not parts:
        return
    own = F.lit(machine).alias("machine")
    rows = reduce(DataFrame.unionByName, [rollup.daily_summary(*p) for p in parts])
    change.put(rows.select("*", own).repartition("date"), path, "machine", "date")
    named = [distinct.names_by_day(j.where(in_site_days(F.col("end_ts"), first, last))) for j, first, last in parts]
    daily, known = stored(reduce(DataFrame.unionByName, named)), _stored(change.spark, path + distinct.NAMES, machine)
    new = stored(distinct.new_numbers(daily, known))
    if not new.isEmpty():
        # Numbers are only ever added: a partition a change.
        change.put(new.select("*", own, F.lit(uuid.uuid4().hex).alias("added")), path + distinct.NAMES, "machine", "added")
    columns = ["kind", "name", "id"]
    dictionary = new if known is None else known.select(columns).unionByName(new.select(columns))
    bitmaps = distinct.day_bitmaps(daily, dictionary).select("*", own)
    if not daily.isEmpty():
        change.put(bitmaps.repartition("date"), path + distinct.BITMAPS, "machine", "date")


def summarized(spark: SparkSession, path: str, machine: str, days: Iterable[date]) -> set[date]:
    """Those of some days that the stored roll-up has."""
    had = _stored(spark, path, machine)
    return set() if had is None else {r.date for r in rollup.summarized_days(had.where(F.col("date").isin(list(days)))).collect()}


@dataclass(frozen=True)
class Synced:
    read: list[date]
    skipped: list[date]
    failed: list[date]


def sync_days(spark: SparkSession, logs: str, jobs: str, summary: str, machine: str, start: date, end: date, mode: str = "plain") -> Synced:
    """Bring the stored job table and roll-up up to date with the log files of the days start to end.

    Incremental leaves days alone that the roll-up has. A day without a log file
    fails: it gets no roll-up, so a later run takes it up; a day whose file has no
    jobs gets its marker. Days synced apart or together give the same tables. The
    roll-up of other days that it has is renewed where jobs come in or change;
    recalculate and resummarize read no logs.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
    change = Change(spark, jobs + CHANGES)
    after, skipped, failed, renewed = _stored(spark, jobs, machine), [], [], set(days)
    if mode == "recalculate":
        if after is not None:
            first, last = start - timedelta(days=1), end + timedelta(days=1)
            around = F.coalesce(F.col("end_date").between(F.lit(first), F.lit(last)), F.lit(False))
            inside = recalculated(after.where(around).drop("end_date"), machine, start, end)
            if not inside.limit(1).isEmpty():
                after = after.where(~around).unionByName(spark.read.parquet(change.put(_partitioned(inside), jobs, "machine", "end_date")), allowMissingColumns=True)
    elif mode != "resummarize":
        done = summarized(spark, summary, machine, days) if mode == "incremental" else set()
        there = days_with_logs(spark, logs, days)
        skipped = [d for d in days if d in done]
        failed = [d for d in days if d not in done and d not in there]
        days = [d for d in days if d not in done and d in there]
        if days:
            taken = take_up(change, parse(read_days(spark, logs, days), machine), jobs, machine, mode)
            after = taken.jobs
            renewed = set(days) | summarized(spark, summary, machine, taken.days)
        else:
            renewed = set()
    if after is not None:
        put_summary(change, after, sorted(renewed), machine, summary)
    change.commit()
    return Synced(days, skipped, failed)


def _ending(jobs: DataFrame, first: date, last: date) -> DataFrame:
    """Stored jobs of UTC end days: whole partitions."""
    return jobs.where(F.col("end_date").between(F.lit(first), F.lit(last)))
