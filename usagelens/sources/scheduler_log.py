"""Scheduler accounting logs: one text file a day, one record a line.

A line is time;type;job id;key=value ...; records of type E become job rows.
Everything is a column expression over spark.read.text; a record's pairs are split once.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.session import once

# Hardware by queue, and a machine's CPU type where nothing else tells.
QUEUE_GPUS = {"a100": "a100", "h100": "h100", "l40": "l40", "nvgpu": "v100"}
MACHINE_CPU = {"derecho": "milan"}
EPOCH = "1970-01-01 00:00:00"
# What is read of a record.
ATTRIBUTES = (
    "user", "account", "queue", "jobname", "Exit_status", "run_count", "eligible_time", "ctime", "qtime", "etime", "start", "end",
    "Resource_List.select", "Resource_List.ncpus", "Resource_List.ngpus", "Resource_List.nodect", "Resource_List.mem", "Resource_List.walltime",
    "Resource_List.mpiprocs", "Resource_List.job_priority", "resources_used.walltime", "resources_used.mem", "resources_used.vmem",
)


def read_days(spark: SparkSession, folder: str, days: Iterable[date]) -> DataFrame:
    """Lines of the days' files (YYYYMMDD), with the file they are from and their place in it."""
    paths = [f"{folder}/{d:%Y%m%d}" for d in days]
    rows = spark.read.text(paths)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def days_with_logs(spark: SparkSession, folder: str, days: Iterable[date]) -> set[date]:
    """Those of the days that have a file, or a folder of parts; the folder is listed, nothing read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = {s.getPath().getName() for s in listed}
    return {d for d in days if f"{d:%Y%m%d}" in names}


def attribute(key: str) -> Column:
    """The last value of a key in a record split by `told`, null if it has none."""
    return F.col("told")[ATTRIBUTES.index(key)]


def with_pairs(records: DataFrame, pair: str = r'(?:^|\s)([^\s=]+)=("[^"]*"|\S*)') -> DataFrame:
    """records with pairs (names and values, from the last to the first) of their attributes: what the pattern finds.

    A record without spaces in quotes is what its words are; only others take the pattern, which is slow.
    """
    text, words = F.col("attributes"), F.col("words")
    blank = reduce(or_, [text.contains(c) for c in "\t\n\x0b\f\r"])
    odd = F.exists(words, lambda w: w.startswith("=") | (w.contains('"') & ~w.rlike('^[^="]+="[^"]*"$')))
    own = F.filter(words, lambda w: w.contains("="))
    names, values = F.transform(own, lambda w: F.substring_index(w, "=", 1)), F.transform(own, lambda w: F.substr(w, F.instr(w, "=") + 1))
    found = [F.reverse(F.when(F.col("plain"), quick).otherwise(F.regexp_extract_all(text, F.lit(pair), F.lit(i)))) for i, quick in ((1, names), (2, values))]
    split = records.select("*", once(F.split("attributes", " ")).alias("words")).select("*", once(~(blank | odd)).alias("plain"))
    return split.select("*", once(F.struct(found[0].alias("names"), found[1].alias("values"))).alias("pairs")).drop("words", "plain")


def last_of(key: Column) -> Column:
    """The value of a key's last pair."""
    return F.get("pairs.values", F.nullif(F.array_position("pairs.names", key), F.lit(0)) - 1)


def told() -> Column:
    """The values of ATTRIBUTES, in their order."""
    return F.array(*[last_of(F.lit(k)) for k in ATTRIBUTES])


def seconds(text: Column) -> Column:
    """HH:MM:SS or bare seconds; anything else is null."""
    parts = F.split(text, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(F.size(parts) == 1, number(0)).cast("int")


def kilobytes(text: Column) -> Column:
    """Bytes of a size in kb; the unit's letters are taken off in any number."""
    return F.regexp_replace(F.lower(text), "[kb]+$", "").try_cast("bigint") * 1024


def gigabytes(text: Column) -> Column:
    """Bytes of a size in gb; a size in another unit is null."""
    return (F.regexp_replace(F.lower(text), "[gb]+$", "").try_cast("double") * float(1024**3)).cast("bigint")


def moment(text: Column) -> Column:
    """Naive UTC of epoch seconds; an empty text is null, 0 is 1970."""
    value = F.when(text != "", text.try_cast("bigint"))
    return F.timestamp_seconds(value).cast("timestamp_ntz")


def selected(select: Column, key: str) -> Column:
    """A key of a resource selection; of repeated keys the last."""
    found = F.regexp_extract_all(select, F.lit(rf"(?:^|[:+]){key}=([^:+]*)"), F.lit(1))
    return F.element_at(F.when(F.size(found) > 0, found), -1)


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, told in table.items():
        out = out.when(value == key, F.lit(told))
    return out.otherwise(F.lit(None).cast("string"))


def of_ended(lines: DataFrame) -> DataFrame:
    """lines of E records with their job_id and attributes."""
    split, fields = lines.select("*", once(F.split("value", ";", 4)).alias("fields")), F.col("fields")
    return split.where((F.size(fields) == 4) & (fields[1] == "E")).select(*lines.columns, fields[2].alias("job_id"), fields[3].alias("attributes"))


def parse(lines: DataFrame, machine: str) -> DataFrame:
    """Job rows of the E records among lines (value, and any further columns)."""
    records = with_pairs(of_ended(lines)).select("*", once(told()).alias("told"))
    select = F.coalesce(attribute("Resource_List.select"), F.lit(""))
    own = {k: attribute(k) for k in ("user", "account", "queue", "jobname", "Exit_status", "run_count", "eligible_time")}
    listed = {k: attribute(f"Resource_List.{k}") for k in ("ncpus", "ngpus", "nodect", "mem", "walltime", "mpiprocs", "job_priority")}
    cpu, gpu = selected(select, "cpu_type"), selected(select, "gpu_type")
    untold = cpu.isNull() & gpu.isNull()
    start, eligible, submit, end = (moment(attribute(k)) for k in ("start", "etime", "ctime", "end"))
    elapsed = seconds(attribute("resources_used.walltime"))
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    kept = [c for c in lines.columns if c != "value"]
    return records.select(
        *kept, "job_id", F.regexp_extract("job_id", r"^(\d+)", 1).try_cast("bigint").alias("short_id"), own["jobname"].alias("name"),
        own["user"].alias("user"), F.coalesce(F.regexp_replace(own["account"], '^"(.*)"$', "$1"), F.lit("none")).alias("account"),
        own["queue"].alias("queue"), own["Exit_status"].alias("status"), submit.alias("submit"), moment(attribute("qtime")).alias("queued"),
        F.when((eligible == epoch) & submit.isNotNull(), submit).otherwise(eligible).alias("eligible"),
        F.when((start == epoch) & end.isNotNull() & elapsed.isNotNull(), end - F.make_dt_interval(secs=elapsed)).otherwise(start).alias("start"),
        end.alias("end_ts"), seconds(listed["walltime"]).alias("walltime"), elapsed.alias("elapsed"), seconds(own["eligible_time"]).alias("eligible_secs"),
        own["run_count"].try_cast("int").alias("run_count"), listed["ncpus"].try_cast("int").alias("numcpus"), listed["ngpus"].try_cast("int").alias("numgpus"),
        listed["nodect"].try_cast("int").alias("numnodes"),
        F.coalesce(selected(select, "mpiprocs").try_cast("int"), listed["mpiprocs"].try_cast("int")).alias("mpiprocs"),
        selected(select, "ompthreads").try_cast("int").alias("ompthreads"), gigabytes(listed["mem"]).alias("reqmem"),
        kilobytes(attribute("resources_used.mem")).alias("memory"), kilobytes(attribute("resources_used.vmem")).alias("vmemory"),
        listed["job_priority"].alias("priority"),
        F.when(untold, F.lit(MACHINE_CPU.get(machine)).cast("string")).otherwise(cpu).alias("cputype"),
        F.when(untold, _mapped(own["queue"], QUEUE_GPUS)).otherwise(gpu).alias("gputype"), select.alias("resources"), F.lit(machine).alias("machine"),
    )


def times_in_order() -> Column:
    """Whether a job's times, where all are known, stand in order."""
    known = F.col("submit").isNotNull() & F.col("eligible").isNotNull() & F.col("start").isNotNull() & F.col("end_ts").isNotNull()
    ordered = (F.col("submit") <= F.col("eligible")) & (F.col("eligible") <= F.col("start")) & (F.col("start") <= F.col("end_ts"))
    return ~known | F.coalesce(ordered, F.lit(False))


def in_order(jobs: DataFrame) -> DataFrame:
    return jobs.where(times_in_order())


def first_of_each(jobs: DataFrame, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """One row a job id and submit time: the first in the logs."""
    place = F.row_number().over(Window.partitionBy("job_id", "submit").orderBy(*order))
    return jobs.withColumn("place", place).where("place = 1").drop("place")
