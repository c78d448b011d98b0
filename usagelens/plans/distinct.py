"""Distinct users, accounts and queues of any window, from exact bitmaps a day instead of jobs.

A dictionary gives every name a number, from 1 on without gaps for each kind. New
names get the numbers after the last, and none is ever numbered anew, so bitmaps
of different days and syncs can be united. A day's bitmap has the bits of the
names its jobs have, in buckets of 32,768 numbers; a window's distinct count is
the bits of its days' united bitmaps. Days are kept by site day, by which windows
are cut, and by the day of the stored clock, by which reports are labelled.

Cases: jobs without an end time are in no day; a name that is null has no number
and no bit, but its day is kept, with nobody in it; an empty table gives no rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions import timewin
from usagelens.session import stored

KINDS = ("user", "account", "queue")
#: Beside a roll-up's folder: the dictionary and the bitmaps.
NAMES, BITMAPS = "-names", "-distinct"


def names_by_day(jobs: DataFrame, zone: str = timewin.SITE_ZONE) -> DataFrame:
    """date (site day), utc_date, kind and name of the jobs, each once."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in KINDS])).alias("k")
    days = [timewin.site_day(F.col("end_ts"), zone).alias("date"), F.to_date("end_ts").alias("utc_date")]
    return jobs.where("end_ts IS NOT NULL").select(*days, kinds).select("date", "utc_date", "k.kind", "k.name").distinct()


def new_numbers(daily: DataFrame, known: DataFrame | None) -> DataFrame:
    """kind, name and id of the names that the dictionary lacks, numbered after its last."""
    names = daily.where("name IS NOT NULL").select("kind", "name").distinct()
    last = {}
    if known is not None:
        names = names.join(known.select("kind", "name"), ["kind", "name"], "left_anti")
        last = {r.kind: r.last for r in known.groupBy("kind").agg(F.max("id").alias("last")).collect()}  # a row a kind
    ranged = stored(names.repartitionByRange("kind", "name").withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part", "kind").orderBy("name"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("part", "kind").count().select("part", "kind", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # a row a range and kind
    start = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in last.items()], F.lit(0)).cast("bigint")
    numbered = ranged.withColumn("place", place).join(F.broadcast(first), ["part", "kind"])
    return numbered.select("kind", "name", (start + F.col("first") + F.col("place")).alias("id"))


def day_bitmaps(daily: DataFrame, dictionary: DataFrame) -> DataFrame:
    """date, utc_date, kind, bucket and bitmap."""
    told = daily.join(dictionary.select("kind", "name", "id"), ["kind", "name"], "left")
    bucket = F.coalesce(F.bitmap_bucket_number("id"), F.lit(1).cast("bigint")).alias("bucket")
    return told.groupBy("date", "utc_date", "kind", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def unique_by_period(bitmaps: DataFrame, kind: str, start: date | None = None, end: date | None = None, period: str = "day") -> DataFrame:
    """period and n, as counted from jobs of the site days start to end, of users, accounts or queues."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rows = bitmaps.where(F.col("kind") == kind)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    label = timewin.utc_label(F.col("utc_date").cast("timestamp_ntz"), period).alias("period")
    united = rows.groupBy(label, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return united.groupBy("period").agg(F.sum(F.bitmap_count("bitmap")).alias("n")).orderBy("period")
