"""Ingest of accounting logs as they appear, with the same end state as the batch sync."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.plans import ingest
from usagelens.sinks.commit import Change
from usagelens.sources.scheduler_log import parse

#: A log file, or the folder of a file's parts, is called by its day.
LOG_DAY = r"/(\d{8})(?:/[^/]*)?$"


def stream_logs(
    spark: SparkSession, folder: str, path: str, checkpoint: str, machine: str, summary: str | None = None, mode: str = "plain", files_a_batch: int | None = None,
) -> StreamingQuery:
    """Take new log files up into the job table at path, and the roll-up if one is named, a micro-batch at a time.

    A batch is what a sync of its files' days is: the index of keys tells known
    jobs of any earlier batch, so late and requeued records find theirs, and the
    roll-up of days that it has is renewed where late jobs end. All tables change
    by one commit; a batch that runs again after a lost driver finishes that
    commit, or does the same once more, and changes nothing the second time.
    """
    if mode not in ("plain", "upsert"):
        raise ValueError("a stream takes records up in plain or in upsert")
    reader = spark.readStream.format("text")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    lines = reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        change = Change(session, path + ingest.CHANGES)
        taken = ingest.take_up(change, parse(batch.withColumn("line", F.monotonically_increasing_id()), machine), path, machine, mode)
        if summary is not None:
            # A row a file of the batch at most.
            names = batch.select(F.regexp_extract("file", LOG_DAY, 1).alias("day")).where("day <> ''").distinct().collect()
            days = {datetime.strptime(r.day, "%Y%m%d").date() for r in names}
            ingest.put_summary(change, taken.jobs, sorted(days | ingest.summarized(session, summary, machine, taken.days)), machine, summary)
        change.commit()

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
