"""Import of scan logs: from log files of a collection to its stored directory tables.

A collection has a partition (filesystem) in each table below a root: directories,
histograms of files as a whole and by directory, summaries of owners and of groups,
and the scan itself. An import replaces the collection's partitions by one commit
and leaves the others. Directories, and their histograms, lie in ranges of paths,
sorted, so that a path prefix prunes files by their minima and maxima.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.directories import DirectoryQueries
from usagelens.plans import tree
from usagelens.session import stored
from usagelens.sinks.commit import Change, file_system, recover
from usagelens.sources import scan_log

TABLES = ("directories", "histograms", "directory_histograms", "owner_uid_summary", "owner_gid_summary", "scans")
CHANGES = "changes"


def import_entries(entries: DataFrame, root: str, filesystem: str, scanned: datetime | None, source: str = "") -> None:
    """Store the tables of a collection from its entries. Without a scan date all files count as oldest."""
    entries = stored(entries)
    at = F.lit(None if scanned is None else scanned.isoformat(" ")).cast("timestamp_ntz")
    dirs = stored(tree.directories(entries))
    by_path = lambda rows: rows.repartitionByRange("path").sortWithinPartitions("path")
    tables = {
        "directories": by_path(dirs), "histograms": tree.file_histograms(entries, at).coalesce(1), "directory_histograms": by_path(tree.directory_histograms(entries, at)),
        "owner_uid_summary": tree.entity_summary(dirs, "owner_uid"), "owner_gid_summary": tree.entity_summary(dirs, "owner_gid"),
        "scans": tree.scan_metadata(entries, source, at, filesystem),
    }
    change = Change(entries.sparkSession, f"{root}/{CHANGES}")
    for name in TABLES:
        change.put(tables[name].drop("filesystem").withColumn("filesystem", F.lit(filesystem)), f"{root}/{name}", "filesystem")
    change.commit()


def import_scan(spark: SparkSession, logs: str, root: str, filesystem: str | None = None, kind: str | None = None, scanned: datetime | None = None) -> str:
    """Read a scan log (a file, or a folder of parts called by the scan) and store its collection's tables; the collection is returned.

    Format, collection and scan date are told by the name unless given.
    """
    name = logs.rstrip("/").rsplit("/", 1)[-1]
    told = spark.range(1).select(scan_log.file_system(F.lit(name)).alias("filesystem"), scan_log.scan_date(F.lit(name)).alias("scanned")).first()
    filesystem = filesystem or told["filesystem"]
    if not filesystem:
        raise ValueError(f"{name} tells no collection")
    parse = scan_log.FORMATS[kind or scan_log.detect(name)].parse
    import_entries(parse(scan_log.read_lines(spark, logs)), root, filesystem, scanned or told["scanned"], name)
    return filesystem


def open_collections(spark: SparkSession, root: str, names: DataFrame | None = None, groups: DataFrame | None = None) -> DirectoryQueries:
    """Questions about all collections stored below a root, after what a lost driver has left undone."""
    recover(spark, f"{root}/{CHANGES}")
    read = lambda table: spark.read.parquet(f"{root}/{table}").withColumn("filesystem", F.col("filesystem").cast("string"))
    fs, path = file_system(spark, root)
    by_directory = read("directory_histograms") if fs.exists(path(f"{root}/directory_histograms")) else None
    return DirectoryQueries(read("directories"), read("scans"), read("histograms"), names, groups, by_directory)
