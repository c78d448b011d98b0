"""From scan entries to directory tables: own statistics, recursive roll-up, summaries and histograms.

Paths are kept as text: a directory's ancestors are its path's prefixes, so the
recursive roll-up is one explode of pre-aggregated directories and one grouped
sum, without iteration by depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.buckets import atime_bucket, size_bucket
from usagelens.session import stored

NO_FILES, ANCESTOR_LEVELS = -1, 9


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def one_owner(files: Column, low: Column, high: Column) -> Column:
    """-1 without files, the owner if there is one, null if there are several."""
    return F.when(F.coalesce(files, F.lit(0)) == 0, F.lit(NO_FILES).cast("bigint")).when(low == high, low)


def own_stats(entries: DataFrame) -> DataFrame:
    """A row a directory: counts, bytes, newest access and owners of what stands directly in it."""
    dirs = entries.where("is_dir").select("path").distinct()
    files = entries.where("not is_dir").groupBy(parent_of(F.col("path")).alias("path")).agg(
        F.count(F.lit(1)).alias("file_count_nr"), F.sum("allocated").alias("total_size_nr"), F.max("atime").alias("max_atime_nr"),
        F.min("uid").alias("min_uid"), F.max("uid").alias("max_uid"), F.min("gid").alias("min_gid"), F.max("gid").alias("max_gid"),
    )
    inner = dirs.groupBy(parent_of(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("dir_count_nr"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return dirs.join(files, "path", "left").join(inner, "path", "left").select(
        "path", zero("file_count_nr"), zero("total_size_nr"), zero("dir_count_nr"), "max_atime_nr", "min_uid", "max_uid", "min_gid", "max_gid"
    )


def with_recursion(own: DataFrame) -> DataFrame:
    """own with recursive columns: every directory counts for itself and each directory above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rolled = own.select(F.explode(above).alias("path"), *[c for c in own.columns if c != "path"]).groupBy("path").agg(
        F.sum("file_count_nr").alias("file_count_r"), F.sum("total_size_nr").alias("total_size_r"), F.sum("dir_count_nr").alias("dir_count_r"),
        F.max("max_atime_nr").alias("max_atime_r"), F.min("min_uid").alias("min_uid_r"), F.max("max_uid").alias("max_uid_r"),
        F.min("min_gid").alias("min_gid_r"), F.max("max_gid").alias("max_gid_r"),
    )
    return own.join(rolled, "path")


def directories(entries: DataFrame) -> DataFrame:
    """The directory table: ids by depth and path, parents, both kinds of statistics, single owners, ancestors by level."""
    stats = with_recursion(own_stats(entries)).withColumn("depth", F.size(F.split("path", "/")) - 1)
    # Ids ascend by depth, then path; they are dealt a range of paths at a time.
    # The ranges are stored once: sizes and places must be told from the same ones, also after a lost executor.
    ranged = stored(stats.repartitionByRange("depth", "path").withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part").orderBy("depth", "path"))
    sizes = ranged.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    numbered = ranged.withColumn("place", place).join(F.broadcast(first), "part").withColumn("dir_id", F.col("first") + F.col("place") - 1)
    ids = numbered.select(F.col("path").alias("parent_path"), F.col("dir_id").alias("parent_id"))
    # One number from the entries' directories: the level that ancestor columns count from.
    top = entries.where("is_dir").agg(F.min(F.size(F.split("path", "/")) - 1)).first()[0] or 0
    parts = F.split("path", "/")
    ancestors = [
        F.when(F.col("depth") >= top + k, F.array_join(F.slice(parts, 1, top + k + 1), "/")).alias(f"anc_d{k + 1}")
        for k in range(ANCESTOR_LEVELS)
    ]
    return (
        numbered.withColumn("parent_path", parent_of(F.col("path"))).join(ids, "parent_path", "left")
        .select(
            "dir_id", "parent_id", name_of(F.col("path")).alias("name"), "path", "depth",
            "file_count_nr", "total_size_nr", "dir_count_nr", "max_atime_nr", "file_count_r", "total_size_r", "dir_count_r", "max_atime_r",
            one_owner(F.col("file_count_r"), F.col("min_uid_r"), F.col("max_uid_r")).alias("owner_uid"),
            one_owner(F.col("file_count_r"), F.col("min_gid_r"), F.col("max_gid_r")).alias("owner_gid"), *ancestors,
        )
    )


def entity_summary(dirs: DataFrame, entity: str) -> DataFrame:
    """Bytes, files and directories of each single owner (owner_uid) or group (owner_gid)."""
    return dirs.where(F.col(entity) >= 0).groupBy(entity).agg(
        F.sum("total_size_nr").alias("total_size"), F.sum("file_count_nr").alias("total_files"), F.count(F.lit(1)).alias("directory_count")
    )


def file_histograms(entries: DataFrame, scan_date: Column, *keys: Column) -> DataFrame:
    """kind, owner_uid, bucket_index, file_count and total_size: each file by access age and by size, and by further keys."""
    kinds = F.explode(F.array(
        F.struct(F.lit("access").alias("kind"), atime_bucket(F.col("atime"), scan_date).alias("bucket_index")),
        F.struct(F.lit("size").alias("kind"), size_bucket(F.col("allocated")).alias("bucket_index")),
    ))
    files = entries.where("not is_dir").select(*keys, F.col("uid").alias("owner_uid"), "allocated", kinds.alias("k"))
    return files.groupBy(*files.columns[: len(keys)], "k.kind", "owner_uid", "k.bucket_index").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("allocated").alias("total_size")
    )


def directory_histograms(entries: DataFrame, scan_date: Column) -> DataFrame:
    """The same by path: of the files directly in a directory (_nr) and of all below it (_r), for every directory above a file.

    Files are counted by directory before they are told to the directories above, so bands and owners, which are few,
    are what is shuffled.
    """
    by_dir = file_histograms(entries, scan_date, parent_of(F.col("path")).alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = by_dir.withColumnRenamed("path", "own_path").withColumn("path", F.col("own_path")).withColumn("path", F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array("path"))))
    directly = F.col("path") == F.col("own_path")
    zero = F.lit(0).cast("bigint")
    return own.groupBy("path", "kind", "owner_uid", "bucket_index").agg(
        F.sum(F.when(directly, F.col("file_count")).otherwise(zero)).alias("file_count_nr"), F.sum(F.when(directly, F.col("total_size")).otherwise(zero)).alias("total_size_nr"),
        F.sum("file_count").alias("file_count_r"), F.sum("total_size").alias("total_size_r"),
    )


def scan_metadata(entries: DataFrame, source: str, scanned: Column, filesystem: str) -> DataFrame:
    files = ~F.col("is_dir")
    return entries.agg(
        F.count(F.when(F.col("is_dir"), 1)).alias("total_directories"), F.count(F.when(files, 1)).alias("total_files"),
        F.coalesce(F.sum(F.when(files, F.col("allocated"))), F.lit(0)).alias("total_size"),
    ).select(F.lit(source).alias("source_file"), scanned.alias("scan_timestamp"), F.lit(filesystem).alias("filesystem"), "*")
