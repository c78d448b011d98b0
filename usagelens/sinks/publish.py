"""Replacing a whole table: written beside it first, then put in its place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def publish(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a catalog table by df and compute its statistics.

    The new rows are written to a staging table first, so a job that fails on
    the way leaves the old table as it is; renames swap the two.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:8]
    staging, old = f"{table}_{mark}_staging", f"{table}_{mark}_old"
    writer = df.write.format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(staging)
    spark.sql(f"ANALYZE TABLE {staging} COMPUTE STATISTICS")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    if partition_by:
        # A catalog may keep the staging table's folder as the place of each partition.
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spark.sql(f"DROP TABLE IF EXISTS {old}")
