"""One commit for several stored tables.

Executors write whole partitions of every table below a staging folder. Then a
journal that lists what replaces what is put in place by one rename, and the
partitions are moved. A driver lost before that leaves the tables as they were;
one lost after it leaves a journal, and whoever opens the tables next finishes
its moves, as often as it takes. One writer at a time; staging lies beside the
tables, so that a move is a rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

JOURNAL = "journal.json"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


class Change:
    """Partitions to be replaced together. `folder` holds the staged rows and the journal of a set of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        recover(spark, folder)
        self.staging = f"{folder}/staged-{uuid.uuid4().hex}"
        self.tables: list[tuple[str, str, int]] = []

    def put(self, rows: DataFrame, table: str, *by: str) -> str:
        """Write what is to replace a table's partitions of the same values; the staged rows can be read at the path returned."""
        staged = f"{self.staging}/{len(self.tables)}"
        rows.write.partitionBy(*by).parquet(staged)
        self.tables.append((staged, table, len(by)))
        return staged

    def commit(self) -> None:
        fs, path = file_system(self.spark, self.folder)
        moves = [(f"{staged}/{p}", f"{table}/{p}") for staged, table, depth in self.tables for p in _partitions(fs, path, staged, depth)]
        if moves:
            text = json.dumps({"staging": self.staging, "moves": moves})
            out = fs.create(path(f"{self.staging}/{JOURNAL}"))
            out.write(text.encode())
            out.close()
            if not fs.rename(path(f"{self.staging}/{JOURNAL}"), path(f"{self.folder}/{JOURNAL}")):
                raise OSError(f"another change of {self.folder} is under way")
        recover(self.spark, self.folder)


def recover(spark: SparkSession, folder: str) -> None:
    """Finish the change that a journal tells of, and remove what was staged without one."""
    fs, path = file_system(spark, folder)
    if fs.exists(path(f"{folder}/{JOURNAL}")):
        told = json.loads(spark.read.text(f"{folder}/{JOURNAL}", wholetext=True).first()[0])
        for staged, final in told["moves"]:
            if fs.exists(path(staged)):  # else moved already
                fs.delete(path(final), True)
                fs.mkdirs(path(final).getParent())
                if not fs.rename(path(staged), path(final)):
                    raise OSError(f"{staged} can't be moved to {final}")
        fs.delete(path(f"{folder}/{JOURNAL}"), False)
    if fs.exists(path(folder)):
        for left in fs.listStatus(path(folder)):
            fs.delete(left.getPath(), True)


def _partitions(fs, path, folder: str, depth: int) -> list[str]:
    """Folders of partition values at a depth, relative to a table's folder: as many as partitions are replaced."""
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{s.getPath().getName()}" for p in found for s in fs.listStatus(path(f"{folder}{p}")) if s.isDirectory()]
    return [p.lstrip("/") for p in found]
