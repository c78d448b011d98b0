"""Session settings the package expects; on a cluster the submitter's settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(name: str = "usagelens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    A session without the setting gets a temporary folder if it is local, else one beside its warehouse.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir")
    known = context._jsc.sc().getCheckpointDir()
    if where is None and known.isDefined():
        where = known.get()
    if where is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        where = "file://" + tempfile.mkdtemp(prefix="usagelens-")
    where = (where or spark.conf.get("spark.sql.warehouse.dir") + "-scratch").rstrip("/")
    if not known.isDefined():
        context.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def once(column: Column) -> Column:
    """A column that is computed once a row: Spark moves filters below a projection, and there computes a column as often as they name it, but not below a generator."""
    return F.explode(F.array(column))


def stored(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder, so that they are the same however often they are read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
