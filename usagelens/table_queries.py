"""Registered queries over tables that are stored first: syncs and streams of log files, directory trees by id."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.directories import DirectoryFilters
from usagelens.plans import distinct, idtree, ingest
from usagelens.queries import Query, age_case, imported, rounded, size_case, with_entries
from usagelens.session import fresh_path
from usagelens.sinks.commit import file_system
from usagelens.streaming.ingest import stream_logs

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Log files of all orders as jobs. A record stands in the file of its end day, every eleventh nine days late; every
# seventh job is requeued and has a second record a day later. In SQL that Spark and an oracle share.
RECORDS_SQL = """
SELECT k, run, usr, account, queue, submit, submit + INTERVAL '1' MINUTE + INTERVAL '1' SECOND * wait AS start_ts,
  submit + INTERVAL '1' MINUTE + INTERVAL '1' SECOND * (wait + elapsed) AS end_ts, elapsed, numcpus, memory,
  CAST(submit + INTERVAL '1' MINUTE + INTERVAL '1' SECOND * (wait + elapsed + CASE WHEN run = 1 AND k % 11 = 0 THEN 777600 ELSE 0 END) AS DATE) AS file_day
FROM (
  SELECT o_orderkey AS k, run, 'u' || CAST(o_custkey % 40 AS STRING) AS usr, 'P' || CAST(o_custkey % 9 AS STRING) AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'htc' ELSE 'vis' END AS queue,
    TIMESTAMP '2023-11-14 22:13:20' + INTERVAL '1' SECOND * (o_orderkey % 12 * 86400) AS submit, o_orderkey * 7 % 300 AS numcpus,
    CASE WHEN run = 1 THEN o_orderkey * 37 % 40000 ELSE 100 END AS elapsed, CASE WHEN run = 1 THEN 0 ELSE 86400 + o_orderkey * 37 % 40000 END AS wait,
    (o_orderkey % 700 + 1) * run * 1048576 AS memory
  FROM {orders} CROSS JOIN (SELECT 1 AS run UNION ALL SELECT 2) r WHERE run = 1 OR o_orderkey % 7 = 0
) t
"""
FIRST, CUT, LAST = date(2023, 11, 14), date(2023, 11, 20), date(2023, 12, 10)
_RECORDS_CTE = "records AS (" + RECORDS_SQL.format(orders="orders") + ")"
_KEPT_CTE = """kept AS (SELECT *, FIRST_VALUE(memory) OVER (PARTITION BY k ORDER BY file_day DESC) AS last_memory, FIRST_VALUE(run) OVER (PARTITION BY k ORDER BY file_day DESC) AS last_run,
  ROW_NUMBER() OVER (PARTITION BY k ORDER BY file_day) AS place FROM records)"""


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with the day of their file."""
    told = spark.sql(RECORDS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("string")
    fields = {
        "user": "usr", "account": F.concat(F.lit('"'), "account", F.lit('"')), "queue": "queue", "ctime": epoch("submit"), "qtime": epoch("submit"), "etime": epoch("submit"),
        "start": epoch("start_ts"), "end": epoch("end_ts"), "Exit_status": F.lit("0"), "run_count": F.col("run").cast("string"), "Resource_List.ncpus": F.col("numcpus").cast("string"),
        "resources_used.walltime": F.col("elapsed").cast("string"), "resources_used.mem": F.concat((F.col("memory") / 1024).cast("bigint").cast("string"), F.lit("kb")),
    }
    attributes = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in fields.items()])
    return told.select(F.concat(F.lit("01/01/2023 00:00:00;E;"), F.col("k").cast("string"), F.lit(".srv;"), attributes).alias("value"), "file_day")


def _write_logs(lines: DataFrame, folder: str) -> None:
    """A folder of parts a log day, called YYYYMMDD."""
    days = lines.withColumn("day", F.date_format("file_day", "yyyyMMdd")).drop("file_day")
    days.hint("rebalance", "day").write.partitionBy("day").mode("append").text(folder)
    fs, path = file_system(lines.sparkSession, folder)
    for part in fs.listStatus(path(folder)):
        name = part.getPath().getName()
        if name.startswith("day="):
            fs.rename(part.getPath(), path(f"{folder}/{name.removeprefix('day=')}"))


def _synced(spark: SparkSession, sf_dir: str, mode: str, *cuts: date) -> tuple[str, str]:
    """Paths of the job table and the roll-up after one sync up to each cut and one for the rest."""
    root = fresh_path(spark, "requeued")
    _write_logs(_lines(spark, sf_dir), f"{root}/logs")
    first = FIRST
    for last in (*cuts, LAST):
        ingest.sync_days(spark, f"{root}/logs", f"{root}/jobs", f"{root}/summary", "casper", first, last, mode)
        first = date.fromordinal(last.toordinal() + 1)
    return f"{root}/jobs", f"{root}/summary"


def _streamed(spark: SparkSession, sf_dir: str, mode: str = "plain") -> tuple[str, str]:
    """The same tables, kept by a stream that sees the days after the cut later."""
    root, lines = fresh_path(spark, "streamed"), _lines(spark, sf_dir)
    for part in (F.col("file_day") <= F.lit(CUT), F.col("file_day") > F.lit(CUT)):
        _write_logs(lines.where(part), f"{root}/logs")
        stream_logs(spark, f"{root}/logs/*", f"{root}/jobs", f"{root}/checkpoint", "casper", f"{root}/summary", mode).awaitTermination()
    return f"{root}/jobs", f"{root}/summary"


def _jobs(spark: SparkSession, paths: tuple[str, str]) -> DataFrame:
    return rounded(ingest.open_jobs(spark, paths[0]).select("job_id", "run_count", "submit", "end_ts", "memory", "cpu_hours", "memory_hours", "end_date"))


def _rollup(spark: SparkSession, paths: tuple[str, str]) -> DataFrame:
    return rounded(spark.read.parquet(paths[1]).select("date", "user", "account", "queue", "job_count", "cpu_hours", "memory_hours"))


def _jobs_sql(run: str, memory: str) -> str:
    return f"""WITH {_RECORDS_CTE}, {_KEPT_CTE} SELECT CAST(k AS STRING) || '.srv' AS job_id, CAST({run} AS INTEGER) AS run_count, submit, end_ts, CAST({memory} AS BIGINT) AS memory,
      ROUND(elapsed * numcpus / 3600.0e0, 4) AS cpu_hours, ROUND(elapsed * {memory} / (3600.0e0 * 1073741824), 4) AS memory_hours, CAST(end_ts AS DATE) AS end_date FROM kept WHERE place = 1"""


_ROLLUP_SQL = f"""WITH {_RECORDS_CTE}, {_KEPT_CTE},
days AS (SELECT DISTINCT file_day AS date FROM records),
summed AS (SELECT CAST((end_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS DATE) AS date, usr, account, queue, COUNT(*) AS n, SUM(elapsed * numcpus / 3600.0e0) AS c,
  SUM(elapsed * memory / (3600.0e0 * 1073741824)) AS m FROM kept WHERE place = 1 GROUP BY 1, 2, 3, 4)
SELECT d.date, usr AS "user", account, queue, COALESCE(n, 0) AS job_count, ROUND(COALESCE(c, 0), 4) AS cpu_hours, ROUND(COALESCE(m, 0), 4) AS memory_hours FROM days d LEFT JOIN summed s ON d.date = s.date"""

register("sync_requeued", lambda s, d: _jobs(s, _synced(s, d, "plain", CUT)), _jobs_sql("run", "memory"))
register("sync_requeued_upsert", lambda s, d: _jobs(s, _synced(s, d, "upsert", CUT)), _jobs_sql("last_run", "last_memory"))
register("sync_requeued_rollup", lambda s, d: _rollup(s, _synced(s, d, "plain", CUT)), _ROLLUP_SQL)
register("stream_requeued", lambda s, d: _jobs(s, _streamed(s, d)), _jobs_sql("run", "memory"))
register("stream_requeued_rollup", lambda s, d: _rollup(s, _streamed(s, d)), _ROLLUP_SQL)


# Directory trees by id: regions and nations, and below these the customers in chains of 200, each holding its orders.
TREE_SQL = """
SELECT CAST(r_regionkey AS BIGINT) AS dir_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM {region}
UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM {nation}
UNION ALL SELECT 1000 + c_custkey, CASE WHEN c_custkey % 200 = 1 THEN 100 + c_nationkey ELSE 999 + c_custkey END, 'c' || CAST(c_custkey AS STRING) FROM {customer}
"""
STATS_SQL = "SELECT 1000 + o_custkey AS dir_id, COUNT(*) AS files, SUM(o_orderkey * 7919 % 5000000 * 4096) AS size, MAX(o_orderdate) AS newest FROM {orders} GROUP BY o_custkey"
_WALK_CTE = f"""RECURSIVE tree AS ({TREE_SQL.format(region="region", nation="nation", customer="customer")}), stats AS ({STATS_SQL.format(orders="orders")}),
ways AS (SELECT dir_id, '/' || name AS path, 1 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.dir_id, w.path || '/' || t.name, w.depth + 1 FROM ways w JOIN tree t ON t.parent_id = w.dir_id),
under AS (SELECT dir_id AS top, dir_id FROM tree UNION ALL SELECT u.top, t.dir_id FROM under u JOIN tree t ON t.parent_id = u.dir_id)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TREE_SQL, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer")})


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = spark.sql(STATS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return idtree.rolled(_tree(spark, sf_dir), stats, sums=("files", "size"), greatest=("newest",))


def _stored_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tree")
    tree = _tree(spark, sf_dir)
    idtree.write(idtree.intervals(idtree.paths(tree, idtree.sizes(tree))), path, ordered=True)
    return spark.read.parquet(path)


register("tree_paths_by_id", lambda s, d: idtree.paths(_tree(s, d)), f"WITH {_WALK_CTE} SELECT t.*, w.path, CAST(w.depth AS INTEGER) AS depth FROM tree t LEFT JOIN ways w ON t.dir_id = w.dir_id")
register(
    "tree_totals_by_id", _totals,
    f"WITH {_WALK_CTE} SELECT top AS dir_id, CAST(COALESCE(SUM(files), 0) AS BIGINT) AS files, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS size, MAX(newest) AS newest FROM under LEFT JOIN stats ON under.dir_id = stats.dir_id GROUP BY top",
)
register(
    "tree_intervals_by_id", lambda s, d: _stored_tree(s, d).select("dir_id", "low", "high"),
    f"""WITH {_WALK_CTE}, sizes AS (SELECT top AS dir_id, COUNT(*) AS n FROM under GROUP BY top)
      SELECT t.dir_id, low, low + n AS high FROM tree t LEFT JOIN (SELECT dir_id, ROW_NUMBER() OVER (ORDER BY REPLACE(path, '/', CHR(1))) - 1 AS low FROM ways) w ON t.dir_id = w.dir_id LEFT JOIN sizes z ON t.dir_id = z.dir_id""",
)
register(
    "tree_subtree_by_id", lambda s, d: (lambda t: idtree.below(t, list(idtree.ids_of(t, ["/ASIA/", "/EUROPE/FRANCE"]).values())).select("dir_id", "path"))(_stored_tree(s, d)),
    f"WITH {_WALK_CTE} SELECT dir_id, path FROM ways WHERE path = '/ASIA' OR STARTS_WITH(path, '/ASIA/') OR path = '/EUROPE/FRANCE' OR STARTS_WITH(path, '/EUROPE/FRANCE/')",
)

# exact histograms of parts of a collection

_SCOPES: dict[str, tuple[DirectoryFilters, str]] = {
    "scoped": (DirectoryFilters(paths=["/ASIA", "/EUROPE/FRANCE", "/EUROPE/FRANCE/x"]), "(path LIKE '/ASIA/%' OR path LIKE '/EUROPE/FRANCE/%')"),
    "whole": (DirectoryFilters(), "TRUE"),
    "filtered": (DirectoryFilters(paths=["/ASIA", "/AFRICA"], exclude=["/ASIA/CHINA"], min_depth=3, min_files=5), """(path LIKE '/ASIA/%' OR path LIKE '/AFRICA/%') AND path NOT LIKE '/ASIA/CHINA/%'
      AND parent IN (SELECT path FROM tree WHERE depth >= 3 AND file_count_r >= 5)"""),
}
for _kind, _case in (("access", age_case("atime")), ("size", size_case("allocated"))):
    for _scope, (_filters, _where) in _SCOPES.items():
        register(
            f"histogram_exact_{_scope}_{_kind}", lambda s, d, k=_kind, f=_filters: imported(s, d).exact_histogram(k, f, by_owner=True),
            with_entries(f"SELECT {_case} AS bucket_index, uid AS owner_uid, COUNT(*) AS file_count, CAST(SUM(allocated) AS BIGINT) AS total_size FROM files WHERE {_where} GROUP BY 1, 2"),
        )


# distinct names from bitmaps that two syncs have kept


def _unique(spark: SparkSession, sf_dir: str, kind: str, period: str) -> DataFrame:
    bitmaps = spark.read.parquet(_synced(spark, sf_dir, "plain", CUT)[1] + distinct.BITMAPS)
    return distinct.unique_by_period(bitmaps, kind, FIRST, LAST, period)


for _kind, _column in (("user", "usr"), ("account", "account")):
    for _period, _label in (("day", "STRFTIME(end_ts, '%Y-%m-%d')"), ("month", "STRFTIME(end_ts, '%Y-%m')")):
        register(
            f"unique_{_kind}s_from_rollup_{_period}", lambda s, d, k=_kind, p=_period: _unique(s, d, k, p),
            f"WITH {_RECORDS_CTE}, {_KEPT_CTE} SELECT {_label} AS period, COUNT(DISTINCT {_column}) AS n FROM kept WHERE place = 1 GROUP BY 1",
        )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
