"""The driver's tables seen as jobs and as a directory scan, in SQL that Spark and other engines share.

{orders}, {lineitem}, {customer}, {nation} and {region} stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JOBS_SQL = """
SELECT k AS id, machine, short_id, priority, qos, usr, account, queue, status, name, elapsed, walltime, eligible_secs, numcpus, numgpus, numnodes,
  mpiprocs, ompthreads, reqmem, memory, qos_factor, run_count, end_ts,
  CASE WHEN k % 5 = 0 THEN CAST(k AS STRING) || '[' || CAST(k % 7 AS STRING) || '].srv' ELSE CAST(k AS STRING) || '.srv' END AS job_id,
  end_ts - INTERVAL '1' SECOND * elapsed AS start_ts,
  end_ts - INTERVAL '1' SECOND * (elapsed + 60) AS submit,
  cpu_hours, CASE WHEN numgpus > 0 THEN gpu_units ELSE gpu_units * 0 END AS gpu_hours, memory_hours
FROM (
  SELECT o.o_orderkey AS k, o.o_orderkey AS short_id,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'derecho' ELSE 'casper' END AS machine,
    CASE SUBSTRING(o.o_orderpriority, 1, 1) WHEN '1' THEN 'premium' WHEN '2' THEN 'regular' WHEN '3' THEN 'economy' WHEN '4' THEN 'special' END AS priority,
    CASE SUBSTRING(o.o_orderpriority, 1, 1) WHEN '1' THEN 'premium' WHEN '2' THEN 'regular' WHEN '3' THEN 'economy' WHEN '4' THEN 'special' END AS qos,
    CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE 'u' || CAST(o.o_custkey % 40 AS STRING) END AS usr,
    CASE o.o_orderkey % 6 WHEN 0 THEN 'UNIV' WHEN 1 THEN 'WXYZ' WHEN 2 THEN 'CESM' WHEN 3 THEN 'P35' WHEN 4 THEN 'SCIS' ELSE 'NMMM' END || CAST(o.o_custkey % 9 AS STRING) AS account,
    CASE WHEN o.o_orderkey % 3 = 0 THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu' WHEN 2 THEN 'cpudev' ELSE 'main' END
         WHEN o.o_orderkey % 89 = 0 THEN NULL
         ELSE CASE o.o_orderkey % 5 WHEN 0 THEN 'htc' WHEN 1 THEN 'vis' WHEN 2 THEN 'nvgpu' WHEN 3 THEN 'a100' ELSE 'largemem' END END AS queue,
    CASE o.o_orderstatus WHEN 'O' THEN '0' WHEN 'F' THEN '1' ELSE '271' END AS status,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 2 = 0 THEN 'run_' || CAST(o.o_orderkey % 50 AS STRING) || '.sh' ELSE 'Test-' || CAST(o.o_orderkey % 30 AS STRING) END AS name,
    o.o_orderkey * 37 % 90000 AS elapsed, o.o_orderkey * 37 % 90000 + 600 AS walltime,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderkey * 53 % 200000 END AS eligible_secs,
    o.o_orderkey * 7 % 300 AS numcpus,
    CASE WHEN o.o_orderkey % 3 = 0 THEN CASE WHEN o.o_orderkey % 4 = 1 THEN o.o_orderkey % 12 ELSE 0 END
         WHEN o.o_orderkey % 5 = 2 OR o.o_orderkey % 5 = 3 THEN o.o_orderkey % 9 ELSE 0 END AS numgpus,
    1 + o.o_orderkey % 40 AS numnodes,
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE 1 + o.o_orderkey % 16 END AS mpiprocs, 1 + o.o_orderkey % 4 AS ompthreads,
    (1 + o.o_orderkey % 1200) * 536870912 AS reqmem,
    CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE (o.o_orderkey % 700) * 401604608 END AS memory,
    1 + o.o_orderkey % 3 AS run_count,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '1' SECOND * (o.o_orderkey * 7919 % 86400) END AS end_ts,
    c.cpu_hours, c.gpu_units, c.memory_hours,
    CASE WHEN c.cpu_hours IS NULL THEN NULL ELSE CASE SUBSTRING(o.o_orderpriority, 1, 1) WHEN '1' THEN 1.5e0 WHEN '2' THEN 1.0e0 WHEN '3' THEN 0.7e0 WHEN '4' THEN 1.0e0 END END AS qos_factor
  FROM {orders} o LEFT JOIN (
    SELECT l_orderkey, SUM(l_quantity) AS cpu_hours, SUM(l_linenumber) * 0.5e0 AS gpu_units, COUNT(*) * 0.25e0 AS memory_hours FROM {lineitem} GROUP BY l_orderkey
  ) c ON o.o_orderkey = c.l_orderkey
) t
"""

ENTRIES_SQL = """
SELECT '/' || r_name AS path, 0 AS size, 0 AS allocated, 0 AS uid, 0 AS gid, TRUE AS is_dir, CAST(NULL AS TIMESTAMP) AS atime, '' AS parent FROM {region}
UNION ALL SELECT '/' || r_name || '/' || n_name, 0, 0, 0, 0, TRUE, CAST(NULL AS TIMESTAMP), '/' || r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT '/' || r_name || '/' || n_name || '/c' || CAST(c_custkey AS STRING), 0, 0, 0, 0, TRUE, CAST(NULL AS TIMESTAMP), '/' || r_name || '/' || n_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT '/' || r_name || '/' || n_name || '/c' || CAST(c_custkey AS STRING) || '/o' || CAST(o_orderkey AS STRING),
    o_orderkey * 7919 % 5000000 * 4096, o_orderkey * 7919 % 5000000 * 4096, CASE WHEN c_custkey % 3 = 0 THEN 1000 + o_orderkey % 7 ELSE 1000 + c_custkey % 7 END,
    100 + c_custkey % 4, FALSE, CAST(o_orderdate AS TIMESTAMP), '/' || r_name || '/' || n_name || '/c' || CAST(c_custkey AS STRING)
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def _tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, their line items as charges."""
    told = spark.sql(JOBS_SQL, **_tables(spark, sf_dir, ("orders", "lineitem")))
    return told.withColumnsRenamed({"usr": "user", "start_ts": "start"}).selectExpr("*", "submit AS eligible", "submit AS queued", "reqmem - memory AS memory_wasted")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as directories, orders as their files."""
    told = spark.sql(ENTRIES_SQL, **_tables(spark, sf_dir, ("orders", "customer", "nation", "region")))
    return told.selectExpr("path", "CAST(size AS BIGINT) AS size", "CAST(allocated AS BIGINT) AS allocated", "CAST(uid AS BIGINT) AS uid",
                           "CAST(gid AS BIGINT) AS gid", "is_dir", "CAST(atime AS TIMESTAMP_NTZ) AS atime")


def _named(text: str, names: tuple[str, ...]) -> str:
    return text.format(**{n: n for n in names})


#: The same views for an oracle: jobs (user as usr) and entries (with the parent's path).
JOBS_CTE = "jobs AS (SELECT *, reqmem - memory AS memory_wasted FROM (" + _named(JOBS_SQL, ("orders", "lineitem")) + ") j)"
ENTRIES_CTE = "entries AS (" + _named(ENTRIES_SQL, ("orders", "customer", "nation", "region")) + ")"
