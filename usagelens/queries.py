"""Registered queries over the driver's tables, each with the SQL that an oracle runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions import buckets, timewin
from usagelens.functions.charging import charged
from usagelens.operators.directories import DirectoryFilters, DirectoryQueries
from usagelens.operators.filters import JobFilters
from usagelens.operators.jobs import FACILITIES, METRICS, JobQueries, list_qos
from usagelens.plans import importer, ingest, reports, rollup, tree
from usagelens.session import fresh_path, stored
from usagelens.sources import adapters, records, scan_log, scheduler_log
from usagelens.sources.adapters import ENTRIES_CTE, JOBS_CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

START, END = date(1996, 3, 1), date(1996, 6, 30)
# The same window in naive UTC: Denver is 7 hours behind in March and 6 in July.
WINDOW = "end_ts >= TIMESTAMP '1996-03-01 07:00:00' AND end_ts < TIMESTAMP '1996-07-01 06:00:00'"
UTC_WINDOW = "end_ts >= TIMESTAMP '1996-03-01 00:00:00' AND end_ts < TIMESTAMP '1996-07-01 00:00:00'"
SITE_DAY = "CAST((end_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS DATE)"
CPU_QUEUES = {"casper": "'htc','gdex','largemem','vis','rda'", "derecho": "'cpu','cpudev'"}
GPU_QUEUES = {"casper": "'nvgpu','gpgpu','a100','h100','l40','amdgpu'", "derecho": "'gpu','gpudev','pgpu'"}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, since sums depend on their order: the scaled double is rounded, as the SQL's ROUND does, not its decimal digits."""
    scale = float(10**places)
    return df.select(*[(F.round(F.col(f"`{c}`") * scale) / scale).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _r(expression: str) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), 4)"


def _jobs(spark: SparkSession, sf_dir: str, machine: str | None = None) -> JobQueries:
    return JobQueries(adapters.jobs(spark, sf_dir), machine)


def _with_jobs(body: str) -> str:
    return f"WITH {JOBS_CTE} {body}"


METRIC_SQL = ", ".join([
    "COUNT(*) AS job_count", f"{_r('COALESCE(SUM(cpu_hours), 0)')} AS cpu_hours", f"{_r('COALESCE(SUM(gpu_hours), 0)')} AS gpu_hours",
    f"{_r('COALESCE(SUM(cpu_hours * COALESCE(qos_factor, 1)), 0)')} AS cpu_charges", f"{_r('COALESCE(SUM(gpu_hours * COALESCE(qos_factor, 1)), 0)')} AS gpu_charges",
])

# counts, one for each filter

FILTERS: dict[str, tuple[JobFilters, str]] = {
    "window": (JobFilters(start=START, end=END), WINDOW),
    "user": (JobFilters(user="u7"), "usr = 'u7'"),
    "account": (JobFilters(account="UNIV3"), "account = 'UNIV3'"),
    "accounts": (JobFilters(account=["UNIV3", "CESM1"]), "account IN ('UNIV3', 'CESM1')"),
    "no_accounts": (JobFilters(account=[]), "FALSE"),
    "queue": (JobFilters(queue="htc"), "queue = 'htc'"),
    "qos": (JobFilters(qos="economy"), "qos = 'economy'"),
    "exit_status": (JobFilters(exit_status="271"), "status = '271'"),
    "job_id_exact": (JobFilters(job_id=" 12.srv "), "job_id = '12.srv'"),
    "job_id_array": (JobFilters(job_id="25"), "(job_id LIKE '25.%' OR job_id LIKE '25[%')"),
    "name": (JobFilters(name="run_1*.sh"), "name LIKE 'run!_1%.sh' ESCAPE '!'"),
    "name_any": (JobFilters(name=["TEST-?", "run_2.sh"], ignore_case=True), "(LOWER(name) LIKE 'test-_' OR LOWER(name) = 'run_2.sh')"),
    "eligible_secs": (JobFilters(min_eligible_secs=0, max_eligible_secs=3600), "eligible_secs BETWEEN 0 AND 3600"),
    "nodes": (JobFilters(min_nodes=8, max_nodes=16), "numnodes BETWEEN 8 AND 16"),
    "cpus": (JobFilters(min_cpus=100), "numcpus >= 100"),
    "gpus": (JobFilters(min_gpus=1, max_gpus=4), "numgpus BETWEEN 1 AND 4"),
    "elapsed": (JobFilters(max_elapsed=1799), "elapsed <= 1799"),
    "reqmem": (JobFilters(min_reqmem=buckets.GIB), f"reqmem >= {buckets.GIB}"),
    "memory_used": (JobFilters(max_memory_used=10 * buckets.GIB), f"memory <= {10 * buckets.GIB}"),
    "memory_wasted": (JobFilters(max_memory_wasted=-1), "memory_wasted <= -1"),
    "all_at_once": (JobFilters(start=START, end=END, queue="htc", min_nodes=2, name="*", max_elapsed=80000), f"{WINDOW} AND queue = 'htc' AND numnodes >= 2 AND name IS NOT NULL AND elapsed <= 80000"),
}
for _name, (_filters, _where) in FILTERS.items():
    register(f"jobs_count_{_name}", lambda s, d, f=_filters: _jobs(s, d).count(f), _with_jobs(f"SELECT COUNT(*) AS job_count FROM jobs WHERE {_where}"))

# rows

_SHOWN = ("job_id", "user", "queue", "exit_status", "end", "cpu_hours", "cpu_charges", "memory")
_SHOWN_SQL = """id, job_id, usr AS "user", queue, status AS exit_status, STRFTIME(end_ts, '%Y-%m-%d %H:%M:%S') AS "end", cpu_hours, ROUND(cpu_hours * COALESCE(qos_factor, 1), 4) AS cpu_charges, memory"""
register(
    "jobs_search",
    lambda s, d: rounded(_jobs(s, d).search(JobFilters(start=START, end=END, queue="htc"), _SHOWN)),
    _with_jobs(f"SELECT {_SHOWN_SQL} FROM jobs WHERE {WINDOW} AND queue = 'htc'"),
)
register(
    "jobs_search_page",
    lambda s, d: rounded(_jobs(s, d).search(JobFilters(start=START, end=END), _SHOWN, limit=25, offset=50, sort_by="cpu_charges")),
    _with_jobs(f"SELECT {_SHOWN_SQL} FROM jobs WHERE {WINDOW} ORDER BY cpu_hours * COALESCE(qos_factor, 1) DESC NULLS LAST, id LIMIT 25 OFFSET 50"),
)
register(
    "jobs_search_ascending",
    lambda s, d: rounded(_jobs(s, d).search(JobFilters(account="CESM2"), _SHOWN, limit=40, sort_by="memory", descending=False)),
    _with_jobs(f"SELECT {_SHOWN_SQL} FROM jobs WHERE account = 'CESM2' ORDER BY memory ASC NULLS FIRST, id LIMIT 40"),
)
for _dimension, _value, _column in (("user", "u11", "usr"), ("account", "WXYZ4", "account"), ("queue", "gpu", "queue")):
    register(
        f"jobs_by_{_dimension}",
        lambda s, d, k=_dimension, v=_value: _jobs(s, d).by(k, v, START, END).select("id", "job_id", "elapsed"),
        _with_jobs(f"SELECT id, job_id, elapsed FROM jobs WHERE {_column} = '{_value}' AND {WINDOW}"),
    )

# facets: the queue and exit_status filters each leave their own facet alone

_FACET_WHERE = {"queue": "status = '1'", "qos": "queue = 'htc' AND status = '1'", "exit_status": "queue = 'htc'", "account": "queue = 'htc' AND status = '1'"}
_FACET_COLUMN = {"queue": "queue", "qos": "qos", "exit_status": "status", "account": "account"}
_FACET_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS facet, {_FACET_COLUMN[f]} AS value, COUNT(*) AS count FROM jobs WHERE account IN ('UNIV3', 'CESM1', 'NMMM2') AND {w} GROUP BY {_FACET_COLUMN[f]}" for f, w in _FACET_WHERE.items()
)
register(
    "jobs_facets",
    lambda s, d: _jobs(s, d).facets(JobFilters(queue="htc", exit_status="1", account=["UNIV3", "CESM1", "NMMM2"]), tuple(_FACET_WHERE)),
    _with_jobs(_FACET_SQL),
)
register(
    "jobs_facets_plain",
    lambda s, d: _jobs(s, d).facets(JobFilters(start=START, end=END), ("queue", "user"), self_exclude=False, limit=5),
    _with_jobs(f"""SELECT facet, value, count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY facet ORDER BY count DESC, value ASC NULLS LAST) AS p FROM (
      SELECT 'queue' AS facet, queue AS value, COUNT(*) AS count FROM jobs WHERE {WINDOW} GROUP BY queue
      UNION ALL SELECT 'user', usr, COUNT(*) FROM jobs WHERE {WINDOW} GROUP BY usr) f) r WHERE p <= 5"""),
)

# histograms of all dimensions


def _band_case(column: str, table: list[buckets.Band]) -> str:
    whens = " ".join(f"WHEN {column} <= {high} THEN '{label}'" for label, _, high in table[:-1])
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE '{table[-1][0]}' END"


def _histogram_sql(dimension: str, machine: str, where: str) -> str:
    table = buckets.histogram_bands(dimension, machine)
    number = lambda x: "NULL" if x is None else str(x)
    values = ", ".join(f"({i}, {'NULL' if b is None else repr(b)}, CAST({number(lo)} AS BIGINT), CAST({number(hi)} AS BIGINT))" for i, (b, lo, hi) in enumerate([*table, (None, None, None)]))
    zero = ", ".join(f"COALESCE(f.{m}, 0) AS {m}" for m in METRICS)
    case = _band_case(buckets.DIMENSIONS[dimension][1], table)
    return _with_jobs(f"""SELECT t.position, t.label, t.low, t.high, {zero} FROM (VALUES {values}) t(position, label, low, high)
      LEFT JOIN (SELECT {case} AS label, {METRIC_SQL} FROM jobs WHERE machine = '{machine}' AND {where} GROUP BY 1) f ON t.label IS NOT DISTINCT FROM f.label""")


for _dimension in buckets.DIMENSIONS:
    register(
        f"jobs_histogram_{_dimension}",
        lambda s, d, k=_dimension: rounded(_jobs(s, d, "casper").histogram(k, JobFilters(start=START, end=END))),
        _histogram_sql(_dimension, "casper", WINDOW),
    )
register(
    "jobs_histogram_owners",
    lambda s, d: rounded(_jobs(s, d, "casper").histogram("wait", JobFilters(start=START, end=END), owners_limit=3)),
    _with_jobs(f"""SELECT label, owner, job_count, cpu_hours, gpu_hours, cpu_charges, gpu_charges, CAST(place AS INTEGER) AS place FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY job_count DESC, owner) AS place FROM (
        SELECT {_band_case("eligible_secs", buckets.histogram_bands("wait"))} AS label, usr AS owner, {METRIC_SQL} FROM jobs WHERE machine = 'casper' AND {WINDOW} GROUP BY 1, 2) g
      WHERE label IS NOT NULL AND owner IS NOT NULL) r WHERE place <= 3"""),
)

# usage and totals

for _dimension, _column in (("user", "usr"), ("queue", "queue"), ("qos", "qos"), ("account", "account")):
    register(
        f"jobs_usage_by_{_dimension}",
        lambda s, d, k=_dimension: rounded(_jobs(s, d).usage_by(k, JobFilters(start=START, end=END))),
        _with_jobs(f"SELECT {_column} AS value, {METRIC_SQL} FROM jobs WHERE {WINDOW} GROUP BY {_column}"),
    )
register(
    "jobs_usage_top_users",
    lambda s, d: rounded(_jobs(s, d).usage_by("user", JobFilters(start=START, end=END), limit=10, sort_by="job_count")),
    _with_jobs(f"SELECT usr AS value, {METRIC_SQL} FROM jobs WHERE {WINDOW} GROUP BY usr ORDER BY job_count DESC, value ASC NULLS LAST LIMIT 10"),
)
register("jobs_usage_totals", lambda s, d: rounded(_jobs(s, d).usage_totals(JobFilters(start=START, end=END))), _with_jobs(f"SELECT {METRIC_SQL} FROM jobs WHERE {WINDOW}"))
register(
    "jobs_window",
    lambda s, d: _jobs(s, d).window(JobFilters(queue="htc", start=START)),
    _with_jobs("SELECT MIN(end_ts) AS first_end, MAX(end_ts) AS last_end, SUM(CASE WHEN end_ts IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_count FROM jobs WHERE queue = 'htc'"),
)

# time series over daylight-saving changes, from jobs and from the roll-up


def _series_sql(period: str, owners: int = 0, where: str = "TRUE") -> str:
    told = timewin.bands(START, END, period)
    values = ", ".join(f"({i}, '{b['label']}', DATE '{b['period']}')" for i, b in enumerate(told))
    rows = f"SELECT CAST(DATE_TRUNC('{period}', {SITE_DAY}) AS DATE) AS period, * FROM jobs WHERE {WINDOW} AND {where}"
    zero = ", ".join(f"COALESCE(f.{m}, 0) AS {m}" for m in METRICS)
    if not owners:
        return _with_jobs(f"SELECT t.position, t.label, {zero} FROM (VALUES {values}) t(position, label, period) LEFT JOIN (SELECT period, {METRIC_SQL} FROM ({rows}) r GROUP BY period) f ON t.period = f.period")
    return _with_jobs(f""", r AS ({rows}), top AS (SELECT usr FROM r WHERE usr IS NOT NULL GROUP BY usr ORDER BY COUNT(*) DESC, usr LIMIT {owners}),
      f AS (SELECT period, CASE WHEN usr IN (SELECT usr FROM top) THEN usr END AS owner, {METRIC_SQL} FROM r GROUP BY 1, 2),
      o AS (SELECT usr AS owner FROM top UNION ALL SELECT NULL)
      SELECT t.position, t.label, o.owner, {zero} FROM (VALUES {values}) t(position, label, period) CROSS JOIN o LEFT JOIN f ON t.period = f.period AND o.owner IS NOT DISTINCT FROM f.owner""")


def _rolled(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    q = _jobs(spark, sf_dir)
    named = JobQueries(q.jobs.where("user IS NOT NULL AND account IS NOT NULL AND queue IS NOT NULL"))
    summary = rollup.daily_summary(named.jobs, START, END)
    return rounded(rollup.timeseries(summary, named, start=START, end=END, **options))


_NAMED = "usr IS NOT NULL AND account IS NOT NULL AND queue IS NOT NULL"
for _period in timewin.PERIODS:
    register(f"jobs_timeseries_{_period}", lambda s, d, p=_period: rounded(_jobs(s, d).timeseries(p, START, END)), _series_sql(_period))
    register(f"jobs_timeseries_rollup_{_period}", lambda s, d, p=_period: _rolled(s, d, period=p), _series_sql(_period, where=_NAMED))
register("jobs_timeseries_owners", lambda s, d: rounded(_jobs(s, d).timeseries("month", START, END, owners_limit=4)), _series_sql("month", 4))
register("jobs_timeseries_rollup_owners", lambda s, d: _rolled(s, d, period="month", owners_limit=4), _series_sql("month", 4, _NAMED))
_SUMMED = ", ".join(f"{_r(f'COALESCE(SUM({h}), 0)')} AS {h}" for h in rollup.HOURS) + ", " + ", ".join(f"{_r(f'COALESCE(SUM({h} * COALESCE(qos_factor, 1)), 0)')} AS {h.replace('hours', 'charges')}" for h in rollup.HOURS)
register(
    "daily_summary",
    lambda s, d: rounded(rollup.daily_summary(adapters.jobs(s, d), START, END)),
    _with_jobs(f"""SELECT {SITE_DAY} AS date, usr AS "user", account, queue, COUNT(*) AS job_count, {_SUMMED} FROM jobs WHERE {WINDOW} AND {_NAMED} GROUP BY 1, 2, 3, 4
      UNION ALL SELECT CAST(x AS DATE), NULL, NULL, NULL, 0, 0, 0, 0, 0, 0, 0 FROM (SELECT UNNEST(GENERATE_SERIES(TIMESTAMP '1996-03-01', TIMESTAMP '1996-06-30', INTERVAL '1' DAY)) AS x) c
      WHERE CAST(x AS DATE) NOT IN (SELECT {SITE_DAY} FROM jobs WHERE {WINDOW} AND {_NAMED})"""),
)
for _entity, _column in (("user", "usr"), ("account", "account")):
    register(
        f"daily_summary_by_{_entity}",
        lambda s, d, e=_entity: rounded(rollup.report(rollup.daily_summary(adapters.jobs(s, d), START, END), by=e)),
        _with_jobs(f'SELECT {SITE_DAY} AS date, {_column} AS "{_entity}", COUNT(*) AS job_count, {_SUMMED} FROM jobs WHERE {WINDOW} AND {_NAMED} GROUP BY 1, 2'),
    )

# the older reports


def _queues(kind: str, machine: str) -> str:
    return {"cpu": CPU_QUEUES[machine], "gpu": GPU_QUEUES[machine], "all": CPU_QUEUES[machine] + "," + GPU_QUEUES[machine]}[kind]


def _hours(kind: str) -> str:
    return f"{kind}_hours" if kind != "all" else "(COALESCE(cpu_hours, 0) + COALESCE(gpu_hours, 0))"


def _report_where(kind: str, machine: str = "casper") -> str:
    return f"machine = '{machine}' AND queue IN ({_queues(kind, machine)}) AND {WINDOW}"


_FACILITY_CASE = "CASE WHEN account IS NULL OR account = '' THEN 'NCAR' " + " ".join(f"WHEN account LIKE '{a}%' THEN '{n}'" for a, n in FACILITIES) + " ELSE 'NCAR' END"
for _kind in ("cpu", "gpu", "all"):
    for _group, _column in (("user", "usr"), ("account", "account")):
        register(
            f"usage_by_{_group}_{_kind}",
            lambda s, d, k=_kind, g=_group: rounded(_jobs(s, d, "casper").usage_by_group(k, g, START, END)),
            _with_jobs(f"SELECT {_column} AS label, {_r(f'SUM({_hours(_kind)})')} AS usage_hours, COUNT(*) AS job_count FROM jobs WHERE {_report_where(_kind)} AND cpu_hours IS NOT NULL GROUP BY {_column}"),
        )
    register(
        f"usage_by_facility_{_kind}",
        lambda s, d, k=_kind: rounded(_jobs(s, d, "derecho").usage_by_facility(k, START, END)),
        _with_jobs(f"SELECT {_FACILITY_CASE} AS facility, {_r(f'SUM({_hours(_kind)})')} AS usage_hours, COUNT(*) AS job_count FROM jobs WHERE {_report_where(_kind, 'derecho')} AND cpu_hours IS NOT NULL GROUP BY 1"),
    )


def _range_case(kind: str) -> str:
    value = {"gpu": "numgpus", "node": "numnodes", "core": "numcpus", "memory": f"reqmem / {buckets.GIB}.0e0"}[kind]
    table, overflow = buckets.RANGES[kind]
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {a} AND {b} THEN '{label}'" for label, a, b in table) + f" ELSE '{overflow}' END"


for _report, _kind, _range in (("gpu_job", "gpu", "gpu"), ("cpu_job", "cpu", "node"), ("job", "all", "core"), ("memory_job", "all", "memory")):
    register(
        f"{_report}_waits",
        lambda s, d, k=_kind, r=_range: rounded(_jobs(s, d, "casper").job_waits(k, r, START, END)),
        _with_jobs(f"SELECT {_range_case(_range)} AS range_label, {_r('AVG(eligible_secs / 3600.0e0)')} AS avg_wait_hours, COUNT(*) AS job_count FROM jobs WHERE {_report_where(_kind)} AND eligible_secs IS NOT NULL GROUP BY 1"),
    )
    register(
        f"{_report}_sizes",
        lambda s, d, k=_kind, r=_range: rounded(_jobs(s, d, "casper").job_sizes(k, r, START, END)),
        _with_jobs(f"SELECT {_range_case(_range)} AS range_label, COUNT(*) AS job_count, COUNT(DISTINCT usr) AS user_count, {_r(f'SUM({_hours(_kind)})')} AS hours FROM jobs WHERE {_report_where(_kind)} AND cpu_hours IS NOT NULL GROUP BY 1"),
    )

_UTC_LABEL = {"day": "STRFTIME(end_ts, '%Y-%m-%d')", "month": "STRFTIME(end_ts, '%Y-%m')", "year": "STRFTIME(end_ts, '%Y')", "quarter": "CAST(YEAR(end_ts) AS STRING) || '-Q' || CAST(QUARTER(end_ts) AS STRING)"}
_DURATION = _band_case("elapsed", buckets.DIMENSIONS["duration"][0])
_RANK = "(memory * 1.0e0 / NULLIF(mpiprocs * ompthreads * numnodes, 0))"


def _rank_sql(kind: str) -> str:
    out, low = [], None
    for label, top in buckets.RANK_ENDS_MIB:
        inside = " AND ".join([*([f"{_RANK} >= {low * 1048576}.0e0"] if low is not None else []), *([f"{_RANK} < {top * 1048576}.0e0"] if top is not None else [])])
        out.append(f'{_r(f"SUM(CASE WHEN {inside} THEN {_hours(kind)} ELSE 0 END)")} AS "{label}"')
        low = top
    return ", ".join(out)


for _kind in ("cpu", "gpu"):
    _bands = ", ".join(f"""{_r(f"SUM(CASE WHEN {_DURATION} = '{b[0]}' THEN {_hours(_kind)} ELSE 0 END)")} AS "{b[0]}" """ for b in buckets.DIMENSIONS["duration"][0])
    register(
        f"{_kind}_job_durations",
        lambda s, d, k=_kind: rounded(_jobs(s, d, "casper").job_durations(k, START, END, "month")),
        _with_jobs(f"SELECT {_UTC_LABEL['month']} AS date, {_bands} FROM jobs WHERE {_report_where(_kind)} AND cpu_hours IS NOT NULL GROUP BY 1"),
    )
    register(
        f"{_kind}_job_memory_per_rank",
        lambda s, d, k=_kind: rounded(_jobs(s, d, "casper").job_memory_per_rank(k, START, END, "quarter")),
        _with_jobs(f"SELECT {_UTC_LABEL['quarter']} AS date, {_rank_sql(_kind)} FROM jobs WHERE {_report_where(_kind)} AND cpu_hours IS NOT NULL GROUP BY 1"),
    )


def _history_sql(label: str) -> str:
    parts = []
    for kind in ("cpu", "gpu"):
        mine = f"queue IN ({_queues(kind, 'casper')}) AND cpu_hours IS NOT NULL"
        parts.append(f"""COUNT(DISTINCT CASE WHEN {mine} THEN usr END) AS {kind}_users, COUNT(DISTINCT CASE WHEN {mine} THEN account END) AS {kind}_projects,
          COUNT(CASE WHEN {mine} THEN 1 END) AS {kind}_jobs, {_r(f"COALESCE(SUM(CASE WHEN {mine} THEN {kind}_hours END), 0)")} AS {kind}_hours""")
    return f"SELECT {label} AS date, COUNT(DISTINCT usr) AS users, COUNT(DISTINCT account) AS projects, {', '.join(parts)} FROM jobs WHERE machine = 'casper' AND {UTC_WINDOW} GROUP BY 1"


for _period in ("day", "month", "quarter", "year"):
    register(f"usage_history_{_period}", lambda s, d, p=_period: rounded(_jobs(s, d, "casper").usage_history(START, END, p)), _with_jobs(_history_sql(_UTC_LABEL[_period])))
register(
    "utilisation_month",
    lambda s, d: rounded(_jobs(s, d, "casper").utilisation("cpu", 100, 36, START, END, "month"), 8),
    _with_jobs(f"SELECT date, ROUND(cpu_hours / (3600 * 730.0e0), 8) AS utilisation FROM ({_history_sql(_UTC_LABEL['month'])}) h"),
)
for _dimension, _column, _value, _other, _other_column in (("account", "account", "UNIV3", "user", "usr"), ("user", "usr", "u7", "account", "account")):
    _joined = lambda c: f"COALESCE(ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)), ','), '')"
    _lists = f"{_joined(_other_column)} AS {_other}s, {_joined('queue')} AS queues"
    _sums = ", ".join(f"{_r(f'COALESCE(SUM({h}_hours), 0)')} AS total_{h}_hours" for h in ("cpu", "gpu", "memory"))
    register(
        f"summary_of_{_dimension}",
        lambda s, d, k=_dimension, v=_value: rounded(_jobs(s, d).summary_of(k, v, START, END)),
        _with_jobs(f"SELECT COUNT(*) AS total_jobs, CAST(COALESCE(SUM(elapsed), 0) AS BIGINT) AS total_elapsed, {_sums}, {_lists} FROM jobs WHERE {_column} = '{_value}' AND {UTC_WINDOW} AND cpu_hours IS NOT NULL"),
    )
for _entity, _column in (("user", "usr"), ("account", "account")):
    register(
        f"jobs_by_{_entity}_period",
        lambda s, d, e=_entity: _jobs(s, d).by_entity_period(e, START, END, "month"),
        _with_jobs(f'SELECT {_UTC_LABEL["month"]} AS period, usr AS "user", account, COUNT(*) AS job_count FROM jobs WHERE {WINDOW} GROUP BY 1, 2, 3'),
    )
    register(
        f"history_per_{_entity}",
        lambda s, d, e=_entity: _jobs(s, d).collapsed_history(e, START, END, "quarter"),
        _with_jobs(f'SELECT {_UTC_LABEL["quarter"]} AS period, {_column} AS "{_entity}", COUNT(*) AS job_count FROM jobs WHERE {WINDOW} GROUP BY 1, 2'),
    )
    register(
        f"unique_{_entity}s_by_period",
        lambda s, d, e=_entity: _jobs(s, d).unique_by_period(e, START, END, "day"),
        _with_jobs(f"SELECT {_UTC_LABEL['day']} AS period, COUNT(DISTINCT {_column}) AS n FROM jobs WHERE {WINDOW} GROUP BY 1"),
    )
register("top_users_by_jobs", lambda s, d: _jobs(s, d).top_users(START, END), _with_jobs(f'SELECT usr AS "user", COUNT(*) AS job_count FROM jobs WHERE {UTC_WINDOW} GROUP BY usr ORDER BY 2 DESC, usr NULLS FIRST LIMIT 10'))
register("queue_statistics", lambda s, d: rounded(_jobs(s, d).queue_statistics(START, END)), _with_jobs(f"SELECT queue, COUNT(*) AS job_count, CAST(SUM(elapsed) AS BIGINT) AS total_elapsed, {_r('AVG(elapsed)')} AS avg_elapsed FROM jobs WHERE {UTC_WINDOW} GROUP BY queue"))
register(
    "usage_pie",
    lambda s, d: rounded(_jobs(s, d, "casper").pie("cpu", "user", START, END), 6),
    _with_jobs(f""", g AS (SELECT usr AS label, SUM(cpu_hours) AS h, COUNT(*) AS n FROM jobs WHERE {_report_where('cpu')} AND cpu_hours IS NOT NULL GROUP BY usr),
      p AS (SELECT *, LEAST(ROW_NUMBER() OVER (ORDER BY h DESC, label NULLS FIRST), 15) AS place FROM g)
      SELECT CAST(place AS INTEGER) AS place, CASE WHEN place > 14 THEN 'Others (' || CAST(COUNT(*) AS STRING) || ')' ELSE MIN(label) END AS label,
        ROUND(SUM(h), 6) AS usage_hours, CAST(SUM(n) AS BIGINT) AS job_count, ROUND(SUM(h) / (SELECT SUM(h) FROM g), 6) AS share FROM p GROUP BY place"""),
)
register(
    "qos_names",
    lambda s, d: list_qos(adapters.jobs(s, d).select(F.col("qos").alias("name"), F.lit(True).alias("active")).where("name IS NOT NULL").distinct()),
    _with_jobs("SELECT DISTINCT qos AS name FROM jobs WHERE qos IS NOT NULL"),
)
register(
    "across_machines",
    lambda s, d: reports.across({m: _jobs(s, d, m) for m in ("casper", "derecho")}, "queue_statistics", START, END).select("machine", "queue", "job_count"),
    _with_jobs(f"SELECT machine, queue, COUNT(*) AS job_count FROM jobs WHERE {UTC_WINDOW} GROUP BY 1, 2"),
)


# charging

for _machine in ("casper", "derecho"):
    _cpu = "numcpus" if _machine == "casper" else "CASE WHEN queue LIKE '%dev%' THEN numcpus ELSE numnodes * 128 END"
    _gpu = "numgpus" if _machine == "casper" else "CASE WHEN queue LIKE '%gpu%' THEN CASE WHEN queue LIKE '%dev%' THEN numgpus ELSE numnodes * 4 END ELSE 0 END"
    register(
        f"charges_{_machine}",
        lambda s, d, m=_machine: rounded(charged(_jobs(s, d, m).jobs.drop("cpu_hours", "gpu_hours", "memory_hours", "qos", "qos_factor"), m).select("id", "cpu_hours", "gpu_hours", "memory_hours", "qos", "qos_factor")),
        _with_jobs(f"""SELECT id, {_r(f'elapsed * ({_cpu}) / 3600.0e0')} AS cpu_hours, {_r(f'elapsed * ({_gpu}) / 3600.0e0')} AS gpu_hours,
          {_r('elapsed * COALESCE(memory, 0) / (3600.0e0 * 1073741824)')} AS memory_hours, COALESCE(priority, 'regular') AS qos,
          CASE priority WHEN 'premium' THEN 1.5e0 WHEN 'economy' THEN 0.7e0 ELSE 1.0e0 END AS qos_factor FROM jobs WHERE machine = '{_machine}'"""),
    )

# sync: half of the jobs are known, some of them with other sizes


def _synced(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    known = adapters.jobs(spark, sf_dir).where("machine = 'casper' AND submit IS NOT NULL").drop("cpu_hours", "gpu_hours", "memory_hours", "qos", "qos_factor", "memory_wasted")
    old = charged(known.where("id % 2 = 0").withColumn("memory", F.lit(1).cast("bigint")), "casper")
    new = known.withColumns({"file": F.lit("a"), "line": F.col("id")})
    jobs, _ = ingest.sync(old, new.unionByName(new.withColumn("line", F.col("line") + 1)), "casper", mode)
    return rounded(jobs.select("id", "memory", "cpu_hours", "memory_hours", "charge_version"))


for _mode, _kept in (("plain", "CASE WHEN id % 2 = 0 THEN 1 ELSE memory END"), ("upsert", "memory")):
    register(
        f"sync_{_mode}",
        lambda s, d, m=_mode: _synced(s, d, m),
        _with_jobs(f"""SELECT id, m AS memory, {_r('elapsed * numcpus / 3600.0e0')} AS cpu_hours, {_r('elapsed * COALESCE(m, 0) / (3600.0e0 * 1073741824)')} AS memory_hours, 1 AS charge_version
          FROM (SELECT *, {_kept} AS m FROM jobs WHERE machine = 'casper' AND submit IS NOT NULL) k"""),
    )



def _known_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.jobs(spark, sf_dir).where("machine = 'casper' AND submit IS NOT NULL").drop("cpu_hours", "gpu_hours", "memory_hours", "qos", "qos_factor", "memory_wasted")


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the jobs are stored, and the roll-up has some days; the log has all jobs."""
    known = _known_jobs(spark, sf_dir)
    old = charged(known.where("id % 2 = 0"), "casper")
    summary = rollup.daily_summary(old, START, END)
    return ingest.sync(old, known.withColumns({"file": F.lit("a"), "line": F.col("id")}), "casper", "incremental", summary=summary)[0].select("id", "charge_version")


def _wrong_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored jobs without charges: none at all, or placeholders."""
    jobs = charged(_known_jobs(spark, sf_dir), "casper")
    none, zero = F.lit(None).cast("int"), F.lit(0)
    hours = {c: F.lit(0.0) for c in ("cpu_hours", "gpu_hours", "memory_hours")}
    return jobs.withColumns({**hours, "charge_version": F.when(F.col("id") % 3 == 0, none).when(F.col("id") % 3 == 1, zero).otherwise(1)})


_CASPER = "machine = 'casper' AND submit IS NOT NULL"
_CPU_HOURS = _r("elapsed * numcpus / 3600.0e0")
register("sync_incremental", _incremental, _with_jobs(f"SELECT id, 1 AS charge_version FROM jobs WHERE {_CASPER} AND (id % 2 = 0 OR NOT COALESCE({WINDOW}, FALSE))"))
register(
    "sync_recalculate",
    lambda s, d: rounded(ingest.sync(_wrong_charges(s, d), None, "casper", "recalculate", START, END)[0].select("id", "cpu_hours")),
    _with_jobs(f"SELECT id, CASE WHEN {WINDOW} THEN {_CPU_HOURS} ELSE 0 END AS cpu_hours FROM jobs WHERE {_CASPER}"),
)
register(
    "sync_resummarize",
    lambda s, d: (lambda jobs: ingest.sync(jobs, None, "casper", "resummarize", START, END, rollup.daily_summary(jobs.where("id % 2 = 0"), START, END))[1].groupBy("date").agg(F.sum("job_count").alias("job_count")))(charged(_known_jobs(s, d), "casper")),
    _with_jobs(f"""SELECT CAST(x AS DATE) AS date, CAST(COALESCE(n, 0) AS BIGINT) AS job_count FROM (SELECT UNNEST(GENERATE_SERIES(TIMESTAMP '1996-03-01', TIMESTAMP '1996-06-30', INTERVAL '1' DAY)) AS x) c
      LEFT JOIN (SELECT {SITE_DAY} AS day, COUNT(*) AS n FROM jobs WHERE {_CASPER} AND {WINDOW} AND {_NAMED} GROUP BY 1) k ON CAST(x AS DATE) = k.day"""),
)
register(
    "missing_charges",
    lambda s, d: rounded(ingest.with_missing_charges(_wrong_charges(s, d), "casper").select("id", "cpu_hours", "charge_version")),
    _with_jobs(f"SELECT id, CASE WHEN id % 3 = 2 THEN 0 ELSE {_CPU_HOURS} END AS cpu_hours, 1 AS charge_version FROM jobs WHERE {_CASPER}"),
)

# log lines made from the jobs, parsed back


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.jobs(spark, sf_dir).where("end_ts IS NOT NULL")
    epoch = lambda c: F.coalesce(F.unix_timestamp(F.col(c).cast("timestamp")).cast("string"), F.lit("0"))
    hms = F.expr("format_string('%02d:%02d:%02d', elapsed div 3600, (elapsed div 60) % 60, elapsed % 60)")
    attributes = F.concat(
        F.lit("user="), F.coalesce("user", F.lit("nobody")), F.lit(' account="'), "account", F.lit('" queue='), F.coalesce("queue", F.lit("none")),
        F.lit(" jobname="), F.coalesce("name", F.lit("x")), F.lit(" ctime="), epoch("submit"), F.lit(" qtime="), epoch("submit"),
        F.lit(" etime="), F.when(F.col("id") % 10 == 0, F.lit("0")).otherwise(epoch("submit")), F.lit(" start="), F.when(F.col("id") % 7 == 0, F.lit("0")).otherwise(epoch("start")),
        F.lit(" end="), epoch("end_ts"), F.lit(" Exit_status="), "status", F.lit(" Resource_List.ncpus="), F.col("numcpus").cast("string"),
        F.lit(" Resource_List.nodect="), F.col("numnodes").cast("string"), F.lit(" Resource_List.mem="), (F.col("numnodes") * 2).cast("string"), F.lit("gb"),
        F.lit(" Resource_List.select="), F.col("numnodes").cast("string"), F.lit(":ncpus=4:mpiprocs=2:ompthreads="), F.col("ompthreads").cast("string"),
        F.lit(" resources_used.walltime="), hms, F.lit(" resources_used.mem="), F.col("numcpus").cast("string"), F.lit("kb"),
    )
    kind = F.when(F.col("id") % 4 == 1, F.lit("S")).otherwise(F.lit("E"))
    return rows.select(F.concat(F.lit("01/01/2026 00:00:00;"), kind, F.lit(";"), "job_id", F.lit(";"), attributes).alias("value"), F.col("id").alias("line"), F.lit("f").alias("file"))


register(
    "scheduler_log",
    lambda s, d: scheduler_log.in_order(scheduler_log.parse(_log_lines(s, d), "casper")).select("job_id", "user", "account", "elapsed", "numcpus", "mpiprocs", "ompthreads", "reqmem", "memory", "gputype", "start", "eligible"),
    _with_jobs("""SELECT job_id, COALESCE(usr, 'nobody') AS "user", account, CAST(elapsed AS INTEGER) AS elapsed, CAST(numcpus AS INTEGER) AS numcpus, 2 AS mpiprocs, CAST(ompthreads AS INTEGER) AS ompthreads,
      CAST(numnodes * 2 AS BIGINT) * 1073741824 AS reqmem, CAST(numcpus AS BIGINT) * 1024 AS memory, CASE queue WHEN 'a100' THEN 'a100' WHEN 'nvgpu' THEN 'v100' END AS gputype, start_ts AS start, submit AS eligible
      FROM jobs WHERE end_ts IS NOT NULL AND id % 4 <> 1"""),
)



def _archived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs parsed from log lines, and the records of most of them."""
    lines = stored(_log_lines(spark, sf_dir))
    return ingest.clean(scheduler_log.parse(lines, "casper")), records.archive(lines.where("line % 6 <> 0"))


_LOGGED = "end_ts IS NOT NULL AND submit IS NOT NULL AND id % 4 <> 1"
register(
    "records_found",
    lambda s, d: records.find(*_archived(s, d), filters=[(False, "ge", "Resource_List[ncpus]", 200), (True, "eq", "queue", "htc"), (False, "contains", "jobname", "run")], between=("06:00:00", "17:59:59")).select("job_id", F.col("record").getItem("Resource_List.ncpus").alias("ncpus")),
    _with_jobs(f"""SELECT job_id, CAST(numcpus AS STRING) AS ncpus FROM jobs WHERE {_LOGGED} AND id % 6 <> 0 AND numcpus >= 200 AND COALESCE(queue, 'none') <> 'htc' AND COALESCE(name, 'x') LIKE '%run%'
      AND STRFTIME(end_ts, '%H:%M:%S') BETWEEN '06:00:00' AND '17:59:59'"""),
)
register("records_missing", lambda s, d: records.without_record(*_archived(s, d)).select("job_id"), _with_jobs(f"SELECT job_id FROM jobs WHERE {_LOGGED} AND id % 6 = 0"))

# directories


def with_entries(body: str) -> str:
    return f"""WITH {ENTRIES_CTE}, dirs AS (SELECT path, parent FROM entries WHERE is_dir), files AS (SELECT * FROM entries WHERE NOT is_dir),
      own AS (SELECT parent AS path, COUNT(*) AS n, SUM(allocated) AS size, MAX(atime) AS atime, MIN(uid) AS lo, MAX(uid) AS hi, MIN(gid) AS glo, MAX(gid) AS ghi FROM files GROUP BY parent),
      inner_dirs AS (SELECT parent AS path, COUNT(*) AS n FROM dirs GROUP BY parent),
      rec AS (SELECT d.path, SUM(o.n) AS n, SUM(o.size) AS size, MAX(o.atime) AS atime, MIN(o.lo) AS lo, MAX(o.hi) AS hi, MIN(o.glo) AS glo, MAX(o.ghi) AS ghi
        FROM dirs d JOIN own o ON o.path = d.path OR STARTS_WITH(o.path, d.path || '/') GROUP BY d.path),
      recd AS (SELECT d.path, COUNT(*) AS n FROM dirs d JOIN dirs e ON STARTS_WITH(e.path, d.path || '/') GROUP BY d.path),
      tree AS (SELECT d.path, d.parent, CAST(LENGTH(d.path) - LENGTH(REPLACE(d.path, '/', '')) AS INTEGER) AS depth, COALESCE(o.n, 0) AS file_count_nr, CAST(COALESCE(o.size, 0) AS BIGINT) AS total_size_nr, COALESCE(i.n, 0) AS dir_count_nr,
          o.atime AS max_atime_nr, CAST(COALESCE(r.n, 0) AS BIGINT) AS file_count_r, CAST(COALESCE(r.size, 0) AS BIGINT) AS total_size_r, COALESCE(rd.n, 0) AS dir_count_r, r.atime AS max_atime_r,
          CAST(CASE WHEN r.n IS NULL THEN -1 WHEN r.lo = r.hi THEN r.lo END AS BIGINT) AS owner_uid, CAST(CASE WHEN r.n IS NULL THEN -1 WHEN r.glo = r.ghi THEN r.glo END AS BIGINT) AS owner_gid
        FROM dirs d LEFT JOIN own o ON d.path = o.path LEFT JOIN inner_dirs i ON d.path = i.path LEFT JOIN rec r ON d.path = r.path LEFT JOIN recd rd ON d.path = rd.path) {body}"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.entries(spark, sf_dir)


SCANNED = "1998-01-01 00:00:00"


def _directories(spark: SparkSession, sf_dir: str) -> DirectoryQueries:
    entries = _entries(spark, sf_dir)
    scans = spark.createDataFrame([("tank", SCANNED)], "filesystem string, t string").select("filesystem", F.col("t").cast("timestamp_ntz").alias("scan_timestamp"))
    histograms = tree.file_histograms(entries, F.lit(SCANNED).cast("timestamp_ntz")).withColumn("filesystem", F.lit("tank"))
    names = spark.createDataFrame([(1000, "root"), (1003, "ann")], "uid bigint, username string")
    return DirectoryQueries(tree.directories(entries).withColumn("filesystem", F.lit("tank")), scans, histograms, names)


_LISTED = ("path", "depth", "file_count_nr", "total_size_nr", "dir_count_nr", "max_atime_nr", "file_count_r", "total_size_r", "dir_count_r", "max_atime_r", "owner_uid", "owner_gid")
_LISTED_SQL = ", ".join(_LISTED)
register("directory_tree", lambda s, d: tree.directories(_entries(s, d)).select(*_LISTED), with_entries(f"SELECT {_LISTED_SQL} FROM tree"))
register(
    "directory_ids",
    lambda s, d: tree.directories(_entries(s, d)).select("dir_id", "parent_id", "name", "path", "anc_d1", "anc_d2", "anc_d3", "anc_d4"),
    with_entries("""SELECT a.dir_id, b.dir_id AS parent_id, SPLIT_PART(a.path, '/', -1) AS name, a.path, '/' || SPLIT_PART(a.path, '/', 2) AS anc_d1,
        CASE WHEN a.depth >= 2 THEN '/' || SPLIT_PART(a.path, '/', 2) || '/' || SPLIT_PART(a.path, '/', 3) END AS anc_d2, CASE WHEN a.depth >= 3 THEN a.path END AS anc_d3, CAST(NULL AS STRING) AS anc_d4
      FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY depth, path) - 1 AS dir_id FROM tree) a LEFT JOIN (SELECT path, ROW_NUMBER() OVER (ORDER BY depth, path) - 1 AS dir_id FROM tree) b ON a.parent = b.path"""),
)
DIRECTORY_FILTERS: dict[str, tuple[DirectoryFilters, str]] = {
    "scope": (DirectoryFilters(paths=["/ASIA", "/ASIA/CHINA", "/gpfs/csfs1/EUROPE"]), "(path = '/ASIA' OR path LIKE '/ASIA/%' OR path = '/EUROPE' OR path LIKE '/EUROPE/%')"),
    "exclude": (DirectoryFilters(paths=["/ASIA"], exclude=["/ASIA/CHINA"]), "(path = '/ASIA' OR path LIKE '/ASIA/%') AND NOT (path = '/ASIA/CHINA' OR path LIKE '/ASIA/CHINA/%')"),
    "depth": (DirectoryFilters(min_depth=2, max_depth=2), "depth = 2"),
    "owner": (DirectoryFilters(owner=1003), "owner_uid = 1003"),
    "single_owner": (DirectoryFilters(single_owner=True, single_group=True), "owner_uid IS NOT NULL AND owner_uid <> -1 AND owner_gid IS NOT NULL AND owner_gid <> -1"),
    "names": (DirectoryFilters(names=["c1?", "*INA"], ignore_case=True), "(LOWER(SPLIT_PART(path, '/', -1)) LIKE 'c1_' OR LOWER(SPLIT_PART(path, '/', -1)) LIKE '%ina')"),
    "leaves": (DirectoryFilters(leaves_only=True, min_files=12, recursive_counts=False), "dir_count_nr = 0 AND file_count_nr >= 12"),
    "size": (DirectoryFilters(min_size=10**11, max_size=2 * 10**11), "total_size_r BETWEEN 100000000000 AND 200000000000"),
    "accessed_before": (DirectoryFilters(accessed_before=datetime(1998, 5, 1)), "max_atime_r < TIMESTAMP '1998-05-01'"),
    "accessed_after": (DirectoryFilters(accessed_after=datetime(1998, 7, 20, 12), recursive_atime=False), "max_atime_nr > TIMESTAMP '1998-07-20 12:00:00'"),
    "group": (DirectoryFilters(group=102, max_files=9, max_dirs=0), "owner_gid = 102 AND file_count_r <= 9 AND dir_count_r <= 0"),
    "avg_size": (DirectoryFilters(min_avg_size=8 * 10**9, max_avg_size=10**10), "file_count_nr > 0 AND total_size_nr // file_count_nr >= 8000000000 AND total_size_nr // file_count_nr < 10000000000"),
}
for _name, (_filters, _where) in DIRECTORY_FILTERS.items():
    register(f"directories_{_name}", lambda s, d, f=_filters: _directories(s, d).list(f, limit=None).select(*_LISTED), with_entries(f"SELECT {_LISTED_SQL} FROM tree WHERE {_where}"))
register("directories_largest", lambda s, d: _directories(s, d).list(DirectoryFilters(min_depth=3), limit=50).select(*_LISTED), with_entries(f"SELECT {_LISTED_SQL} FROM tree WHERE depth >= 3 ORDER BY total_size_r DESC, path LIMIT 50"))
register("directories_oldest", lambda s, d: _directories(s, d).list(DirectoryFilters(min_depth=3), sort="atime", descending=False, limit=20).select(*_LISTED), with_entries(f"SELECT {_LISTED_SQL} FROM tree WHERE depth >= 3 ORDER BY max_atime_r ASC NULLS FIRST, path LIMIT 20"))
register("directory_totals", lambda s, d: _directories(s, d).total(), with_entries("SELECT 'tank' AS filesystem, COUNT(*) AS total_directories, CAST(SUM(file_count_nr) AS BIGINT) AS total_files, MAX(CASE WHEN parent = '' THEN total_size_r END) AS total_size FROM tree"))
for _entity in ("owner_uid", "owner_gid"):
    _sums = "CAST(SUM(total_size_nr) AS BIGINT) AS total_size, CAST(SUM(file_count_nr) AS BIGINT) AS total_files, COUNT(*) AS directory_count"
    register(f"{_entity}_summary", lambda s, d, e=_entity: tree.entity_summary(tree.directories(_entries(s, d)), e), with_entries(f"SELECT {_entity}, {_sums} FROM tree WHERE {_entity} >= 0 GROUP BY {_entity}"))
    register(
        f"{_entity}_scoped", lambda s, d, e=_entity: _directories(s, d).by_entity(e, DirectoryFilters(paths=["/ASIA"]), breakdown=True),
        with_entries(f"SELECT 'tank' AS filesystem, {_entity}, {_sums} FROM tree WHERE {_entity} >= 0 AND (path = '/ASIA' OR path LIKE '/ASIA/%') GROUP BY {_entity}"),
    )
register(
    "owner_names", lambda s, d: (lambda q: q.named(q.by_entity("owner_uid")).select("owner_uid", "username", "total_files"))(_directories(s, d)),
    with_entries("SELECT owner_uid, CASE owner_uid WHEN 1000 THEN 'root' WHEN 1003 THEN 'ann' ELSE CAST(owner_uid AS STRING) END AS username, CAST(SUM(file_count_nr) AS BIGINT) AS total_files FROM tree WHERE owner_uid >= 0 GROUP BY owner_uid"),
)


def age_case(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 9 " + " ".join(f"WHEN {column} > TIMESTAMP '{SCANNED}' - INTERVAL '{days}' DAY THEN {i}" for i, (_, days) in enumerate(buckets.ATIME_DAYS[:-1])) + " ELSE 9 END"


def size_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {top} THEN {i}" for i, (_, top) in enumerate(buckets.FILE_SIZES[:-1])) + " ELSE 9 END"


_BUCKETED = "CAST(SUM(file_count_nr) AS BIGINT) AS file_count, CAST(SUM(total_size_nr) AS BIGINT) AS total_size FROM tree WHERE file_count_nr > 0"
register("access_history", lambda s, d: _directories(s, d).access_history(by_owner=True), with_entries(f"SELECT {age_case('max_atime_nr')} AS bucket_index, owner_uid, {_BUCKETED} GROUP BY 1, 2"))
register("file_size_history", lambda s, d: _directories(s, d).file_sizes(DirectoryFilters(paths=["/ASIA"])), with_entries(f"SELECT {size_case('(total_size_nr // file_count_nr)')} AS bucket_index, {_BUCKETED} AND (path = '/ASIA' OR path LIKE '/ASIA/%') GROUP BY 1"))
for _kind, _case, _labels in (("access", age_case("atime"), buckets.ATIME_DAYS), ("size", size_case("allocated"), buckets.FILE_SIZES)):
    _values = ", ".join(f"({i}, '{label}')" for i, (label, _) in enumerate(_labels))
    register(
        f"file_histogram_{_kind}", lambda s, d, k=_kind: _directories(s, d).file_histogram(k),
        with_entries(f"""SELECT t.bucket_index, t.label, COALESCE(h.n, 0) AS file_count, CAST(COALESCE(h.size, 0) AS BIGINT) AS total_size FROM (VALUES {_values}) t(bucket_index, label)
          LEFT JOIN (SELECT {_case} AS b, COUNT(*) AS n, SUM(allocated) AS size FROM files GROUP BY 1) h ON t.bucket_index = h.b"""),
    )
register(
    "top_owners_by_age", lambda s, d: rounded(_directories(s, d).top_owners("access", 3), 6),
    with_entries(f"""SELECT bucket_index, owner_uid, CAST(total_size AS BIGINT) AS total_size, file_count, CAST(place AS INTEGER) AS place, ROUND(total_size / whole, 6) AS share, GREATEST(n - 3, 0) AS more FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY bucket_index ORDER BY total_size DESC, owner_uid) AS place, CAST(SUM(total_size) OVER (PARTITION BY bucket_index) AS DOUBLE) AS whole, COUNT(*) OVER (PARTITION BY bucket_index) AS n
        FROM (SELECT {age_case('atime')} AS bucket_index, uid AS owner_uid, SUM(allocated) AS total_size, COUNT(*) AS file_count FROM files GROUP BY 1, 2) g) r WHERE place <= 3"""),
)
register(
    "scan_metadata", lambda s, d: tree.scan_metadata(_entries(s, d), "scan.list", F.lit(SCANNED).cast("timestamp_ntz"), "tank"),
    with_entries(f"SELECT 'scan.list' AS source_file, TIMESTAMP '{SCANNED}' AS scan_timestamp, 'tank' AS filesystem, SUM(CASE WHEN is_dir THEN 1 ELSE 0 END)::BIGINT AS total_directories, SUM(CASE WHEN is_dir THEN 0 ELSE 1 END)::BIGINT AS total_files, SUM(CASE WHEN is_dir THEN 0 ELSE allocated END)::BIGINT AS total_size FROM entries"),
)


def _collections(spark: SparkSession, sf_dir: str) -> DirectoryQueries:
    """The same directories as one collection a region."""
    region = lambda df: df.withColumn("filesystem", F.lower(F.split("path", "/")[1]))
    entries = region(_entries(spark, sf_dir))
    at = F.lit(SCANNED).cast("timestamp_ntz")
    scans = entries.select("filesystem").distinct().withColumn("scan_timestamp", at)
    parts = [tree.file_histograms(entries.where(F.col("filesystem") == r), at).withColumn("filesystem", F.lit(r)) for r in ("africa", "america", "asia", "europe", "middle east")]
    return DirectoryQueries(region(tree.directories(_entries(spark, sf_dir))), scans, reduce(DataFrame.unionByName, parts))


for _kind, _file_case, _dir_case, _labels in (("access", age_case("atime"), age_case("max_atime_nr"), buckets.ATIME_DAYS), ("size", size_case("allocated"), size_case("(total_size_nr // file_count_nr)"), buckets.FILE_SIZES)):
    _values = ", ".join(f"({i}, '{label}')" for i, (label, _) in enumerate(_labels))
    register(
        f"histogram_mixed_{_kind}", lambda s, d, k=_kind: _collections(s, d).histogram(k, DirectoryFilters(paths=["/ASIA", "/EUROPE/FRANCE", "/EUROPE/FRANCE/x"])),
        with_entries(f"""SELECT t.bucket_index, t.label, CAST(COALESCE(SUM(h.n), 0) AS BIGINT) AS file_count, CAST(COALESCE(SUM(h.size), 0) AS BIGINT) AS total_size, TRUE AS approximate FROM (VALUES {_values}) t(bucket_index, label)
          LEFT JOIN (SELECT {_file_case} AS b, COUNT(*) AS n, SUM(allocated) AS size FROM files WHERE path LIKE '/ASIA/%' GROUP BY 1
            UNION ALL SELECT {_dir_case}, SUM(file_count_nr), SUM(total_size_nr) FROM tree WHERE file_count_nr > 0 AND (path = '/EUROPE/FRANCE' OR path LIKE '/EUROPE/FRANCE/%') GROUP BY 1) h ON t.bucket_index = h.b
          GROUP BY t.bucket_index, t.label"""),
    )


def _gpfs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).where("not is_dir")
    fields = F.concat(
        F.lit("s="), F.col("size").cast("string"), F.lit(" a="), (F.col("allocated") / 1024).cast("bigint").cast("string"), F.lit(" u="), F.col("uid").cast("string"), F.lit(" g="), F.col("gid").cast("string"),
        F.lit(" p=-rw-r--r-- ac="), F.date_format("atime", "yyyy-MM-dd HH:mm:ss"), F.lit(".123456"),
    )
    return rows.select(F.concat(F.lit("<1> 42 7 0 "), fields, F.lit(" -- "), "path").alias("value"))


def _lustre_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).where("not is_dir")
    fields = F.concat(
        F.lit("s="), F.col("size").cast("string"), F.lit(" b="), (F.col("allocated") / 512).cast("bigint").cast("string"), F.lit(" u="), F.col("uid").cast("string"), F.lit(" g="), F.col("gid").cast("string"),
        F.lit(" p=1 type=f perm=0644 a="), F.unix_timestamp(F.col("atime").cast("timestamp")).cast("string"), F.lit(" m=1 c=1"),
    )
    return rows.select(F.concat(F.lit("0x24a:0x1f:0x0 "), fields, F.lit(" -- "), "path").alias("value"))


_PARSED = "path, CAST(size AS BIGINT) AS size, CAST(allocated AS BIGINT) AS allocated, CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, is_dir, atime"
for _name, _lines, _parse in (("gpfs", _gpfs_lines, scan_log.parse_gpfs), ("lustre", _lustre_lines, scan_log.parse_lustre)):
    register(f"scan_log_{_name}", lambda s, d, f=_lines, p=_parse: p(f(s, d)).drop("inode", "fileset_id"), f"WITH {ENTRIES_CTE} SELECT {_PARSED} FROM entries WHERE NOT is_dir")


def imported(spark: SparkSession, sf_dir: str) -> DirectoryQueries:
    """A scan log of all entries, written as text, imported, and opened again."""
    rows = _entries(spark, sf_dir)
    fields = F.concat(
        F.lit("s="), F.col("size").cast("string"), F.lit(" a="), (F.col("allocated") / 1024).cast("bigint").cast("string"), F.lit(" u="), F.col("uid").cast("string"), F.lit(" g="), F.col("gid").cast("string"),
        F.when(F.col("is_dir"), F.lit(" p=drwxr-xr-x ac=")).otherwise(F.lit(" p=-rw-r--r-- ac=")), F.coalesce(F.date_format("atime", "yyyy-MM-dd HH:mm:ss"), F.lit("1990-01-01 00:00:00")),
    )
    root = fresh_path(spark, "import")
    logs = f"{root}/19980101_gpfs_tank.list.all.log"
    rows.select(F.concat(F.lit("<1> 42 7 0 "), fields, F.lit(" -- "), "path").alias("value")).write.text(logs)
    importer.import_scan(spark, logs, f"{root}/tables")
    return importer.open_collections(spark, f"{root}/tables")


register("imported_directories", lambda s, d: imported(s, d).list(limit=None).select("filesystem", "dir_id", *_LISTED), with_entries(f"SELECT 'tank' AS filesystem, ROW_NUMBER() OVER (ORDER BY depth, path) - 1 AS dir_id, {_LISTED_SQL} FROM tree"))
register(
    "imported_scans", lambda s, d: imported(s, d).scans.select("filesystem", "source_file", "scan_timestamp", "total_directories", "total_files", "total_size"),
    with_entries("SELECT 'tank' AS filesystem, '19980101_gpfs_tank.list.all.log' AS source_file, TIMESTAMP '1998-01-01' AS scan_timestamp, SUM(CASE WHEN is_dir THEN 1 ELSE 0 END)::BIGINT AS total_directories, SUM(CASE WHEN is_dir THEN 0 ELSE 1 END)::BIGINT AS total_files, SUM(CASE WHEN is_dir THEN 0 ELSE allocated END)::BIGINT AS total_size FROM entries"),
)
# A scan's name for every customer: two formats, one without a collection, one with a day that is none.
SCAN_NAMES_SQL = """SELECT CASE c_custkey % 4 WHEN 0 THEN '2026' || LPAD(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '15_gpfs_c' || CAST(c_custkey AS STRING) || '.list.all.log'
  WHEN 1 THEN '202512' || LPAD(CAST(c_custkey % 31 + 1 AS STRING), 2, '0') || '_desc' || CAST(c_custkey AS STRING) || '.lfs-scan'
  WHEN 2 THEN '20260229_c' || CAST(c_custkey AS STRING) || '.list' ELSE 'notes' || CAST(c_custkey AS STRING) || '.txt' END AS name, c_custkey AS k FROM {customer}"""
register(
    "scan_names", lambda s, d: s.sql(SCAN_NAMES_SQL, customer=s.read.parquet(f"{d}/customer.parquet")).select("name", scan_log.file_system(F.col("name")).alias("filesystem"), scan_log.scan_date(F.col("name")).alias("scanned")),
    f"""SELECT name, CASE k % 4 WHEN 0 THEN 'c' || k WHEN 1 THEN 'desc' || k WHEN 2 THEN 'c' || k ELSE '' END AS filesystem,
      CASE k % 4 WHEN 0 THEN MAKE_TIMESTAMP(2026, k % 12 + 1, 15, 0, 0, 0) WHEN 1 THEN MAKE_TIMESTAMP(2025, 12, k % 31 + 1, 0, 0, 0) END AS scanned FROM ({SCAN_NAMES_SQL.format(customer="customer")}) n""",
)
register("collections", lambda s, d: _collections(s, d).filesystems(), "SELECT LOWER(r_name) AS filesystem FROM region")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
