from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from usagelens.operators.directories import DirectoryFilters
from usagelens.plans import importer, ingest
from usagelens.sinks import writers
from usagelens.sources import scheduler_log, scan_log
from usagelens.streaming.ingest import stream_logs


def line(job="1.srv", kind="E", **changed):
    told = {
        "user": "ann", "account": '"ABCD0001"', "queue": "htc", "jobname": "run.sh", "ctime": 1_700_000_000, "qtime": 1_700_000_000, "etime": 1_700_000_000,
        "start": 1_700_000_060, "end": 1_700_000_120, "Exit_status": 0, "eligible_time": "00:00:33", "run_count": 1, "Resource_List.ncpus": 8, "Resource_List.nodect": 1,
        "Resource_List.mem": "10gb", "Resource_List.walltime": "01:00:00", "Resource_List.job_priority": "premium",
        "Resource_List.select": "1:ncpus=8:mpiprocs=4:ompthreads=1:ompthreads=2", "resources_used.walltime": "00:01:00", "resources_used.mem": "1024kb", "resources_used.vmem": "2048kb",
    }
    told.update({k.replace("__", "."): v for k, v in changed.items()})
    return f"01/01/2026 00:00:00;{kind};{job};" + " ".join(f"{k}={v}" for k, v in told.items() if v is not None)


def parsed(spark, lines, machine="casper"):
    rows = spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, file string, line bigint")
    return scheduler_log.parse(rows, machine)


def test_record(spark):
    row = parsed(spark, [line("12[3].srv"), line(kind="S"), "rubbish", "a;E;only three"]).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.job_id, r.short_id, r.user, r.account, r.queue, r.name, r.status) == ("12[3].srv", 12, "ann", "ABCD0001", "htc", "run.sh", "0")
    assert (r.elapsed, r.walltime, r.eligible_secs, r.numcpus, r.numgpus, r.mpiprocs, r.ompthreads) == (60, 3600, 33, 8, None, 4, 2)
    assert (r.reqmem, r.memory, r.vmemory, r.priority) == (10 * 1024**3, 1024**2, 2 * 1024**2, "premium")
    assert r.submit == datetime(2023, 11, 14, 22, 13, 20) and r.end_ts == datetime(2023, 11, 14, 22, 15, 20)


@pytest.mark.parametrize(("changed", "column", "value"), [
    ({"account": None}, "account", "none"), ({"eligible_time": None}, "eligible_secs", None), ({"eligible_time": "90"}, "eligible_secs", 90),
    ({"eligible_time": "1:2"}, "eligible_secs", None), ({"Resource_List__mem": "100mb"}, "reqmem", None), ({"Resource_List__mem": "1.5GB"}, "reqmem", 3 * 2**29),
    ({"resources_used__mem": "x"}, "memory", None), ({"etime": 0}, "eligible", datetime(2023, 11, 14, 22, 13, 20)),
    ({"start": 0}, "start", datetime(2023, 11, 14, 22, 14, 20)), ({"queue": "a100"}, "gputype", "a100"), ({"queue": "nvgpu"}, "gputype", "v100"),
    ({"Resource_List__select": "1:cpu_type=genoa", "queue": "a100"}, "gputype", None), ({"Resource_List__select": None, "Resource_List__mpiprocs": 7}, "mpiprocs", 7),
    ({"Exit_status": 271}, "status", "271"), ({"run_count": "x"}, "run_count", None), ({"qtime": None}, "queued", None),
])
def test_fields(spark, changed, column, value):
    assert parsed(spark, [line(**changed)]).first()[column] == value


def test_cpu_type_by_machine(spark):
    assert parsed(spark, [line()], "derecho").first().cputype == "milan" and parsed(spark, [line()]).first().cputype is None


def test_order_and_duplicates(spark):
    rows = parsed(spark, [line("1.srv"), line("1.srv", queue="vis"), line("2.srv", start=1_600_000_000), line("3.srv", etime="")])
    assert {r.job_id for r in scheduler_log.in_order(rows).collect()} == {"1.srv", "3.srv"}
    assert [r.queue for r in ingest.clean(rows).where("job_id = '1.srv'").collect()] == ["htc"]
    assert ingest.rejected(rows).first()[0] == 1


def test_days_are_read_from_files(spark, tmp_path):
    for day in ("20260101", "20260102"):
        (tmp_path / day).write_text(line(f"{day}.srv") + "\n" + line(kind="Q") + "\n")
    rows = scheduler_log.read_days(spark, str(tmp_path), [date(2026, 1, 1), date(2026, 1, 2)])
    assert sorted(r.job_id for r in scheduler_log.parse(rows, "casper").collect()) == ["20260101.srv", "20260102.srv"]


def test_sync_modes(spark):
    old, _ = ingest.sync(spark.createDataFrame([], ingest.charged(ingest.clean(parsed(spark, [])), "casper").schema), parsed(spark, [line("1.srv"), line("2.srv")]), "casper")
    old = old.cache()
    assert old.count() == 2 and old.first().cpu_hours == pytest.approx(8 * 60 / 3600) and old.first().qos_factor == 1.5
    new = parsed(spark, [line("2.srv", resources_used__mem="4096kb"), line("3.srv")])
    plain = {r.job_id: r.memory for r in ingest.sync(old, new, "casper")[0].collect()}
    assert plain == {"1.srv": 2**20, "2.srv": 2**20, "3.srv": 2**20}
    upserted = {r.job_id: (r.memory, r.memory_hours) for r in ingest.sync(old, new, "casper", "upsert")[0].collect()}
    assert upserted["2.srv"] == (2**22, pytest.approx(60 * 2**22 / 3600 / 2**30)) and len(upserted) == 3
    day = date(2023, 11, 14)
    jobs, summary = ingest.sync(old, new, "casper", start=day, end=day)
    assert [(r.date, r.job_count) for r in summary.collect()] == [(day, 3)]
    later, _ = ingest.sync(old, parsed(spark, [line("9.srv")]), "casper", "incremental", summary=summary)
    assert later.count() == 2
    wrong = old.withColumn("cpu_hours", F.lit(0.0))
    assert ingest.sync(wrong, None, "casper", "recalculate", day, day)[0].first().cpu_hours > 0
    assert ingest.with_missing_charges(wrong.withColumn("charge_version", F.lit(0)), "casper").first().cpu_hours > 0
    _, again = ingest.sync(old, None, "casper", "resummarize", day, day, summary)
    assert again.first().job_count == 2
    with pytest.raises(ValueError):
        ingest.sync(old, new, "casper", "other")


def test_written_partitions(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    jobs = ingest.charged(ingest.clean(parsed(spark, [line("1.srv"), line("2.srv", end=1_700_100_000)])), "casper")
    path = f"file://{tmp_path}/jobs"
    ingest.write_jobs(jobs, path)
    ingest.write_jobs(jobs.where("job_id = '1.srv'"), path)
    assert spark.read.parquet(path).count() == 2
    assert sorted(p.name for p in (tmp_path / "jobs" / "machine=casper").iterdir()) == ["end_date=2023-11-14", "end_date=2023-11-16"]


def test_stored_tables_follow_the_logs(spark, tmp_path):
    logs, jobs, summary = tmp_path / "logs", f"{tmp_path}/jobs", f"{tmp_path}/summary"
    logs.mkdir()
    sync = lambda first, last, mode="plain": ingest.sync_days(spark, str(logs), jobs, summary, "casper", date(2023, 11, first), date(2023, 11, last), mode)
    table = lambda: {r.job_id: r for r in spark.read.parquet(jobs).collect()}
    days = lambda: {(r.date.day, r.job_count) for r in spark.read.parquet(summary).collect()}
    (logs / "20231114").write_text(line("1.srv") + "\n" + line("2.srv") + "\n")
    (logs / "20231115").write_text(line(kind="Q") + "\n")
    assert sync(14, 16) == ingest.Synced([date(2023, 11, 14), date(2023, 11, 15)], [], [date(2023, 11, 16)])
    assert set(table()) == {"1.srv", "2.srv"} and days() == {(14, 2), (15, 0)}
    (logs / "20231116").write_text(line("3.srv", end=1_700_150_000) + "\n")
    told = sync(14, 16, "incremental")
    assert [d.day for d in told.read] == [16] and [d.day for d in told.skipped] == [14, 15] and not told.failed
    assert set(table()) == {"1.srv", "2.srv", "3.srv"} and days() == {(14, 2), (15, 0), (16, 1)}
    (logs / "20231114").write_text(line("1.srv", resources_used__mem="4096kb") + "\n" + line("4.srv") + "\n")
    sync(14, 14)
    assert table()["1.srv"].memory == 2**20 and "4.srv" in table() and (14, 3) in days()
    sync(14, 14, "upsert")
    assert table()["1.srv"].memory == 2**22 and len(table()) == 4
    for mode in ("recalculate", "resummarize"):
        sync(14, 16, mode)
        assert len(table()) == 4 and days() == {(14, 3), (15, 0), (16, 1)} and all(r.cpu_hours > 0 for r in table().values())
    with pytest.raises(ValueError):
        sync(14, 14, "other")


def test_stream_gives_the_batch_result(spark, tmp_path):
    logs, table, checkpoint = tmp_path / "logs", f"{tmp_path}/table", f"file://{tmp_path}/checkpoint"
    logs.mkdir()
    (logs / "20260101").write_text(line("1.srv") + "\n" + line("2.srv") + "\n")
    stream_logs(spark, str(logs), table, checkpoint, "casper").awaitTermination()
    (logs / "20260102").write_text(line("2.srv") + "\n" + line("3.srv") + "\n")
    stream_logs(spark, str(logs), table, checkpoint, "casper").awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted(r.job_id for r in rows) == ["1.srv", "2.srv", "3.srv"] and all(r.cpu_hours > 0 for r in rows)


GPFS = [
    "<1> 42 7 0  s=100 a=0 u=1000 g=10 p=-rw-r--r-- ac=2025-01-02 03:04:05.678 -- /fs/a/x", "<2> 43 7 0  s=9000 a=0 u=1000 g=10 p=-rw-r--r-- ac=2025-01-02 03:04:05 -- /fs/a/y z",
    "<3> 44 7 0  s=1 a=8 u=0 g=0 p=drwxr-xr-x ac=2025-01-02 03:04:05 -- /fs/a", "<4> 45 7 0  s=1 u=0 g=0 p=-rw ac=2025-01-02 03:04:05 -- /fs/lacks/a", "rubbish",
]
LUSTRE = ["0x1:0x2:0x0 s=5 b=8 u=1 g=2 p=1 type=f perm=0644 a=0 m=1 c=1 -- /l/x", "0x1:0x2:0x0 s=5 b=8 u=1 g=2 type=l a=0 -- /l/link", "0x1:0x2:0x0 s=4096 b=16 u=1 g=2 type=d a=86400 -- /l"]


def test_scan_lines(spark):
    rows = {r.path: r for r in scan_log.parse_gpfs(spark.createDataFrame([(x,) for x in GPFS], "value string")).collect()}
    assert set(rows) == {"/fs/a/x", "/fs/a/y z", "/fs/a"}
    assert (rows["/fs/a/x"].allocated, rows["/fs/a/y z"].allocated, rows["/fs/a"].allocated, rows["/fs/a"].is_dir) == (100, 0, 8192, True)
    assert rows["/fs/a/x"].atime == datetime(2025, 1, 2, 3, 4, 5) and rows["/fs/a/x"].inode == 42
    lustre = {r.path: r for r in scan_log.parse_lustre(spark.createDataFrame([(x,) for x in LUSTRE], "value string")).collect()}
    assert set(lustre) == {"/l/x", "/l"} and lustre["/l/x"].allocated == 4096 and lustre["/l"].atime == datetime(1970, 1, 2)


def test_scan_names(spark):
    assert scan_log.detect("20260115_csfs1_tank.list.list_all.log") == "gpfs" and scan_log.detect("20260115_desc1.lfs-scan") == "lustre"
    with pytest.raises(ValueError):
        scan_log.detect("20260115_desc1.lustre.log")
    scan_log.register_format("other", scan_log.parse_gpfs, lambda name: name.endswith(".other"))
    assert scan_log.detect("a.other") == "other" and scan_log.FORMATS.pop("other")
    with pytest.raises(ValueError):
        scan_log.detect("notes.txt")
    row = spark.createDataFrame([("20260115_csfs1_tank.list.list_all.log",)], "n string").select(scan_log.file_system(F.col("n")), scan_log.scan_date(F.col("n"))).first()
    assert tuple(row) == ("tank", datetime(2026, 1, 15))


def test_writers(spark):
    rows = writers.rows_of(spark.createDataFrame([(1, "a|b", None), (2, "c", 0.5)], "n int, s string, x double"))
    assert writers.as_csv(rows) == "n,s,x\n1,a|b,\n2,c,0.5\n"
    assert writers.as_tsv(rows).startswith("n\ts\tx\n")
    assert writers.as_markdown(rows).splitlines()[2] == "| 1 | a\\|b |  |" and writers.as_markdown([]) == ""
    assert writers.as_fixed_width(rows, {"n": 3, "x": 6}, {"x": ".2f"}).splitlines() == ["n    x", "1", "2    0.50"]
    assert '"when": "2025-01-01"' in writers.as_json([{"when": date(2025, 1, 1), "who": {"b", "a"}}], "listing")


def test_import_replaces_one_collection(spark, tmp_path):
    root = f"{tmp_path}/tables"
    for name, lines in (("20260115_gpfs_tank.list.all.log", GPFS), ("20260116_gpfs_pool.list.all.log", GPFS[:3]), ("20260117_gpfs_tank.list.all.log", GPFS[:1] + GPFS[2:3])):
        (tmp_path / name).write_text("\n".join(lines))
        importer.import_scan(spark, f"{tmp_path}/{name}", root)
    q = importer.open_collections(spark, root, groups=spark.createDataFrame([(10, "staff")], "gid bigint, groupname string"))
    assert sorted((r.filesystem, r.total_files) for r in q.scans.collect()) == [("pool", 2), ("tank", 1)]
    assert sorted((r.filesystem, r.path, r.file_count_r) for r in q.directories.collect()) == [("pool", "/fs/a", 2), ("tank", "/fs/a", 1)]
    assert q.group_id("staff") == 10 and q.group_id("7") == 7
    with pytest.raises(ValueError):
        q.group_id("nobody")
    assert q.scope(["/tank", "/tank/x", "/other/y"]) == (["tank"], ["pool"], ["/other/y"]) and q.scope(None)[0] == ["pool", "tank"]
    exact, mixed = q.histogram("size").collect(), q.histogram("size", DirectoryFilters(paths=["/tank", "/fs/a"])).collect()
    assert sum(r.file_count for r in exact) == 3 and not exact[0].approximate and sum(r.file_count for r in mixed) == 3 and mixed[0].approximate
    with pytest.raises(ValueError):
        importer.import_scan(spark, f"{tmp_path}/notes", root)
