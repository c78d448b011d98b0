"""Tables that several syncs and streams keep: one job a row, one commit, finished after a lost driver."""

import re
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import line, parsed
from usagelens import table_queries
from usagelens.operators.directories import DirectoryFilters
from usagelens.plans import distinct, importer, ingest, tree
from usagelens.sinks import commit
from usagelens.streaming.ingest import stream_logs

DAY = 86_400
# A requeued job with a record on the 14th and on the 16th, one that is late, one without a submit time, and others.
LOGS = {
    14: [line("1.srv"), line("2.srv"), line("6.srv", ctime="", etime="")],
    15: [line("3.srv", end=1_700_000_120 + DAY), line(kind="S")],
    16: [line("1.srv", end=1_700_000_120 + 2 * DAY, run_count=2, resources_used__mem="4096kb"), line("4.srv"), line("5.srv", end=1_700_000_120 + 2 * DAY), line("6.srv", ctime="", etime="")],
}


class Tables:
    def __init__(self, spark, root, days=(14, 15, 16)):
        self.spark, self.root = spark, Path(root)
        (self.root / "logs").mkdir(parents=True)
        self.add(*days)

    def add(self, *days):
        for d in days:
            (self.root / "logs" / f"202311{d}").write_text("\n".join(LOGS[d]) + "\n")

    def sync(self, first, last, mode="plain"):
        return ingest.sync_days(self.spark, f"{self.root}/logs", f"{self.root}/jobs", f"{self.root}/summary", "casper", date(2023, 11, first), date(2023, 11, last), mode)

    def stream(self, mode="plain"):
        stream_logs(self.spark, f"{self.root}/logs", f"{self.root}/jobs", f"{self.root}/checkpoint", "casper", f"{self.root}/summary", mode).awaitTermination()

    def rows(self):
        jobs = ingest.open_jobs(self.spark, f"{self.root}/jobs")
        days = self.spark.read.parquet(f"{self.root}/summary")
        told = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        return told(jobs), told(days)

    def files(self, table="jobs"):
        return {p.parent.name: p.name for p in (self.root / table).glob("*/*/part-*")}


@pytest.mark.parametrize("mode", ["plain", "upsert"])
def test_days_apart_and_together(spark, tmp_path, mode):
    together, apart, streamed = (Tables(spark, tmp_path / n, days) for n, days in (("together", (14, 15, 16)), ("apart", (14, 15, 16)), ("streamed", (14,))))
    together.sync(14, 16, mode)
    for day in (14, 15, 16):
        apart.sync(day, day, mode)
    streamed.stream(mode)
    streamed.add(15, 16)
    streamed.stream(mode)
    want = together.rows()
    assert apart.rows() == want and streamed.rows() == want
    jobs = {r.job_id: r for r in spark.read.parquet(f"{together.root}/jobs").collect()}
    assert len(want[0]) == len(jobs) == 6
    assert (jobs["1.srv"].end_date.day, jobs["1.srv"].memory) == (14, 2**22 if mode == "upsert" else 2**20)
    # The late job counts on the day it ended, though that was rolled up before.
    days = spark.read.parquet(f"{apart.root}/summary").groupBy("date").sum("job_count").collect()
    assert {r.date.day: r[1] for r in days} == {14: 4, 15: 1, 16: 1}
    users = [distinct.unique_by_period(spark.read.parquet(f"{t.root}/summary{distinct.BITMAPS}"), "user", period="month").collect() for t in (together, apart, streamed)]
    assert users[0] == users[1] == users[2] and users[0][0].n == 1
    before = apart.files()
    apart.sync(14, 16, "plain")
    assert apart.files() == before and apart.rows() == want


def test_only_partitions_that_the_index_names_are_replaced(spark, tmp_path):
    t = Tables(spark, tmp_path / "t")
    t.sync(14, 15)
    jobs, keys = t.files(), t.files("jobs-keys")
    t.sync(16, 16)  # job 4 ends on the 14th, job 5 on the 16th
    changed = {p for p in jobs if t.files()[p] != jobs[p]}
    assert changed == {"end_date=2023-11-14"} and set(t.files()) - set(jobs) == {"end_date=2023-11-16"}
    assert {p for p in keys if t.files("jobs-keys")[p] != keys[p]} == {"submit_date=2023-11-14"}
    held = spark.read.parquet(f"{t.root}/jobs-keys").where(ingest._among("submit_date", {date(2023, 11, 14), None}))
    assert re.search(r"PartitionFilters: \[[^\]]*submit_date", held._jdf.queryExecution().toString())


def test_a_table_without_keys_gets_them(spark, tmp_path):
    t = Tables(spark, tmp_path / "t")
    ingest.write_jobs(ingest.charged(ingest.clean(parsed(spark, LOGS[14])), "casper"), f"{t.root}/jobs")
    t.sync(16, 16)
    assert sorted(r.job_id for r in spark.read.parquet(f"{t.root}/jobs").collect()) == ["1.srv", "2.srv", "4.srv", "5.srv", "6.srv"]


@pytest.mark.parametrize("lost", ["before the journal", "between two moves"])
def test_a_lost_driver_leaves_no_half_of_a_sync(spark, tmp_path, monkeypatch, lost):
    t, whole = Tables(spark, tmp_path / "t"), Tables(spark, tmp_path / "whole")
    t.sync(14, 14)
    old = t.rows()
    for first, last in ((14, 14), (15, 16)):
        whole.sync(first, last)

    with monkeypatch.context() as m:
        if lost == "before the journal":
            m.setattr(commit, "_partitions", lambda *told: 1 / 0)
        else:
            m.setattr(commit, "recover", half_recovered(commit.recover))
        with pytest.raises(ZeroDivisionError):
            t.sync(15, 16)
    assert t.rows()[0] == (old if lost == "before the journal" else whole.rows())[0]
    t.sync(15, 16)
    assert t.rows() == whole.rows() and not list((t.root / "jobs-changes").iterdir())


def half_recovered(recover):
    """Stops where every second move has been made."""

    def stopped(spark, folder):
        fs, path = commit.file_system(spark, folder)
        journal = path(f"{folder}/{commit.JOURNAL}")
        if not fs.exists(journal):
            return recover(spark, folder)
        for staged, final in commit.json.loads(spark.read.text(journal.toString(), wholetext=True).first()[0])["moves"][::2]:
            fs.delete(path(final), True)
            fs.mkdirs(path(final).getParent())
            fs.rename(path(staged), path(final))
        raise ZeroDivisionError

    return stopped


ENTRIES = "path string, size bigint, allocated bigint, uid bigint, gid bigint, is_dir boolean, atime timestamp_ntz"


def scanned(spark, extra=()):
    at = datetime(2025, 1, 1)
    rows = [("/t", 0, 0, 0, 0, True, at), ("/t/a", 0, 0, 0, 0, True, at), ("/t/a/b", 0, 0, 0, 0, True, at), ("/t/c", 0, 0, 0, 0, True, at)]
    rows += [(f"/t/a/x{i}", 1, 4096 << i, 7 + i % 2, 1, False, datetime(2024 - i, 5, 1)) for i in range(4)]
    rows += [("/t/a/b/y", 1, 10**9, 9, 1, False, None), ("/t/c/z", 1, 10, 7, 1, False, at), *extra]
    return spark.createDataFrame(rows, ENTRIES)


def test_exact_histograms_of_scopes(spark, tmp_path):
    entries, at = scanned(spark), datetime(2025, 1, 15)
    importer.import_entries(entries, f"{tmp_path}/tables", "tank", at)
    q = importer.open_collections(spark, f"{tmp_path}/tables")
    under = {None: "true", "/t/a": "path LIKE '/t/a/%'", "/t/a/b/": "path LIKE '/t/a/b/%'", "/": "true", "/nowhere": "false"}
    for kind in ("access", "size"):
        for path, files in under.items():
            for owner in (None, 7):
                told = q.exact_histogram(kind, DirectoryFilters(paths=None if path is None else [path]), owner, by_owner=True)
                rows = entries.where(files).where("true" if owner is None else f"uid = {owner}")
                want = tree.file_histograms(rows, F.lit(at).cast("timestamp_ntz")).where(F.col("kind") == kind).select("bucket_index", "owner_uid", "file_count", "total_size")
                assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    some = q.exact_histogram("size", DirectoryFilters(paths=["/t"], exclude=["/t/a/b"], min_files=2)).agg(F.sum("file_count")).first()[0]
    assert some == 4  # in /t itself and /t/a; /t/c has one file
    plan = q.exact_histogram("size", DirectoryFilters(paths=["/t/a"]))._jdf.queryExecution().toString()
    assert "EqualTo(path,/t/a)" in plan or "In(path, [/t/a])" in plan


@pytest.mark.parametrize("lost", ["before the journal", "between two moves"])
def test_a_lost_driver_leaves_no_half_of_an_import(spark, tmp_path, monkeypatch, lost):
    root, at = f"{tmp_path}/tables", datetime(2025, 1, 15)
    importer.import_entries(scanned(spark), root, "tank", at)
    with monkeypatch.context() as m:
        if lost == "before the journal":
            m.setattr(commit, "_partitions", lambda *told: 1 / 0)
        else:
            m.setattr(commit, "recover", half_recovered(commit.recover))
        with pytest.raises(ZeroDivisionError):
            importer.import_entries(scanned(spark, [("/t/c/new", 1, 5, 7, 1, False, at)]), root, "tank", at)
    q, files = importer.open_collections(spark, root), 6 if lost == "before the journal" else 7
    assert q.scans.first().total_files == files and q.file_histogram("size").agg(F.sum("file_count")).first()[0] == files
    assert q.exact_histogram("size").agg(F.sum("file_count")).first()[0] == files and q.total().first().total_files == files


def test_a_stream_takes_records_up_only(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_logs(spark, str(tmp_path), str(tmp_path), str(tmp_path), "casper", mode="recalculate")


def test_every_query_has_its_oracle():
    assert set(table_queries.oracle_sql()) == set(table_queries.queries())
