from datetime import datetime

import pytest
from pyspark.sql import functions as F

from usagelens.operators.directories import DirectoryFilters, DirectoryQueries, collapse, normalize
from usagelens.plans import tree

DAY = datetime(2026, 1, 10)
ENTRIES = [
    ("/a", 0, 0, 0, 0, True, DAY), ("/a/b", 0, 0, 0, 0, True, DAY), ("/a/b/c", 0, 0, 0, 0, True, DAY), ("/a/empty", 0, 0, 0, 0, True, DAY), ("/x", 0, 0, 0, 0, True, DAY),
    ("/a/f1", 10, 4096, 1, 5, False, datetime(2026, 1, 1)), ("/a/b/f2", 10, 1000, 1, 5, False, datetime(2025, 1, 1)), ("/a/b/c/f3", 10, 5 * 1024**3, 2, 5, False, datetime(2010, 1, 1)),
    ("/a/b/c/f4", 10, 10, 2, 5, False, None), ("/x/f5", 10, 7, 3, 6, False, datetime(2026, 1, 9)),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "path string, size bigint, allocated bigint, uid bigint, gid bigint, is_dir boolean, atime timestamp_ntz")


@pytest.fixture(scope="module")
def q(spark, entries):
    at = F.lit("2026-01-15 00:00:00").cast("timestamp_ntz")
    dirs = tree.directories(entries).withColumn("filesystem", F.lit("one")).unionByName(tree.directories(entries.where("path like '/x%'")).withColumn("filesystem", F.lit("two"))).cache()
    scans = spark.createDataFrame([("one", 1), ("two", 1)], "filesystem string, n int").select("filesystem", at.alias("scan_timestamp"))
    return DirectoryQueries(dirs, scans, tree.file_histograms(entries, at).withColumn("filesystem", F.lit("one")))


def test_recursive_statistics(q):
    rows = {r.path: r for r in q.directories.where("filesystem = 'one'").collect()}
    assert (rows["/a"].file_count_r, rows["/a"].total_size_r, rows["/a"].dir_count_r) == (4, 4096 + 1000 + 5 * 1024**3 + 10, 3)
    assert (rows["/a"].file_count_nr, rows["/a"].dir_count_nr) == (1, 2)
    assert [(rows[p].owner_uid, rows[p].owner_gid) for p in ("/a", "/a/b", "/a/b/c", "/a/empty", "/x")] == [(None, 5), (None, 5), (2, 5), (-1, -1), (3, 6)]
    assert rows["/a/empty"].max_atime_r is None and rows["/a/b"].max_atime_r == datetime(2025, 1, 1)


def test_ids_parents_and_ancestors(q):
    rows = {r.path: r for r in q.directories.where("filesystem = 'one'").collect()}
    assert [rows[p].dir_id for p in ("/a", "/x", "/a/b", "/a/empty", "/a/b/c")] == [0, 1, 2, 3, 4]
    assert rows["/a"].parent_id is None and rows["/a/b/c"].parent_id == 2
    assert (rows["/a/b/c"].anc_d1, rows["/a/b/c"].anc_d2, rows["/a/b/c"].anc_d3, rows["/a/b/c"].anc_d4) == ("/a", "/a/b", "/a/b/c", None)


def test_scopes():
    assert normalize("/glade/campaign/a/") == "/a" and normalize("/gpfs/csfs1") == "/" and normalize("/glade/campaigns/a") == "/glade/campaigns/a"
    assert collapse(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"] and collapse(["/", "/a"]) == ["/"]


def paths(df):
    return [r.path for r in df.collect()]


def test_listings(q):
    assert paths(q.list(DirectoryFilters(paths=["/a/b"]), filesystems=["one"])) == ["/a/b", "/a/b/c"]
    assert paths(q.list(DirectoryFilters(exclude=["/a"]))) == ["/x", "/x"]
    assert paths(q.list(limit=2)) == ["/a", "/a/b"]
    assert paths(q.list(DirectoryFilters(accessed_before=datetime(2025, 6, 1)), sort="path", descending=False)) == ["/a/b", "/a/b/c"]
    assert paths(q.list(DirectoryFilters(leaves_only=True, max_files=0), filesystems=["one"])) == ["/a/empty"]
    assert paths(q.list(DirectoryFilters(min_depth=0, names=["E*"], ignore_case=True))) == ["/a/empty"]
    assert paths(q.list(DirectoryFilters(paths=[]))) == []
    with pytest.raises(ValueError):
        q.list(sort="colour")


def test_summaries(q):
    total = {r.filesystem: r for r in q.total().collect()}
    assert (total["one"].total_directories, total["one"].total_files, total["two"].total_size) == (5, 5, 7)
    owners = {r.owner_uid: r for r in q.by_entity("owner_uid").collect()}
    assert set(owners) == {2, 3} and owners[3].total_files == 2
    assert q.by_entity("owner_uid", breakdown=True).count() == 3


def test_distributions(q):
    sizes = {r.bucket_index: r.file_count for r in q.file_histogram("size").collect()}
    assert sum(sizes.values()) == 5 and len(sizes) == 10 and sizes[0] == 3 and sizes[1] == 1 and sizes[7] == 1
    ages = {r.label: r.file_count for r in q.file_histogram("access").collect()}
    assert (ages["< 1 Month"], ages["1-2 Years"], ages["7+ Years"]) == (2, 1, 2)
    slow = {r.bucket_index: r.file_count for r in q.access_history(filesystems=["one"]).collect()}
    assert slow == {0: 2, 4: 1, 9: 2}
    by_size = {r.bucket_index: r.file_count for r in q.file_sizes(filesystems=["one"]).collect()}
    assert by_size == {0: 2, 1: 1, 7: 2}
    top = q.top_owners("size", 1).collect()
    assert all(r.place == 1 for r in top) and {r.bucket_index: r.more for r in top}[0] == 2
