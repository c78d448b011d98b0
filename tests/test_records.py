from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import line
from usagelens.functions import units
from usagelens.operators.directories import collection_of
from usagelens.plans import ingest
from usagelens.sinks import publish, writers
from usagelens.sources import records, scheduler_log


@pytest.fixture(scope="module")
def tables(spark):
    lines = [line("1.srv", exec_host="n1.x/0*8+n2.x/1*8"), line("2[4].srv", queue="vis", Resource_List__ncpus=64, exec_host="n3/0"), line("3.srv", jobname="test one".replace(" ", "_"), end=1_700_003_600), line("4.srv", kind="S")]
    rows = spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "value string, file string, line bigint")
    return ingest.clean(scheduler_log.parse(rows, "casper")).cache(), records.archive(rows).cache()


def ids(df):
    return sorted(r.job_id for r in df.collect())


def test_archive_keeps_all_attributes(tables):
    row = tables[1].where("job_id = '1.srv'").first()
    assert row.record["account"] == "ABCD0001" and row.record["Resource_List.select"].startswith("1:ncpus=8") and row.record["resources_used.mem"] == "1024kb"
    assert tables[1].count() == 3


@pytest.mark.parametrize(("options", "wanted"), [
    ({"ids": ["2[4].srv", "3", "x"]}, ["2[4].srv", "3.srv"]), ({"filters": [(False, "eq", "queue", "vis")]}, ["2[4].srv"]),
    ({"filters": [(True, "eq", "queue", "vis")]}, ["1.srv", "3.srv"]), ({"filters": [(False, "contains", "jobname", "test")]}, ["3.srv"]),
    ({"filters": [(False, "ge", "Resource_List[ncpus]", 64)]}, ["2[4].srv"]), ({"filters": [(True, "ge", "Resource_List[ncpus]", "64")]}, ["1.srv", "3.srv"]),
    ({"filters": [(True, "eq", "nothing", 1)]}, []), ({"hosts": ["n2", "n9"]}, ["1.srv"]), ({"between": ("23:00:00", "23:59:59")}, ["3.srv"]),
])
def test_finding(tables, options, wanted):
    assert ids(records.find(*tables, **options)) == wanted


def test_jobs_without_a_record(tables):
    jobs, archived = tables
    assert ids(records.without_record(jobs, archived.where("job_id <> '3.srv'"))) == ["3.srv"]
    with pytest.raises(ValueError):
        records.find(jobs, archived, filters=[(False, "like", "nothing", 1)])


def test_units():
    assert [units.parse_size(t) for t in ("1GiB", "500MB", "2T", "0", "1.5k", "7 b")] == [2**30, 500_000_000, 2 * 2**40, 0, 1536, 7]
    assert [units.parse_count(t) for t in ("500", "1K", "10m")] == [500, 1000, 10_000_000]
    today = datetime(2026, 1, 31)
    assert units.parse_date("2024-01-15") == datetime(2024, 1, 15) and units.parse_date("3yrs", today) == datetime(2023, 1, 31)
    assert units.parse_date("18mo", today) == datetime(2024, 7, 28) and units.parse_date("1yr", datetime(2024, 2, 29)) == datetime(2023, 2, 28)
    assert units.format_size(None) == "N/A" and units.format_size(1536) == "1.5 KiB" and units.format_size(2**62) == "4.0 EiB"
    for bad in ("1XB", "", "-1"):
        with pytest.raises(ValueError):
            units.parse_size(bad)


def test_collections():
    assert [collection_of(p) for p in ("/glade/campaign/CISL/csg", "/gpfs/csfs1/aiml", "/", "")] == ["cisl", "aiml", None, None]


def test_publish_replaces_a_table(spark):
    publish.publish(spark.range(3), "published")
    publish.publish(spark.range(5).withColumn("k", F.col("id") % 2), "published", ("k",))
    assert spark.table("published").count() == 5
    assert not [t.name for t in spark.catalog.listTables() if t.name.endswith(("_old", "_staging"))]
    spark.sql("DROP TABLE published")


def test_job_listing():
    text = writers.job_listing([{"id": 1, "job_id": "1.srv", "numnodes": 2, "cpu_hours": 1.5, "end": None}])
    assert text.splitlines() == ["Job ID                  Nodes   CPU-h       End", "1.srv                   2       1.50"]
