from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usagelens.functions import buckets, charging, patterns, timewin


@pytest.mark.parametrize("dimension", list(buckets.DIMENSIONS))
@pytest.mark.parametrize("machine", [None, "casper", "derecho"])
def test_band_tables_are_closed(dimension, machine):
    buckets.check_bands(buckets.histogram_bands(dimension, machine))


@pytest.mark.parametrize("bad", [
    [], [("a", 0, 1), ("a", 2, None)], [("a", 1, None)], [("a", 0, 5)], [("a", 0, 1), ("b", 3, None)], [("a", 0, None), ("b", 2, None)],
])
def test_malformed_tables_are_refused(bad):
    with pytest.raises(ValueError):
        buckets.check_bands(bad)


def test_caps():
    assert buckets.histogram_bands("gpus", "casper")[-1] == (">16", 17, None)
    assert buckets.histogram_bands("nodes", "casper")[-1] == (">64", 65, None)
    with pytest.raises(ValueError):
        buckets.capped(buckets.DIMENSIONS["cpus"][0], 0)
    with pytest.raises(ValueError):
        buckets.histogram_bands("colour")


def test_labels_of_values(spark):
    rows = spark.createDataFrame([(None,), (-5,), (0,), (1,), (3,), (128,), (129,), (10**9,)], "v bigint")
    bands = buckets.histogram_bands("nodes")
    told = [r[0] for r in rows.select(buckets.band_label(F.col("v"), bands)).collect()]
    assert told == [None, "0", "0", "1", "3-4", "65-128", "129-256", ">2048"]
    ranges = [r[0] for r in rows.select(buckets.range_label(F.col("v"), "gpu")).collect()]
    assert ranges == [">320", ">320", ">320", ">320", ">320", "97-128", "129-256", ">320"]
    half = spark.createDataFrame([(10.5,), (0.2,), (4.0,)], "v double")
    assert [r[0] for r in half.select(buckets.range_label(F.col("v"), "memory")).collect()] == [">1000", ">1000", "1-10"]


def test_site_windows_and_bands_over_clock_changes():
    assert timewin.site_bounds(date(2025, 6, 1), date(2025, 6, 1)) == (datetime(2025, 6, 1, 6), datetime(2025, 6, 2, 6))
    assert timewin.site_bounds(date(2025, 1, 15), None) == (datetime(2025, 1, 15, 7), None)
    days = timewin.bands(date(2026, 3, 7), date(2026, 3, 9), "day")
    assert [(b["utc_end"] - b["utc_start"]) / timedelta(hours=1) for b in days] == [24, 23, 24]
    assert [(b["utc_end"] - b["utc_start"]) / timedelta(hours=1) for b in timewin.bands(date(2025, 11, 2), date(2025, 11, 2), "day")] == [25]
    weeks = timewin.bands(date(2025, 12, 30), date(2026, 1, 13), "week")
    assert [(b["label"], b["start"], b["end"]) for b in weeks] == [
        ("2026-W01", date(2025, 12, 30), date(2026, 1, 4)), ("2026-W02", date(2026, 1, 5), date(2026, 1, 11)), ("2026-W03", date(2026, 1, 12), date(2026, 1, 13)),
    ]
    assert [b["label"] for b in timewin.bands(date(2025, 11, 20), date(2026, 1, 2), "month")] == ["2025-11", "2025-12", "2026-01"]
    with pytest.raises(ValueError):
        timewin.bands(date(2020, 1, 1), date(2022, 1, 1), "day")
    with pytest.raises(ValueError):
        timewin.bands(date(2020, 1, 1), date(2020, 1, 2), "hour")


def test_site_days_in_columns(spark):
    rows = spark.createDataFrame([("2025-06-01 02:00:00",), ("2025-06-01 12:00:00",), ("2025-01-15 06:59:59",), ("2025-01-15 07:00:00",)], "t string")
    told = [r[0] for r in rows.select(timewin.site_day(F.col("t").cast("timestamp_ntz"))).collect()]
    assert told == [date(2025, 5, 31), date(2025, 6, 1), date(2025, 1, 14), date(2025, 1, 15)]


CHARGES = [
    ("derecho", 3600, 2, 256, 0, "main", 256.0, 0.0), ("derecho", 3600, 2, 256, 8, "main@desched1:gpudev", 256.0, 8.0),
    ("derecho", 3600, 1, 32, 0, "develop", 32.0, 0.0), ("derecho", 1800, 2, 1, 1, "gpu", 128.0, 4.0), ("casper", 3600, None, 8, 2, "htc", 8.0, 2.0),
]


@pytest.mark.parametrize("case", CHARGES)
def test_charges(spark, case):
    machine, elapsed, nodes, cpus, gpus, queue, cpu_hours, gpu_hours = case
    job = spark.createDataFrame([(elapsed, nodes, cpus, gpus, queue, 2 * 1024**3, "Economy")], "elapsed int, numnodes int, numcpus int, numgpus int, queue string, memory bigint, priority string")
    row = charging.charged(job, machine).first()
    assert (row.cpu_hours, row.gpu_hours, row.memory_hours) == (cpu_hours, gpu_hours, elapsed * 2 / 3600)
    assert (row.qos, row.qos_factor, row.charge_version) == ("economy", 0.7, 1)


def test_charging_rules(spark):
    rows = spark.createDataFrame([("jhublogin", "premium"), ("htc", None), ("htc", "odd"), (None, "PREMIUM")], "queue string, priority string")
    told = rows.select(charging.qos_name(F.col("queue"), F.col("priority")).alias("q")).select("q", charging.qos_factor(F.col("q"))).collect()
    assert [tuple(r) for r in told] == [("uncharged", 0.0), ("regular", 1.0), ("regular", 1.0), ("premium", 1.5)]
    with pytest.raises(ValueError):
        charging.hours("unknown")


def test_globs(spark):
    names = ["run_1.sh", "runX1.sh", "RUN_1.SH", "a[b]c", "a.c", "line\nbreak", "50%", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    match = lambda *p, **k: [r.n for r in rows.where(patterns.matches_any(F.col("n"), list(p), **k)).collect()]
    assert match("run_?.sh") == ["run_1.sh"]
    assert match("run_*", ignore_case=True) == ["run_1.sh", "RUN_1.SH"]
    assert match("a[b]c") == ["a[b]c"] and match("a.c") == ["a.c"] and match("line*") == ["line\nbreak"] and match("50%", "") == ["50%"]
    assert match("") == []
    assert patterns.glob_like("a*b?c%_!") == "a%b_c!%!_!!"
