import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from usagelens import queries as usage

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and df.columns == ["value", "job_count", "cpu_hours", "gpu_hours", "cpu_charges", "gpu_charges"]


def test_every_query_has_its_oracle():
    assert set(usage.oracle_sql()) == set(usage.queries())


def normal(value):
    return str(round(value, 3) + 0.0 if isinstance(value, float) else value)


@pytest.mark.parametrize("name", ["jobs_usage_by_user", "jobs_timeseries_week", "jobs_facets", "directory_tree", "scheduler_log", "daily_summary"])
def test_oracle_agrees(spark, small, name):
    base = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        base.execute(f"create view {file.stem} as select * from '{file}'")
    df = usage.queries()[name](spark, small)
    told = base.sql(usage.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(told.columns)
    mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    places = [told.columns.index(c) for c in columns]
    assert mine == sorted(tuple(normal(r[i]) for i in places) for r in told.fetchall())


def test_entry_works_without_the_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "usagelens"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    target = tmp_path / "usagelens"
    target.mkdir()
    for part in (ROOT / "usagelens").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (target / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'jobs_facets' in q and not [n for n in q if n.startswith('op')], sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
