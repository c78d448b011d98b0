"""Report writers: fixed width, JSON, CSV, Markdown and TSV. Reports are small; larger results go through df.write."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame

# Header, least width and format of a job listing's columns.
JOB_FORMS = {
    "job_id": ("Job ID", 22, "s"), "user": ("User", 12, "s"), "account": ("Project", 12, "s"), "queue": ("Queue", 10, "s"), "qos": ("QoS", 9, "s"),
    "exit_status": ("Exit", 8, "s"), "numnodes": ("Nodes", 6, "d"), "numcpus": ("CPUs", 6, "d"), "numgpus": ("GPUs", 6, "d"), "start": ("Start", 19, "s"),
    "end": ("End", 19, "s"), "elapsed": ("Elapsed", 9, "d"), "cpu_hours": ("CPU-h", 10, ".2f"), "gpu_hours": ("GPU-h", 10, ".2f"), "short_id": ("Short ID", 10, "d"),
    "name": ("Name", 20, "s"), "priority": ("Pri", 6, "s"), "submit": ("Submit", 19, "s"), "queued": ("Queued", 19, "s"), "eligible": ("Eligible", 19, "s"),
    "eligible_secs": ("EligWait", 9, "d"), "run_count": ("Runs", 5, "d"), "walltime": ("Walltime", 9, "d"), "mpiprocs": ("Ranks per Node", 0, "d"),
    "ompthreads": ("OMP Threads", 0, "d"), "reqmem": ("ReqMem", 14, "d"), "memory": ("Mem", 14, "d"), "vmemory": ("VMem", 14, "d"), "cputype": ("CPU type", 12, "s"),
    "gputype": ("GPU type", 12, "s"), "resources": ("Resources", 30, "s"), "memory_hours": ("Mem-h", 10, ".2f"), "qos_factor": ("Factor", 0, ".2f"),
    "charge_version": ("Chg ver", 0, "d"), "cpu_charges": ("CPU chg", 10, ".2f"), "gpu_charges": ("GPU chg", 10, ".2f"), "memory_charges": ("Mem chg", 10, ".2f"),
}
#: A report of more rows than this is refused: it belongs in a table.
MOST_ROWS = 100_000


def rows_of(df: DataFrame) -> list[dict]:
    found = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write the table with df.write instead")
    return found


def cell(value, form: str = "") -> str:
    """A value as text; null is empty."""
    if value is None:
        return ""
    return format(value, form) if form and form != "s" else str(value)


def _plain(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    raise TypeError(f"can't be written as JSON: {type(value).__name__}")


def as_json(rows: Iterable[dict], kind: str | None = None) -> str:
    """A list of objects, or with kind an envelope of kind, columns and rows."""
    rows = list(rows)
    told = rows if kind is None else {"kind": kind, "columns": list(rows[0]) if rows else [], "rows": rows}
    return json.dumps(told, default=_plain, indent=2)


def as_csv(rows: Iterable[dict], separator: str = ",") -> str:
    rows = list(rows)
    out = io.StringIO()
    writer = csv.writer(out, delimiter=separator, lineterminator="\n")
    if rows:
        writer.writerow(rows[0])
        writer.writerows([cell(v) for v in r.values()] for r in rows)
    return out.getvalue()


def as_tsv(rows: Iterable[dict]) -> str:
    return as_csv(rows, "\t")


def as_fixed_width(rows: Iterable[dict], widths: dict[str, int], forms: dict[str, str] | None = None) -> str:
    """Right-padded columns under a header."""
    forms = forms or {}
    lines = ["  ".join(name.ljust(width) for name, width in widths.items()).rstrip()]
    lines += ["  ".join(cell(r[name], forms.get(name, "")).ljust(width) for name, width in widths.items()).rstrip() for r in rows]
    return "\n".join(lines) + "\n"


def job_listing(rows: Iterable[dict]) -> str:
    """Rows of a job search in fixed width, under their headers."""
    rows = list(rows)
    shown = [c for c in (rows[0] if rows else {}) if c in JOB_FORMS]
    named = [{JOB_FORMS[c][0]: r[c] for c in shown} for r in rows]
    widths = {JOB_FORMS[c][0]: max(JOB_FORMS[c][1], len(JOB_FORMS[c][0])) for c in shown}
    return as_fixed_width(named, widths, {JOB_FORMS[c][0]: JOB_FORMS[c][2] for c in shown})


def as_markdown(rows: Iterable[dict]) -> str:
    rows = list(rows)
    if not rows:
        return ""
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "|".join(" --- " for _ in head) + "|"]
    lines += ["| " + " | ".join(cell(r[h]).replace("|", "\\|") for h in head) + " |" for r in rows]
    return "\n".join(lines) + "\n"
