"""Band tables for histograms and reports, and the column expressions that apply them.

A band is (label, low, high): inclusive ends, None for open. A table is closed:
bands are contiguous over the integers, the last is open above, and only the
first may be open below, so every non-null value has exactly one band and each
band replays as a pair of filters to exactly its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = tuple[str, int | None, int | None]
GIB = 1024**3

# Wait and run-time bands (seconds).
WAIT_ENDS = (("<1m", 59), ("1-5m", 299), ("5-15m", 899), ("15-30m", 1799), ("30-60m", 3599), ("1-2h", 7199), ("2-4h", 14399),
             ("4-8h", 28799), ("8-12h", 43199), ("12-24h", 86399), ("1-2d", 172799), (">2d", None))
DURATION_ENDS = (("<30s", 29), ("30s-30m", 1799), ("30-60m", 3599), ("1-5h", 17999), ("5-12h", 43199), ("12-18h", 64799), (">18h", None))
# Size bands by their upper ends.
NODE_ENDS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
CPU_ENDS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 512, 2048, 8192, 32768)
GPU_ENDS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256)
# Memory bands by inclusive upper ends in bytes; one GiB itself is in the second.
MEMORY_ENDS = (("<1GB", GIB - 1), ("1-10GB", 10 * GIB), ("10-50GB", 50 * GIB), ("50-100GB", 100 * GIB), ("100-500GB", 500 * GIB),
               ("500-1000GB", 1000 * GIB), (">1000GB", None))
# Report ranges; values in none of them count as the overflow.
GPU_RANGE_ENDS = (4, 8, 16, 32, 64, 96, 128, 256, 320)
NODE_RANGE_ENDS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
CORE_RANGE_ENDS = (1, 2, 4, 8, 16, 32, 48, 64, 96, 128)
MEMORY_RANGES = ((1, 10), (11, 50), (51, 100), (101, 500), (501, 1000))
# Memory a rank, half-open, upper ends in MiB.
RANK_ENDS_MIB = (("<128MB", 128), ("128MB-512MB", 512), ("512MB-1GB", 1024), ("1-2GB", 2048), ("2-4GB", 4096), ("4-8GB", 8192), ("8-16GB", 16384),
                 ("16-32GB", 32768), ("32-64GB", 65536), ("64-128GB", 131072), ("128-256GB", 262144), (">256GB", None))
# Largest sizes a machine's own histogram shows.
MACHINE_CAPS = {"casper": {"nodes": 128, "cpus": 1024, "gpus": 32}, "derecho": {}}
# Access-age bands (days, exclusive) and file-size bands (bytes, half-open).
ATIME_DAYS = (("< 1 Month", 30), ("1-3 Months", 90), ("3-6 Months", 180), ("6-12 Months", 365), ("1-2 Years", 730), ("2-3 Years", 1095),
              ("3-4 Years", 1460), ("5-6 Years", 2190), ("6-7 Years", 2555), ("7+ Years", None))
FILE_SIZES = (("0 - 1 KiB", 1024), ("1 KiB - 10 KiB", 10 * 1024), ("10 KiB - 100 KiB", 100 * 1024), ("100 KiB - 1 MiB", 1024**2),
              ("1 MiB - 10 MiB", 10 * 1024**2), ("10 MiB - 100 MiB", 100 * 1024**2), ("100 MiB - 1 GiB", GIB), ("1 GiB - 10 GiB", 10 * GIB),
              ("10 GiB - 100 GiB", 100 * GIB), ("100 GiB+", None))


def from_ends(ends: Sequence[tuple[str, int | None]], low: int | None = 0) -> list[Band]:
    """Contiguous bands from labelled inclusive upper ends."""
    out: list[Band] = []
    for label, high in ends:
        out.append((label, low, high))
        low = None if high is None else high + 1
    return out


def counted(ends: Sequence[int]) -> list[Band]:
    """Bands labelled by their numbers, with an open one above."""
    told = [(str(b) if b - a == 1 else f"{a + 1}-{b}", b) for a, b in zip((-1, *ends[:-1]), ends, strict=True)]
    return from_ends([*told, (f">{ends[-1]}", None)])


MEMORY_BANDS = from_ends(MEMORY_ENDS)
#: Histogram dimensions: bands, the column they classify and its unit.
DIMENSIONS: dict[str, tuple[list[Band], str, str]] = {
    "wait": (from_ends(WAIT_ENDS), "eligible_secs", "s"),
    "duration": (from_ends(DURATION_ENDS), "elapsed", "s"),
    "nodes": (counted(NODE_ENDS), "numnodes", "nodes"),
    "cpus": (counted(CPU_ENDS), "numcpus", "cpus"),
    "gpus": (counted(GPU_ENDS), "numgpus", "gpus"),
    "reqmem": (MEMORY_BANDS, "reqmem", "bytes"),
    "memory_used": (MEMORY_BANDS, "memory", "bytes"),
    "memory_wasted": ([("over request", None, -1), *MEMORY_BANDS], "memory_wasted", "bytes"),
}


def check_bands(bands: Sequence[Band]) -> None:
    """Raise ValueError unless the table is closed."""
    if not bands:
        raise ValueError("a band table needs bands")
    if len({b[0] for b in bands}) != len(bands):
        raise ValueError("band labels must differ")
    if bands[0][1] not in (0, None):
        raise ValueError("the first band must start at 0 or be open below")
    if bands[-1][2] is not None:
        raise ValueError("the last band must be open above")
    for (_, _, high), (label, low, _) in zip(bands[:-1], bands[1:], strict=True):
        if high is None or low is None or low != high + 1:
            raise ValueError(f"band {label} does not follow the one before it")


def capped(bands: Sequence[Band], cap: int | None) -> list[Band]:
    """The bands up to a machine's largest size, the last of them open above."""
    if cap is None:
        return list(bands)
    kept = [b for b in bands if b[1] is None or b[1] <= cap]
    if len(kept) < 2:
        raise ValueError("a cap must leave two bands at least")
    _, low, high = kept[-1]
    if high is not None:
        kept[-1] = (f">{low - 1}", low, None)
    return kept


def histogram_bands(dimension: str, machine: str | None = None) -> list[Band]:
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown histogram dimension {dimension!r}")
    return capped(DIMENSIONS[dimension][0], MACHINE_CAPS.get(machine or "", {}).get(dimension))


def band_label(value: Column, bands: Sequence[Band]) -> Column:
    """The label of each value's band; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for label, _, high in bands[:-1]:
        out = out.when(value <= high, F.lit(label))
    return out.otherwise(F.lit(bands[-1][0]))


def ranges(ends: Sequence[int]) -> list[tuple[str, int, int]]:
    """Report ranges: the first two ends stand alone, later ones reach from the end before."""
    out = []
    for i, end in enumerate(ends):
        low = end if i < 2 else ends[i - 1] + 1
        out.append((str(end) if low == end else f"{low}-{end}", low, end))
    return out


RANGES: dict[str, tuple[list[tuple[str, int, int]], str]] = {
    "gpu": (ranges(GPU_RANGE_ENDS), ">320"),
    "node": (ranges(NODE_RANGE_ENDS), ">2048"),
    "core": (ranges(CORE_RANGE_ENDS), ">128"),
    "memory": ([(f"{a}-{b}", a, b) for a, b in MEMORY_RANGES], ">1000"),
}


def range_label(value: Column, kind: str) -> Column:
    """The report range of each value; gaps, zero and null fall into the overflow."""
    table, overflow = RANGES[kind]
    out = F.when(F.lit(False), F.lit(overflow))
    for label, low, high in table:
        out = out.when(value.between(low, high), F.lit(label))
    return out.otherwise(F.lit(overflow))


def range_rank(label: Column, kind: str) -> Column:
    """The place of a range label in its report."""
    table, _ = RANGES[kind]
    out = F.when(F.lit(False), F.lit(0))
    for i, (name, _, _) in enumerate(table):
        out = out.when(label == name, F.lit(i))
    return out.otherwise(F.lit(len(table)))


def atime_bucket(atime: Column, scan_date: Column) -> Column:
    """Index of the access-age band; a missing access time counts as the oldest."""
    out = F.when(atime.isNull(), F.lit(len(ATIME_DAYS) - 1))
    for i, (_, days) in enumerate(ATIME_DAYS[:-1]):
        out = out.when(atime > scan_date - F.make_dt_interval(F.lit(days)), F.lit(i))
    return out.otherwise(F.lit(len(ATIME_DAYS) - 1))


def size_bucket(size: Column) -> Column:
    """Index of the file-size band."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (_, top) in enumerate(FILE_SIZES[:-1]):
        out = out.when(size < top, F.lit(i))
    return out.otherwise(F.lit(len(FILE_SIZES) - 1))
