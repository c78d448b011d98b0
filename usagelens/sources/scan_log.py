"""File-system scan logs: GPFS policy scans and Lustre scans, as column expressions over lines of text.

A line is a head, key=value fields, a ` -- ` mark and the path. It is split once at
the mark; places of the head and fields are then read by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import once

# Fixed value: files of up to so many bytes may lie in their inode and take no blocks.
SMALL_FILE = 4096
REQUIRED = ["size", "allocated", "uid", "gid", "is_dir", "atime"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the file they are from; files are split among tasks as Spark sees fit."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))


def _split(lines: DataFrame) -> DataFrame:
    """told (the part before the first mark, single spaces between its words and around it), head (its words) and path."""
    halves = F.split("value", r"\s--\s", 2)
    told = F.concat(F.lit(" "), F.trim(F.regexp_replace(halves[0], r"\s+", " ")), F.lit(" "))
    split = lines.where(F.size(halves) == 2).select(once(F.struct(told.alias("told"), F.ltrim(halves[1]).alias("path"))).alias("line"))
    return split.select("line.told", "line.path", once(F.split(F.trim("line.told"), " ")).alias("head")).where("path <> ''")


def _text(key: str, words: int = 1) -> Column:
    """What follows key= up to the next space, or some words of it; null without the key."""
    mark = f" {key}="
    at = F.instr("told", mark)
    return F.when(at > 0, F.substring_index(F.substr("told", at + len(mark)), " ", words))


def _number(key: str) -> Column:
    return _text(key).try_cast("bigint")


def parse_gpfs(lines: DataFrame) -> DataFrame:
    """Entries of <n> inode fileset snapshot s= a= u= g= p= ac= -- /path lines; lines that lack a field are skipped."""
    place = lambda i: F.get("head", i).try_cast("bigint")
    number = F.regexp_replace(F.get("head", 0), "^<(.*)>$", "$1")
    proper = number.try_cast("bigint").isNotNull() & (number != F.get("head", 0)) & place(1).isNotNull() & place(2).isNotNull() & place(3).isNotNull()
    size, kilo = _number("s"), _number("a")
    return _split(lines).where(proper).select(
        "path", size.alias("size"), F.when((kilo == 0) & (size <= SMALL_FILE), size).otherwise(kilo * 1024).alias("allocated"),
        _number("u").alias("uid"), _number("g").alias("gid"), _text("p").startswith("d").alias("is_dir"),
        F.substring(_text("ac", 2), 1, 19).try_cast("timestamp_ntz").alias("atime"), place(1).alias("inode"), place(2).alias("fileset_id"),
    ).dropna(subset=REQUIRED)


def parse_lustre(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Entries of fid s= b= u= g= type= a= -- /path lines; only files and directories; access times in the zone given."""
    parts = F.split(F.get("head", 0), ":")
    proper = (F.size(parts) == 3) & F.forall(parts, lambda p: p.startswith("0x")) & _text("type").isin("d", "f")
    atime = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(_number("a")).cast("timestamp_ntz"))
    none = F.lit(None).cast("bigint")
    return _split(lines).where(proper).select(
        "path", _number("s").alias("size"), (_number("b") * 512).alias("allocated"), _number("u").alias("uid"), _number("g").alias("gid"),
        (_text("type") == "d").alias("is_dir"), atime.alias("atime"), none.alias("inode"), none.alias("fileset_id"),
    ).dropna(subset=REQUIRED)


def _is_gpfs(name: str) -> bool:
    """A date, a word and a collection between underscores, then .list and whatever follows."""
    date, _, rest = name.partition("_")
    word, _, rest = rest.partition("_")
    collection, _, ending = rest.partition(".")
    return len(date) == 8 and date.isdigit() and bool(word) and bool(collection) and ending.startswith("list")


@dataclass(frozen=True)
class Format:
    parse: Callable[[DataFrame], DataFrame]
    takes: Callable[[str], bool]


FORMATS: dict[str, Format] = {"gpfs": Format(parse_gpfs, _is_gpfs), "lustre": Format(parse_lustre, lambda name: name.endswith(".lfs-scan"))}


def register_format(name: str, parse: Callable[[DataFrame], DataFrame], takes: Callable[[str], bool]) -> None:
    """Add a format: how its lines become entries, and which file names are of it."""
    FORMATS[name] = Format(parse, takes)


def detect(file_name: str) -> str:
    """The format a file name tells of."""
    for name, known in FORMATS.items():
        if known.takes(file_name):
            return name
    raise ValueError(f"no known scan format for {file_name}; formats: {', '.join(sorted(FORMATS))}")


def file_system(name: Column) -> Column:
    """The collection a file name tells of: what follows its date."""
    return F.regexp_extract(name, r"^\d{8}_(?:[^_]+_)?([^_.]+)\.", 1)


def scan_date(name: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(name, r"^(\d{8})_", 1), F.lit("yyyyMMdd")).cast("timestamp_ntz")
