"""Questions about directories: listings, owner and group summaries, access-age and file-size distributions.

A DirectoryQueries wraps one directory table of one or more collections (column
filesystem). Scopes are path prefixes; nested prefixes are collapsed first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.buckets import ATIME_DAYS, FILE_SIZES, atime_bucket, size_bucket
from usagelens.functions.patterns import matches_any

# Mount points that paths may be given with.
MOUNTS = ("/glade/campaign", "/gpfs/csfs1", "/glade/derecho/scratch", "/lustre/desc1")
# What listings may be sorted by.
SORTS = {
    "size": "total_size_r", "size_r": "total_size_r", "size_nr": "total_size_nr", "files": "file_count_r", "files_r": "file_count_r",
    "files_nr": "file_count_nr", "dirs": "dir_count_r", "dirs_r": "dir_count_r", "dirs_nr": "dir_count_nr", "atime": "max_atime_r",
    "atime_r": "max_atime_r", "atime_nr": "max_atime_nr", "depth": "depth", "path": "path",
}
LISTED = ("dir_id", "path", "depth", "file_count_nr", "total_size_nr", "dir_count_nr", "max_atime_nr",
          "file_count_r", "total_size_r", "dir_count_r", "max_atime_r", "owner_uid", "owner_gid")


def normalize(path: str) -> str:
    """A path without its mount point and trailing slash."""
    path = path.rstrip("/") or "/"
    for mount in MOUNTS:
        if path == mount or path.startswith(mount + "/"):
            return path[len(mount) :] or "/"
    return path


def collection_of(path: str) -> str | None:
    """The collection a path lies in: its first part below the mount point, in lower case."""
    return normalize(path).strip("/").split("/", 1)[0].lower() or None


def collapse(paths: Sequence[str]) -> list[str]:
    """Normalised prefixes without those that lie inside another."""
    out: list[str] = []
    for p in sorted({normalize(p) for p in paths}, key=lambda p: (p.count("/"), p)):
        if not any(o == "/" or p == o or p.startswith(o + "/") for o in out):
            out.append(p)
    return sorted(out)


def inside(paths: Sequence[str]) -> Column:
    """Whether a directory lies in one of the prefixes."""
    kept = collapse(paths)
    if not kept:
        return F.lit(False)
    return reduce(or_, [F.lit(True) if p == "/" else (F.col("path") == p) | F.col("path").startswith(p + "/") for p in kept])


@dataclass(frozen=True)
class DirectoryFilters:
    paths: Sequence[str] | None = None
    exclude: Sequence[str] | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    owner: int | None = None
    group: int | None = None
    single_owner: bool = False
    single_group: bool = False
    accessed_before: datetime | None = None
    accessed_after: datetime | None = None
    recursive_atime: bool = True
    leaves_only: bool = False
    names: Sequence[str] | None = None
    ignore_case: bool = False
    min_size: int | None = None
    max_size: int | None = None
    min_files: int | None = None
    max_files: int | None = None
    min_dirs: int | None = None
    max_dirs: int | None = None
    recursive_counts: bool = True
    min_avg_size: int | None = None
    max_avg_size: int | None = None

    def predicate(self) -> Column:
        """All filters that are set; a depth of 0 is none."""
        out: list[Column] = []
        if self.paths is not None:
            out.append(inside(self.paths))
        if self.exclude:
            out.append(~inside(self.exclude))
        if self.min_depth:
            out.append(F.col("depth") >= self.min_depth)
        if self.max_depth:
            out.append(F.col("depth") <= self.max_depth)
        for entity, value, single in (("owner_uid", self.owner, self.single_owner), ("owner_gid", self.group, self.single_group)):
            if value is not None:
                out.append(F.col(entity) == value)
            if single:
                out.append(F.col(entity).isNotNull() & (F.col(entity) != -1))
        atime = F.date_trunc("second", F.col("max_atime_r" if self.recursive_atime else "max_atime_nr"))
        if self.accessed_before is not None:
            out.append(atime < F.lit(self.accessed_before.replace(microsecond=0)).cast("timestamp_ntz"))
        if self.accessed_after is not None:
            out.append(atime > F.lit(self.accessed_after.replace(microsecond=0)).cast("timestamp_ntz"))
        if self.leaves_only:
            out.append(F.col("dir_count_nr") == 0)
        if self.names:
            out.append(matches_any(F.col("name"), list(self.names), self.ignore_case))
        suffix = "_r" if self.recursive_counts else "_nr"
        for stem, column in (("size", "total_size"), ("files", "file_count"), ("dirs", "dir_count")):
            low, high = getattr(self, f"min_{stem}"), getattr(self, f"max_{stem}")
            if low is not None:
                out.append(F.col(column + suffix) >= low)
            if high is not None:
                out.append(F.col(column + suffix) <= high)
        if self.min_avg_size is not None or self.max_avg_size is not None:
            average = F.expr("CASE WHEN file_count_nr > 0 THEN total_size_nr div file_count_nr END")
            if self.min_avg_size is not None:
                out.append(average >= self.min_avg_size)
            if self.max_avg_size is not None:
                out.append(average < self.max_avg_size)
        return reduce(and_, out, F.lit(True))


class DirectoryQueries:
    def __init__(self, directories: DataFrame, scans: DataFrame | None = None, histograms: DataFrame | None = None, names: DataFrame | None = None,
                 groups: DataFrame | None = None, directory_histograms: DataFrame | None = None):
        """directories (with filesystem), scans (filesystem, scan_timestamp), histograms of files, names (uid, username), groups (gid, groupname), histograms by directory."""
        self.directories, self.scans, self.histograms, self.names, self.groups = directories, scans, histograms, names, groups
        self.directory_histograms = directory_histograms

    def _rows(self, filters: DirectoryFilters | None, filesystems: Sequence[str] | None) -> DataFrame:
        rows = self.directories.where((filters or DirectoryFilters()).predicate())
        return rows if filesystems is None else rows.where(F.col("filesystem").isin(list(filesystems)))

    def filesystems(self) -> DataFrame:
        """The collections there are; those being staged or replaced are hidden."""
        hidden = F.col("filesystem").rlike("_(staging|old)$")
        return self.directories.select("filesystem").distinct().where(~hidden).orderBy("filesystem")

    def owner_id(self, owner: int | str) -> int:
        """The id of an owner given by number or name."""
        return self._id(owner, self.names, "username", "uid", "owner")

    def group_id(self, group: int | str) -> int:
        """The id of a group given by number or name."""
        return self._id(group, self.groups, "groupname", "gid", "group")

    @staticmethod
    def _id(given: int | str, table: DataFrame | None, name: str, number: str, what: str) -> int:
        if isinstance(given, int) or given.isdigit():
            return int(given)
        found = None if table is None else table.where(F.col(name) == given).agg(F.min(number)).first()[0]
        if found is None:
            raise ValueError(f"no {what} is called {given!r}")
        return found

    def list(self, filters: DirectoryFilters | None = None, sort: str = "size", descending: bool = True, limit: int | None = 50,
             filesystems: Sequence[str] | None = None) -> DataFrame:
        """Directories in order, over all collections at once; exclusions count before the limit."""
        if sort not in SORTS:
            raise ValueError(f"sort must be one of {tuple(SORTS)}")
        key = F.col(SORTS[sort])
        rows = self._rows(filters, filesystems).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "filesystem", "path")
        return (rows if limit is None else rows.limit(limit)).select("filesystem", *LISTED)

    def total(self, filesystems: Sequence[str] | None = None) -> DataFrame:
        """A row a collection: directories, files and the size of its largest root."""
        rows = self._rows(None, filesystems)
        root = F.col("parent_id").isNull()
        return rows.groupBy("filesystem").agg(
            F.count(F.lit(1)).alias("total_directories"), F.sum("file_count_nr").alias("total_files"), F.max(F.when(root, F.col("total_size_r"))).alias("total_size")
        )

    def by_entity(
        self, entity: str, filters: DirectoryFilters | None = None, breakdown: bool = False, filesystems: Sequence[str] | None = None
    ) -> DataFrame:
        """Bytes, files and directories of single owners (owner_uid) or groups (owner_gid), over or by collection."""
        keys = ["filesystem", entity] if breakdown else [entity]
        return self._rows(filters, filesystems).where(F.col(entity) >= 0).groupBy(*keys).agg(
            F.sum("total_size_nr").alias("total_size"), F.sum("file_count_nr").alias("total_files"), F.count(F.lit(1)).alias("directory_count")
        )

    def named(self, rows: DataFrame, entity: str = "owner_uid") -> DataFrame:
        """rows with the owner's name; an id without a name is its own."""
        one = self.names.groupBy(F.col("uid").alias(entity)).agg(F.min("username").alias("username"))
        return rows.join(one, entity, "left").withColumn("username", F.coalesce("username", F.col(entity).cast("string")))

    def scan_dates(self) -> DataFrame:
        """Newest scan of each collection."""
        return self.scans.groupBy("filesystem").agg(F.max("scan_timestamp").alias("scan_date"))

    def access_history(self, filters: DirectoryFilters | None = None, by_owner: bool = False, filesystems: Sequence[str] | None = None) -> DataFrame:
        """Bytes and files by age of a directory's newest access, from directory statistics (approximate: by directory)."""
        rows = self._rows(filters, filesystems).where("file_count_nr > 0").join(F.broadcast(self.scan_dates()), "filesystem")
        return self._bucketed(rows, atime_bucket(F.col("max_atime_nr"), F.col("scan_date")), by_owner)

    def file_sizes(self, filters: DirectoryFilters | None = None, by_owner: bool = False, filesystems: Sequence[str] | None = None) -> DataFrame:
        """Bytes and files by a directory's average file size, floored (approximate: by directory)."""
        rows = self._rows(filters, filesystems).where("file_count_nr > 0")
        return self._bucketed(rows, size_bucket(F.expr("total_size_nr div file_count_nr")), by_owner)

    @staticmethod
    def _bucketed(rows: DataFrame, bucket: Column, by_owner: bool) -> DataFrame:
        keys = [bucket.alias("bucket_index"), *(["owner_uid"] if by_owner else [])]
        return rows.groupBy(*keys).agg(F.sum("file_count_nr").alias("file_count"), F.sum("total_size_nr").alias("total_size"))

    def file_histogram(self, kind: str, owner: int | None = None, filesystems: Sequence[str] | None = None) -> DataFrame:
        """The exact histogram of files kept at import, all bands filled; merged over collections."""
        labels = [label for label, _ in (ATIME_DAYS if kind == "access" else FILE_SIZES)]
        rows = self.histograms.where(F.col("kind") == kind)
        if owner is not None:
            rows = rows.where(F.col("owner_uid") == owner)
        if filesystems is not None:
            rows = rows.where(F.col("filesystem").isin(list(filesystems)))
        summed = rows.groupBy("bucket_index").agg(F.sum("file_count").alias("file_count"), F.sum("total_size").alias("total_size"))
        table = rows.sparkSession.createDataFrame(list(enumerate(labels)), "bucket_index int, label string")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        return F.broadcast(table).join(summed, "bucket_index", "left").select("bucket_index", "label", zero("file_count"), zero("total_size"))

    def scope(self, paths: Sequence[str] | None, filesystems: Sequence[str] | None = None) -> tuple[list[str], list[str], list[str]]:
        """Collections that path prefixes take whole, the other collections, and the prefixes that are looked up in those.

        A prefix that is a collection's root takes it whole; without prefixes all are.
        """
        known = [r[0] for r in self.filesystems().collect() if filesystems is None or r[0] in filesystems]
        if not paths:
            return known, [], []
        by_root = {name.lower(): name for name in known}
        kept = collapse(paths)
        roots = {p: by_root[p.strip("/").lower()] for p in kept if p.strip("/").lower() in by_root}
        whole, rest = sorted(set(roots.values())), [p for p in kept if p not in roots]
        return whole, [n for n in known if n not in whole] if rest else [], rest

    def histogram(self, kind: str, filters: DirectoryFilters | None = None, owner: int | None = None, filesystems: Sequence[str] | None = None) -> DataFrame:
        """File histogram ("access" or "size") of any scope, all bands filled, over all collections.

        Collections taken whole are counted by file, from the table kept at import;
        parts of collections, and all of them where other filters are set, by
        directory: then approximate is true.
        """
        filters = filters or DirectoryFilters()
        whole, parts, paths = self.scope(filters.paths, filesystems)
        if filters != DirectoryFilters(paths=filters.paths):
            whole, parts, paths = [], sorted({*whole, *parts}), filters.paths
        exact = self.file_histogram(kind, owner, whole)
        rest = replace(filters, paths=paths or None, owner=filters.owner if owner is None else owner)
        told = (self.access_history if kind == "access" else self.file_sizes)(rest, filesystems=parts)
        both = exact.select("bucket_index", "file_count", "total_size").union(told.select("bucket_index", "file_count", "total_size"))
        summed = both.groupBy("bucket_index").agg(F.sum("file_count").alias("file_count"), F.sum("total_size").alias("total_size"))
        return exact.select("bucket_index", "label").join(summed, "bucket_index").select("bucket_index", "label", "file_count", "total_size", F.lit(bool(parts)).alias("approximate"))

    def exact_histogram(self, kind: str, filters: DirectoryFilters | None = None, owner: int | None = None, filesystems: Sequence[str] | None = None, by_owner: bool = False) -> DataFrame:
        """File histogram of any scope counted by file, from the histograms kept by directory; bands without files are left out.

        Where the filters are path prefixes alone, a prefix is one look at what is
        kept for all files below it. Any other filter chooses directories, whose
        own files count. Owner is the owner of the files.
        """
        filters = filters or DirectoryFilters()
        rows = self.directory_histograms.where(F.col("kind") == kind)
        if owner is not None:
            rows = rows.where(F.col("owner_uid") == owner)
        if filesystems is not None:
            rows = rows.where(F.col("filesystem").isin(list(filesystems)))
        if filters == DirectoryFilters(paths=filters.paths):
            kept = ["/"] if filters.paths is None else collapse(filters.paths)
            top = F.length(F.translate("path", "/", "")) == F.length("path") - 1
            rows, suffix = rows.where(top if "/" in kept else F.col("path").isin(kept)), "_r"
        else:
            chosen = self._rows(filters, filesystems).select("filesystem", "path")
            rows, suffix = rows.where("file_count_nr > 0").join(chosen, ["filesystem", "path"], "left_semi"), "_nr"
        keys = ["bucket_index", *(["owner_uid"] if by_owner else [])]
        return rows.groupBy(*keys).agg(F.sum(f"file_count{suffix}").alias("file_count"), F.sum(f"total_size{suffix}").alias("total_size"))

    def top_owners(self, kind: str, top: int = 10) -> DataFrame:
        """The largest owners of each band with their share of it, and how many more there are."""
        owners = self.histograms.where(F.col("kind") == kind).groupBy("bucket_index", "owner_uid").agg(F.sum("total_size").alias("total_size"), F.sum("file_count").alias("file_count"))
        band = Window.partitionBy("bucket_index")
        ranked = owners.withColumns({
            "place": F.row_number().over(band.orderBy(F.desc("total_size"), "owner_uid")),
            "share": F.try_divide(F.col("total_size"), F.sum("total_size").over(band)), "more": F.greatest(F.count(F.lit(1)).over(band) - top, F.lit(0)),
        })
        return ranked.where(F.col("place") <= top)
