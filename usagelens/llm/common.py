"""Helpers that the operators share: tables, shared folders, checkpoints and Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import fresh_path, shared_dir


__all__ = ["Memo", "bucket_of_id", "cut", "discard", "free_name", "fresh_path", "groups", "kept_in_worker", "map_texts", "shared_dir", "slices", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was written to a fresh path and is not read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with marks behind it until no column has it in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, read again from a compressed table at a fresh path; a checkpoint of the same rows is several times as large."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of_id(column, divisor: int):
    """crc32 of the id as text, modulo a divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[tuple]], dict[str, list]]],
    schema: str,
    slice_bytes: int = 1 << 20,
) -> DataFrame:
    """df through Python in Arrow slices of about slice_bytes, one row at least.

    make runs once in each task and returns a function from lists of column
    tuples to a dict of output columns. A slice is small so that very long
    texts do not pile up in one Python worker.
    """
    names = df.sparkSession.createDataFrame([], schema).schema
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                out = work(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                arrays = [_column(out.get(f.name, []), f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, names)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about `size` bytes of its texts at a time, one row at least."""
    weight = np.full(batch.num_rows, 64, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def groups(batches: Iterable[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns, from sorted batches; longer runs come in parts of `most`."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and (key != held_key or (most and sum(map(len, held)) >= most)):
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            while a < b:
                room = (most or b - a) - (sum(map(len, held)) if most else 0)
                if most and room <= 0:
                    yield pa.Table.from_batches(held)
                    held = []
                    continue
                held.append(batch.slice(a, min(room, b - a)))
                a += min(room, b - a)
    if held:
        yield pa.Table.from_batches(held)


def _column(values, kind):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Memo(dict):
    """A dict that computes what it lacks. When it is full, half the memory goes: all that was not used lately."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.half, self.older = compute, max(1, most // 2), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


_KEPT: dict = {}


def kept_in_worker(key: tuple, build: Callable):
    """What a Python worker builds once and keeps for its later tasks.

    A worker that Spark uses again for other work holds one such thing at a
    time: models and memos of earlier stages go before the next are built.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = build()
    return _KEPT[key]
