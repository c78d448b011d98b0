"""Directory trees stored by id only (dir_id, parent_id, name): paths, totals of subtrees, and pre-order intervals.

Nothing walks a level at a time. Every directory points to an ancestor; a round
lets it point to its ancestor's ancestor, so that a tree of depth d takes about
log2(d) rounds. Beside the pointer goes what is told of the way up to it (names)
or of what lies below within that distance (totals): a directory's descendants
nearer than 2^(k+1) are those nearer than 2^k, and theirs. Rows are pre-aggregated
before they meet the ancestor they name, so a directory with very many below it
is no hot key; ways up meet few ancestors by broadcast, many by a shuffled join.

A subtree is a range: `low` numbers directories in pre-order, `high` is the first
number behind the last descendant. Tables sorted by it are pruned by minima and
maxima.

Cases: a directory without a parent_id is a root. One whose way up ends at an id
that no row has, has a null path and no interval, but totals as any other; one
whose way up goes round in a circle has null totals too. Repeated ids are an
error. A null name counts as an empty one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.session import stored

#: So many distinct ancestors are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Of so many directories one is a mark, whose path those below it are told from.
STEP = 16


def _unique(tree: DataFrame) -> DataFrame:
    """tree with one row an id; several raise when the rows are read."""
    rows = tree.groupBy("dir_id").agg(F.count(F.lit(1)).alias("n"), F.first("parent_id").alias("parent_id"), F.first("name").alias("name"))
    once = F.when(F.col("n") == 1, F.col("dir_id")).otherwise(F.raise_error(F.concat(F.lit("dir_id "), F.col("dir_id").cast("string"), F.lit(" is repeated"))).cast("bigint"))
    return rows.select(once.alias("dir_id"), F.col("parent_id").cast("bigint").alias("parent_id"), F.coalesce("name", F.lit("")).alias("name"))


def _rounds(rows: DataFrame) -> int:
    """As many rounds as the longest way without a circle takes."""
    return max(1, rows.count().bit_length() + 1)


def _ways(state: DataFrame, rounds: int, stops: Callable[[str], Column] = lambda up: F.lit(False)) -> DataFrame:
    """state (dir_id, up, way, depth) with ways that reach up to a root (up is null), to a stop or nowhere (both are null)."""
    ended = lambda: F.col("up").isNull() | stops("up")
    for _ in range(rounds):
        open_ = state.where(~ended())
        wanted = open_.select("up").distinct()
        many = wanted.limit(MOST_BROADCAST + 1).count()
        if not many:
            break
        above = state.select(F.col("dir_id").alias("up"), F.col("up").alias("next"), F.col("way").alias("above"), F.col("depth").alias("more"), F.lit(True).alias("found"))
        few = many <= MOST_BROADCAST
        if few:
            above = F.broadcast(above.join(F.broadcast(wanted), "up", "left_semi"))
        # Rows that have ended take no part in a shuffle; beside a broadcast they stay in their partitions, whose number would double.
        met = (state if few else open_).join(above, "up", "left")
        gone = F.col("found").isNull() | F.col("above").isNull()
        grow = lambda n, more: F.when(ended(), F.col(n)).when(~gone, more).alias(n)
        grown = met.select("dir_id", grow("up", F.col("next")), grow("way", F.concat("above", "way")), grow("depth", F.col("depth") + F.col("more")))
        state = stored(grown if few else state.where(ended()).unionByName(grown))
    return state


def paths(tree: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """dir_id, parent_id, name, path and depth of every directory, and what beside tells of its dir_id; a root of name a has path /a and depth 1.

    Ways are told up to the next mark, one directory in STEP; only the marks' own ways reach up to the roots before
    all paths are put together, so long paths are not dealt anew in every round.
    """
    rows = stored(_unique(tree))
    marked = lambda n: F.pmod(F.xxhash64(n), F.lit(STEP)) == 0
    # way: the names from below `up` on; up is null where a root has been reached, way where there is none to reach.
    state = rows.select("dir_id", F.col("parent_id").alias("up"), F.concat(F.lit("/"), "name").alias("way"), F.lit(1).alias("depth"))
    state = _ways(state, _rounds(rows), marked)
    marks = stored(state.where(marked("dir_id")))
    above = _ways(marks, _rounds(marks)).where("up IS NULL").select(F.col("dir_id").alias("up"), F.col("way").alias("above"), F.col("depth").alias("more"))
    told = rows.join(state, "dir_id")
    if beside is not None:
        told = told.join(beside, "dir_id", "left")
    names = [c for c in told.columns if c not in ("up", "way", "depth")]
    low = told.where("up IS NOT NULL").join(F.broadcast(above) if marks.count() <= MOST_BROADCAST // STEP else above, "up", "left")
    whole = told.where("up IS NULL").select(*names, F.col("way").alias("path"), "depth")
    found = whole.unionByName(low.select(*names, F.concat("above", "way").alias("path"), (F.col("more") + F.col("depth")).alias("depth")))
    return found.select("dir_id", "parent_id", "name", "path", "depth", *names[3:])


def rolled(tree: DataFrame, stats: DataFrame, sums: Sequence[str] = (), greatest: Sequence[str] = (), least: Sequence[str] = ()) -> DataFrame:
    """dir_id and the columns of stats (dir_id, ...) over each directory and all below it, by the names of the columns."""
    names = (*sums, *greatest, *least)
    own = tree.select("dir_id", F.col("parent_id").cast("bigint").alias("up")).join(stats.select("dir_id", *names), "dir_id", "left")
    state = stored(own.select("dir_id", "up", *[F.coalesce(c, F.lit(0)).alias(c) if c in sums else F.col(c) for c in names]))
    for _ in range(_rounds(state)):
        named = state.where("up IS NOT NULL")
        if named.limit(1).isEmpty():
            break
        below = named.groupBy("up").agg(
            *[F.sum(c).alias(f"below_{c}") for c in sums], *[F.max(c).alias(f"below_{c}") for c in greatest], *[F.min(c).alias(f"below_{c}") for c in least]
        ).withColumnRenamed("up", "dir_id")
        # The next ancestor of an id that no row has is none.
        further = named.select("up").distinct().join(state.select(F.col("dir_id").alias("up"), F.col("up").alias("next")), "up")
        few = named.select("up").distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        merged = [F.col(c) + F.coalesce(f"below_{c}", F.lit(0)) for c in sums]
        merged += [F.greatest(c, f"below_{c}") for c in greatest] + [F.least(c, f"below_{c}") for c in least]
        moved = state.join(F.broadcast(further) if few else further, "up", "left").join(F.broadcast(below) if few else below, "dir_id", "left")
        state = stored(moved.select("dir_id", F.col("next").alias("up"), *[m.alias(c) for m, c in zip(merged, names, strict=True)]))
    return state.select("dir_id", *[F.when(F.col("up").isNull(), F.col(c)).alias(c) for c in names])


def sizes(tree: DataFrame) -> DataFrame:
    """dir_id and size: how many directories each subtree has."""
    return rolled(tree, tree.select("dir_id", F.lit(1).cast("bigint").alias("size")), sums=("size",))


def intervals(placed: DataFrame) -> DataFrame:
    """placed (of paths) with low and high: directories by pre-order, siblings by name, in that order. `size` (of sizes) is used up if placed has it."""
    # A separator below every other character puts a directory right before what is in it; null paths come first.
    key = F.translate("path", "/", "\x01")
    sized = placed if "size" in placed.columns else placed.join(sizes(placed), "dir_id", "left")
    ranged = stored(sized.repartitionByRange(key).sortWithinPartitions(key, "dir_id").withColumn("at", F.monotonically_increasing_id()))
    # The number has the partition's above the row's place in it.
    ranged = ranged.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").isNull()).alias("lost"))  # a row a partition
    before, all_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.sum("lost").over(all_)).alias("first"))
    low = F.when(F.col("path").isNotNull(), F.col("first") + F.col("place"))
    numbered = ranged.join(F.broadcast(first), "part").withColumn("low", low).withColumn("high", F.col("low") + F.col("size"))
    return numbered.select(*[c for c in placed.columns if c != "size"], "low", "high")


def ids_of(placed: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """The ids of some paths, written with or without a slash at the end; those that are none are left out."""
    told = {p.rstrip("/"): p for p in wanted}
    rows = placed.where(F.col("path").isin(list(told))).select("path", "dir_id").collect()  # a row a path asked for
    return {told[r.path]: r.dir_id for r in rows}


def below(table: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of a table with intervals that lie in the subtrees of some ids: ranges of low."""
    bounds = table.where(F.col("dir_id").isin(list(ids)) & F.col("low").isNotNull()).select("low", "high").collect()  # a row an id
    return table.where(reduce(or_, [_within(r.low, r.high) for r in bounds], F.lit(False)))


def _within(low: int, high: int) -> Column:
    return (F.col("low") >= low) & (F.col("low") < high)


def above(table: DataFrame, dir_id: int) -> DataFrame:
    """A directory and all above it, from the top down."""
    at = table.where(F.col("dir_id") == dir_id).select("low").first()
    if at is None or at.low is None:
        return table.limit(0)
    return table.where((F.col("low") <= at.low) & (F.col("high") > at.low)).orderBy("depth")


def write(table: DataFrame, path: str, ordered: bool = False) -> None:
    """Store a table with intervals so that a subtree is a few row groups. ordered: the rows come from intervals and stay as they are dealt."""
    (table if ordered else table.repartitionByRange("low").sortWithinPartitions("low")).write.mode("overwrite").parquet(path)
