"""Operator 4: near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its lower-cased words. Each of several hash functions chooses a pair of
neighbouring words (equal pairs told apart by their occurrence number); three of
them in text order are a key, and texts with an equal key share a bucket, so order
counts as it does in edit distance. The keys are so many that texts at the least
similarity miss each other a few times in a thousand at most. In a bucket the texts
meet the smallest document, those that stay apart meet the smallest of them, and
then all pairs of a bucket that no links connect are compared, unless their word
counts alone tell that they differ too much. A pair is a link when
its edit similarity over words, 1 - distance / longer length, is at least 0.8 by
an alignment in a band. A class is what links connect; equal texts are one node.
Pairs are compared in bounded groups to which a text is sent once, whatever many
pairs of the group share it. In the end some texts are compared with all others, and a
recall below LEAST_RECALL is an error.

Sketches, nodes and buckets are written as compressed tables of the shared folder,
which are removed when what follows from them stands; the classes stay.

Cases: texts that are null or without a visible character link with nothing;
texts without a word character are compared as one word, as they stand; a null
doc_id gets a null class and is kept; rows with equal ids and texts have one
class; rows with equal ids and other texts are classed by their texts; ties go
to the smallest doc_id; an empty table gives no rows; other columns are ignored.
Very long texts are aligned between runs of words that both have once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import Memo, cut, discard, free_name, fresh_path, groups, kept_in_worker, map_texts, slices, written
from usagelens.llm.graph import components

SIMILARITY = 0.8
#: Hash functions, keys of each three of their minima, words a k-mer. At similarity 0.8 at least 0.6 n - 1 of a text's
#: n - 1 runs of two words are the other text's, so a minimum is shared with chance 0.6 / 1.4 and a key with its cube.
MINIMA, KEYS, WORDS = 64, 128, 2
#: Short texts have keys of single words besides, of which 0.8 n are shared; all texts with one edit meet below ONE_EDIT words.
SHORT_TEXT, SHORT_MINIMA, SHORT_KEYS, ONE_EDIT = 24, 32, 32, 10
#: Rounds in which a bucket's texts meet its smallest document, before all that are still apart meet each other.
SMALLEST_ROUNDS = 2
#: The side of rows whose group is a whole bucket.
BOTH = 2
#: Bins of the word counts that bound an edit distance from below, and the finer ones, two to a byte, that pairs meet next.
BINS, FINE_BINS, MOST_FINE = 128, 1024, 15
#: Texts of a bucket that meet in one group: smaller buckets are one, in larger ones a text is copied once for so many
#: others. A group's bins take about two and a half megabytes.
BLOCK = 2048
#: About so many smaller and larger nodes of pairs are compared in one group; a list of the wide leaders is broadcast up to so many.
LEADERS, PARTNERS, MOST_BROADCAST = 32, 64, 100_000
#: Words of a group's smaller nodes that are held as lists; further texts are split again for each pair.
HELD_WORDS = 1 << 18
#: Up to so many nodes that a search asks for, they are broadcast so that no other text is shuffled; of more, all texts are.
MOST_ASKED = 1_000_000
#: Keys of about more rows than this are found in a sample of one node in HOT_SAMPLE; they need no shuffle to be known as shared.
HOT_ROWS, HOT_SAMPLE, MOST_HOT = 65_536, 256, 1000
#: Texts that are compared with all others in the end, the recall asked for, and how many true pairs that takes:
#: of fewer, AUDIT_GROWS times as many texts are compared, up to MOST_AUDITED, which bounds what is broadcast.
AUDITED, LEAST_RECALL, LEAST_TRUE, AUDIT_GROWS, MOST_AUDITED = 64, 0.9, 20, 4, 4096
#: Texts from this many words on are first aligned between runs of so many words that both have once.
ANCHORED, ANCHOR = 512, 3
MEMO_WORDS = 300_000
#: Hash values of all sketches that are held at once, in one text.
HASHES_AT_ONCE = 1 << 21


def words_of(text: str | None) -> list[str]:
    found = re.findall(r"\w+", (text or "").lower())
    if not found and text and text.strip():
        found = [text.strip()]
    return found


def edit_distance_within(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    A band of 2 * most + 1 diagonals is kept as two bit vectors that say where
    the distance rises or falls from one row of the band to the next (Hyyrö's
    bit-parallel form of the dynamic programme); the band moves down one row a step.
    """
    while a and b and a[0] == b[0]:
        skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[skip:], b[skip:]
    skip = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        skip += 1
    if skip:
        a, b = a[: len(a) - skip], b[: len(b) - skip]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    # Row i of a is bit i + most of a word's places; column j sees the band of rows j - most to j + most.
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << (i + most)
    width = 2 * most + 1
    full = (1 << width) - 1
    # Before the first column the distance of row i is i: it rises by one a row; there is nothing above row 1.
    up = full & ~((1 << most) - 1)
    down = 0
    # `distance` follows the band's lowest diagonal while that is inside a, then the last row of a.
    distance, last = most, len(a)
    top = 1 << (width - 1)
    for j, word in enumerate(b):
        match = (places.get(word, 0) >> j) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | (full & ~(zero | up))
        fall = zero & up
        if j + most < last:
            distance += 0 if zero & top else 1
        else:
            row = 1 << (last - 1 - j + most)
            distance += bool(rise & row) - bool(fall & row)
        if distance - (len(b) - 1 - j) > most and j + most >= last:
            return most + 1
        moved = zero >> 1
        up = (fall | (full & ~(moved | rise))) & full
        down = moved & rise
    return distance if distance <= most else most + 1


def _places_once(words: list) -> dict:
    """Where each run of ANCHOR words stands that occurs once."""
    runs = list(zip(*(words[i:] for i in range(ANCHOR))))
    at = dict(zip(runs, range(len(runs))))
    many = Counter(runs)
    return {run: i for run, i in at.items() if many[run] == 1}


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of runs that both have once, the longest chain that ascends in both."""
    in_b = _places_once(b)
    both = [(i, in_b[run]) for run, i in sorted(_places_once(a).items(), key=lambda x: x[1]) if run in in_b]
    ends: list[int] = []
    chosen: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(both):
        at = bisect_left(ends, j)
        before.append(chosen[at - 1] if at else -1)
        ends[at : at + 1], chosen[at : at + 1] = [j], [k]
    chain, k = [], chosen[-1] if chosen else -1
    while k >= 0:
        chain.append(both[k])
        k = before[k]
    return chain[::-1]


def anchored_distance(a: list, b: list, most: int) -> int:
    """An edit distance that anchors allow, never below the least one: the gaps between them are aligned each. Above most it may stop early."""
    total = at_a = at_b = 0
    for i, j in [*_anchors(a, b), (len(a), len(b))]:
        if i < at_a or j < at_b:  # reaches into the run before
            continue
        gap_a, gap_b = a[at_a:i], b[at_b:j]
        if gap_a or gap_b:
            total += edit_distance_within(gap_a, gap_b, min(max(len(gap_a), len(gap_b)), most - total + 1))
        if total > most:
            return total
        at_a, at_b = i + ANCHOR, j + ANCHOR
    return total


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least `least`.

    Narrow bands come first. Then what words both have bounds the distance from
    below, and in long texts an alignment between anchors from above; only where
    the bounds leave it open the whole band is filled.
    """
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    band = min(most, 16)
    if edit_distance_within(a, b, band) <= band:
        return True
    if band >= most or (Counter(a) & Counter(b)).total() < longer - most:
        return False
    if longer >= ANCHORED and anchored_distance(a, b, most) <= most:
        return True
    while band < most:
        band = min(most, band * 4)
        if edit_distance_within(a, b, band) <= band:
            return True
    return False


class Sketcher:
    """Order MinHash of word sequences; state is a bounded memo of word hashes."""

    def __init__(self):
        import xxhash

        self.word = Memo(lambda w: xxhash.xxh64_intdigest(w), MEMO_WORDS)
        chosen = np.random.default_rng(4)
        self.salts = chosen.integers(1, 1 << 63, MINIMA, dtype=np.uint64)
        self.odd = chosen.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
        self.threes = _threes(chosen, MINIMA, KEYS)
        self.short_threes = _threes(chosen, SHORT_MINIMA, SHORT_KEYS)

    def hashes(self, words: list[str]) -> np.ndarray:
        word = self.word
        return np.array([word[w] for w in words], dtype=np.uint64)

    def sketch(self, hashes: np.ndarray) -> tuple[list[int], bytes]:
        """Keys of a text, and how many of its words fall in each bin."""
        keys = self._keys(_kmers(hashes, WORDS), self.threes, MINIMA, 0)
        if len(hashes) <= SHORT_TEXT:
            keys += self._keys(_kmers(hashes, 1), self.short_threes, SHORT_MINIMA, 1)
        if len(hashes) < ONE_EDIT:
            rests = [hashes, *(np.delete(hashes, i) for i in range(len(hashes)))]
            keys += [int(_combined(rest[None, :], np.full(1, 2000, dtype=np.uint64))[0]) for rest in rests if len(rest)]
        return keys, _binned(hashes, BINS, 255).tobytes() + _halves(_binned(hashes, FINE_BINS, MOST_FINE)).tobytes()

    def _keys(self, kmers: np.ndarray, threes: np.ndarray, count: int, kind: int) -> list[int]:
        told = _mixed(kmers + _occurrence(kmers) * _C)
        step = max(1, HASHES_AT_ONCE // len(told))
        at = [((told[None, :] ^ self.salts[i : min(count, i + step), None]) * self.odd[i : min(count, i + step), None]).argmin(axis=1) for i in range(0, count, step)]
        number = np.arange(len(threes), dtype=np.uint64) + np.uint64(1000 * kind)
        return _combined(told[np.sort(np.concatenate(at)[threes], axis=1)], number).tolist()


def _binned(hashes: np.ndarray, bins: int, most: int) -> np.ndarray:
    counts = np.bincount((_mixed(hashes) % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.minimum(counts, most).astype(np.uint8)


def _halves(counts: np.ndarray) -> np.ndarray:
    return counts[::2] | counts[1::2] << 4


def _threes(chosen: np.random.Generator, minima: int, count: int) -> np.ndarray:
    """Every minimum is in about as many keys as any other."""
    rounds = -(-3 * count // (minima - minima % 3))
    return np.concatenate([chosen.permutation(minima)[: minima - minima % 3].reshape(-1, 3) for _ in range(rounds)])[:count]


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _combined(rows: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One signed 64-bit key of each row of hashes, in their order."""
    out = _mixed(number + _A)
    for column in rows.T:
        out = _mixed(out * _C + column)
    return out.view(np.int64)


def _kmers(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of `words` words; of the whole text if that is shorter."""
    words = min(words, len(hashes))
    out = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
    for i in range(words):
        out = out * _C + _mixed(hashes[i : len(hashes) - words + 1 + i])
    return _mixed(out + np.uint64(words))


def _occurrence(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(kmers))
    out = np.empty(len(kmers), dtype=np.uint64)
    out[order] = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text (t1, t2) that tell a row's text within its id, and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, digest (of the words), words (their number), counts and keys of every row with an id and a text that is not blank."""

    def make():
        import xxhash

        sketcher = kept_in_worker(("near_text",), Sketcher)

        def work(rows):
            out = {n: [] for n in ("doc_id", "t1", "t2", "digest", "words", "counts", "keys")}
            for doc_id, t1, t2, text in rows:
                if words := words_of(text):
                    hashes = sketcher.hashes(words)
                    keys, counts = sketcher.sketch(hashes)
                    out["doc_id"].append(doc_id)
                    out["t1"].append(t1)
                    out["t2"].append(t2)
                    out["digest"].append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    out["words"].append(len(words))
                    out["counts"].append(counts)
                    out["keys"].append(keys)
            return out

        return work

    kept = _keyed(docs.where(F.col("doc_id").isNotNull()))
    return map_texts(kept, make, "doc_id bigint, t1 bigint, t2 bigint, digest binary, words int, counts binary, keys array<bigint>")


def text_nodes(sketched: DataFrame, path: str | None = None) -> DataFrame:
    """One row a digest: node, its smallest doc_id and that row's t1 and t2, words and counts. A table is written to path.

    A node's number is that doc_id. Where several digests share it, the others get
    numbers below zero made from their digests.
    """
    least = sketched.groupBy("digest").agg(F.min(F.struct("doc_id", "t1", "t2", "words", "counts")).alias("n")).select("digest", "n.*")
    least = written(least, path or fresh_path(sketched.sparkSession, "near-least"))
    shared = least.groupBy("doc_id").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    own = -F.lit(1) - F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1))
    node = F.when(F.col("first").isNull() | (F.col("first") == F.col("digest")), F.col("doc_id")).otherwise(own)
    return least.join(shared, "doc_id", "left").select(node.alias("node"), "digest", "doc_id", "t1", "t2", "words", "counts")


def node_texts(docs: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of (at least) every node, once."""
    rows = _keyed(docs.where(F.col("doc_id").isNotNull()))
    if sketched.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        return rows.select(F.col("doc_id").alias("node"), "text")  # a row is told by its id
    keys = ["doc_id", "t1", "t2"]
    return cut(rows.join(nodes.select("node", *keys), keys).groupBy(*keys, "node").agg(F.first("text").alias("text")).select("node", "text"))


def hot_keys(sketched: DataFrame) -> list[int]:
    """Keys that very many texts seem to share; a text counts once. A bounded list that only saves work."""
    some = sketched.where(F.pmod(F.xxhash64("digest"), F.lit(HOT_SAMPLE)) == 0).groupBy("digest").agg(F.first("keys").alias("keys"))
    found = some.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").count()
    told = found.where(F.col("count") >= max(2, HOT_ROWS // HOT_SAMPLE)).orderBy(F.desc("count"), "key").limit(MOST_HOT)
    return [r["key"] for r in told.collect()]


def bucket_rows(nodes: DataFrame, hot: list[int] = ()) -> DataFrame:
    """key and node of all buckets that several nodes share, from one shuffle. nodes: node, keys; rows of hot keys stay where they are."""

    def several(batches):
        held = None  # the last row, and whether its key has been told already
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            told = False
            if held is not None:
                key, node, told = np.append(held[0], key), np.append(held[1], node), held[2]
            same = key[1:] == key[:-1]
            shared = np.append(told, same) | np.append(same, False)
            held = key[-1:], node[-1:], bool(shared[-1])
            if shared[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][shared[:-1]]), pa.array(node[:-1][shared[:-1]])], names=["key", "node"])
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "node"])

    rows = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    listed = F.broadcast(nodes.sparkSession.createDataFrame([(k,) for k in hot], "key bigint"))
    dealt = rows.join(listed, "key", "left_anti") if hot else rows
    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(several, "key bigint, node bigint")
    return found.union(rows.join(listed, "key", "left_semi").select("key", "node")) if hot else found


def smallest_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes of a bucket with a as the smallest. rows: key, node."""
    first = rows.groupBy("key").agg(F.min("node").alias("a"))
    return rows.join(first, "key").where("node > a").select("a", F.col("node").alias("b")).distinct()


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by their word counts: no text is needed to tell the others."""

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.asarray(batch.column(k)) for k in (2, 4))
                yield batch.select([0, 1]).filter(pa.array(_may_be_similar(a, _bins(batch.column(3)), b, _bins(batch.column(5)))))

    of = lambda n: nodes.select(F.col("node").alias(n), F.col("words").alias(f"words_{n}"), F.col("counts").alias(f"counts_{n}"))
    told = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "words_a", "counts_a", "words_b", "counts_b")
    return told.mapInArrow(keep, "a bigint, b bigint")


def _placed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """key, node and component of rows."""
    merged = merged.withColumnRenamed("node", "member")
    return rows.join(merged, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))


def _apart_from_smallest(placed: DataFrame) -> DataFrame:
    """The rows whose component isn't that of their bucket's smallest node."""
    first = placed.groupBy("key").agg(F.min(F.struct("node", "component")).alias("f")).select("key", F.col("f.component").alias("of"))
    return placed.join(first, "key").where("component <> of").select("key", "node")


def meeting_groups(placed: DataFrame) -> DataFrame:
    """leader, one, node, component, here (keys) and large: the groups in which a node meets others, each once.

    Buckets of one component have nothing to compare. The others are put together
    by their smallest node, their leader: texts of one kind share many keys, and
    meet under one leader once instead of in every bucket. `one` is 0 then. A
    leader whose buckets have little in common keeps them apart (`one` is the
    key) where that copies fewer rows. Groups of more than BLOCK nodes are large.
    """
    blocks = lambda many: F.ceil(many / BLOCK).cast("bigint")
    several = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("node").alias("leader"), F.count(F.lit(1)).alias("all"))
    found = cut(placed.join(several.where("c < d").select("key", "leader", "all"), "key"))
    by_node = found.groupBy("leader", "node").agg(F.sum(blocks(F.col("all"))).alias("apart"))
    wide = by_node.groupBy("leader").agg(F.count(F.lit(1)).alias("many"), F.sum("apart").alias("apart")).where(F.col("many") > BLOCK)
    wide = cut(wide.select("leader", (F.col("many") * blocks(F.col("many")) <= F.col("apart")).alias("as_one")))  # one leader in BLOCK rows at most
    told = found.join(F.broadcast(wide) if wide.count() <= MOST_BROADCAST else wide, "leader", "left")
    apart = ~F.coalesce("as_one", F.lit(True))
    rows = told.select(
        "leader", F.when(apart, F.col("key")).otherwise(0).alias("one"), "node", "component", "key",
        F.when(apart, F.col("all") > BLOCK).otherwise(F.col("as_one").isNotNull()).alias("large"),
    )
    return rows.groupBy("leader", "one", "node", "component", "large").agg(F.sort_array(F.collect_list("key")).alias("here"))


def crossing_pairs(placed: DataFrame, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """All pairs of nodes of a bucket that are in different components and may be similar by their word counts. A table is written to path.

    A pair meets in every group in which both its nodes have a key, and is looked
    at in the first: rows carry the keys of their node in the groups before. Nodes
    outside a bucket's largest component (strays) meet all others. A group of up
    to BLOCK nodes is whole, and each node is sent to it once. A larger one is
    told apart by length, as similar texts are in one class of lengths or in two next
    to each other; there both sides are dealt in blocks, and a pair of blocks is one
    bounded group.
    """
    found = written(meeting_groups(placed), path or fresh_path(placed.sparkSession, "near-found"))
    # All keys with which a node may meet others; a text has a bounded number of keys.
    keys_of = found.groupBy("node").agg(F.collect_list(F.struct("leader", "one", "here")).alias("keys"))
    met = nodes.select("node", "words", "counts").join(keys_of, "node")
    earlier = F.filter("keys", lambda k: (k["leader"] < F.col("leader")) | (k["leader"] == F.col("leader")) & (k["one"] < F.col("one")))
    told = ("component", "node", "words", "counts", "here", F.flatten(F.transform(earlier, lambda k: k["here"])).alias("before"))
    group = ["leader", "one"]
    alone = [F.lit(n).alias(c) for c, n in (("size", -1), ("i", 0), ("j", 0), ("side", BOTH))]
    whole = found.where("not large").join(met, "node").select(*group, *alone, *told)
    size = F.floor(F.log("words") / -math.log(SIMILARITY) + 1e-9).cast("int")
    rows = found.where("large").join(nodes.select("node", "words"), "node").select(*group, "node", "component", "here", size.alias("own"))
    rows = cut(rows.withColumn("size", F.explode(F.array(F.col("own"), F.col("own") - 1))))
    parts = rows.groupBy(*group, "size", "component").agg(F.count(F.lit(1)).alias("many"), F.min("own").alias("least"))
    dealt = parts.groupBy(*group, "size").agg(
        F.max(F.struct("many", "component")).alias("largest"), F.sum("many").alias("all"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least")
    )
    blocks = lambda many: F.ceil(many / BLOCK).cast("int")
    dealt = dealt.where("parts > 1 and least = size").select(
        *group, "size", F.col("largest.component").alias("main"), blocks(F.col("all") - F.col("largest.many")).alias("strays"), blocks(F.col("all")).alias("blocks")
    )
    # The counts are many times longer than the rest: only rows that meet others are given them.
    known = rows.join(dealt, [*group, "size"]).join(met, "node")
    spread = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    stray = known.where("component <> main").select(
        *group, "size", F.pmod(F.xxhash64("node"), F.col("strays")).cast("int").alias("i"), spread("blocks").alias("j"), F.lit(0).alias("side"), *told
    )
    every = known.select(
        *group, "size", spread("strays").alias("i"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("j"), F.lit(1).alias("side"), *told
    )
    keys = [*group, "size", "i", "j"]

    def compare(batches):
        for group in groups(batches, 5):
            side = np.asarray(group["side"])
            ids, part, words = np.asarray(group["node"]), np.asarray(group["component"]), np.asarray(group["words"])
            here, before = (_KeySets(group[n].combine_chunks()) for n in ("here", "before"))
            counts, buckets, meets = None, here.buckets(), []
            for rows in buckets:
                if side[0] == BOTH:
                    _, member, many = np.unique(part[rows], return_inverse=True, return_counts=True)
                    # Each two strays meet once.
                    meets.append(np.where(member != many.argmax(), rows, len(ids)))
                else:
                    meets.append(np.where(side[rows] == 1, len(ids), -1))
            a, b = [], []
            for k in range(len(ids)):
                near = np.zeros(len(ids), dtype=bool)
                for key in here.of(k):
                    rows, turn = buckets[key], meets[key]
                    if turn[np.searchsorted(rows, k)] < len(ids):  # a stray
                        near[rows[turn > k]] = True
                met = np.flatnonzero(near & (part != part[k]))
                if not len(met):
                    continue
                met = met[~before.shared(k)[met]]
                counts = _bins(group["counts"]) if counts is None else counts
                met = met[_may_be_similar(words[k], counts[k], words[met], counts[met])]
                a.append(np.minimum(ids[met], ids[k]))
                b.append(np.maximum(ids[met], ids[k]))
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return whole.union(stray).union(every).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint").distinct()


class _KeySets:
    """The key lists of the rows of a group."""

    def __init__(self, lists: pa.ListArray):
        self.ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        known, self.keys = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        self.own = np.zeros(len(known), dtype=bool)

    def of(self, row: int) -> np.ndarray:
        """The keys of a row, numbered from 0."""
        return self.keys[self.ends[row] : self.ends[row + 1]]

    def buckets(self) -> list[np.ndarray]:
        """The rows of each key, ascending."""
        owner = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        order = np.argsort(self.keys, kind="stable")
        return np.split(owner[order], np.flatnonzero(np.diff(self.keys[order])) + 1)

    def shared(self, row: int) -> np.ndarray:
        """Which rows have a key of this one."""
        mine = self.of(row)
        self.own[mine] = True
        many = np.concatenate([[0], np.cumsum(self.own[self.keys])])[self.ends]
        self.own[mine] = False
        return many[1:] > many[:-1]


def _bins(column) -> np.ndarray:
    """A row a text: its words in BINS bins, then in FINE_BINS."""
    held = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BINS + FINE_BINS // 2)
    out = np.empty((len(held), BINS + FINE_BINS), dtype=np.uint8)
    out[:, :BINS] = held[:, :BINS]
    out[:, BINS::2], out[:, BINS + 1 :: 2] = held[:, BINS:] & 15, held[:, BINS:] >> 4
    return out


def _may_be_similar(words, counts, other_words, other_counts) -> np.ndarray:
    """Whether numbers of words, in all and a bin, leave it open that one text is similar to others, or each of several to its own other.

    An edit takes away and brings one word at most, whatever the bins are.
    """
    most = ((1 - SIMILARITY) * np.maximum(other_words, words) + 1e-9).astype(np.int64)
    close = np.abs(other_words.astype(np.int64) - words) <= most
    for bins in (slice(0, BINS), slice(BINS, None)):
        own = counts[bins] if counts.ndim == 1 else counts[close, bins]
        more = other_counts[close, bins].astype(np.int16) - own
        close[close] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most[close]
    return close


def linked(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar nodes that share a bucket. rows: key, node; nodes: node, words, counts; texts: node, text."""
    spark = rows.sparkSession
    links, apart, path = None, rows, None
    for turn in range(SMALLEST_ROUNDS):
        if turn:
            apart = cut(_apart_from_smallest(placed))
        found = cut(verified(_possible(smallest_pairs(apart), nodes), texts))
        # What was linked before is known by its components: each node and the smallest of its own.
        merged = cut(components(found if links is None else links.union(found)))
        links = merged.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        before, path = path, fresh_path(spark, "near-placed")
        placed = written(_placed(rows, merged), path)
        if before:
            discard(spark, before)
    crossing = fresh_path(spark, "near-found")
    links = cut(links.union(verified(crossing_pairs(placed, nodes, crossing), texts)))
    discard(spark, path)
    discard(spark, crossing)
    return links


def meetings(pairs: DataFrame) -> DataFrame:
    """lead, i, j, turn, node and near: the texts of each group in which pairs (a < b: nodes) are compared, once.

    A pair is told to the smallest node that its b is paired with, so the pairs of a
    dense set of nodes, which are many times its nodes, are one leader's. Its
    smaller and its larger nodes are dealt in blocks, and two blocks are a group:
    turn 0 has the smaller nodes, turn 1 the larger with their partners (near).
    """
    told = cut(pairs.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("lead")))
    blocks = lambda n, most: F.ceil(F.approx_count_distinct(n) / most).cast("int")
    wide = told.groupBy("lead").agg(blocks("a", LEADERS).alias("high"), blocks("b", PARTNERS).alias("across")).where("high > 1 or across > 1")
    wide = cut(wide)  # one leader in LEADERS pairs at most
    dealt = told.join(F.broadcast(wide) if wide.count() <= MOST_BROADCAST else wide, "lead", "left")
    block = lambda n, many: F.pmod(F.xxhash64(n), F.coalesce(many, F.lit(1))).cast("int")
    ends = F.array(
        F.struct(F.lit(0).alias("turn"), F.col("a").alias("node"), F.lit(None).cast("bigint").alias("near")), F.struct(F.lit(1).alias("turn"), F.col("b").alias("node"), F.col("a").alias("near"))
    )
    ends = dealt.select("lead", block("a", "high").alias("i"), block("b", "across").alias("j"), F.explode(ends).alias("e")).select("lead", "i", "j", "e.*")
    return ends.groupBy("lead", "i", "j", "turn", "node").agg(F.collect_set("near").alias("near"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b: nodes) whose texts are similar. One join fetches the texts of all meetings."""
    met = cut(meetings(pairs))
    asked = cut(met.select("node").distinct())
    known = texts.select("node", "text")
    if asked.count() <= MOST_ASKED:
        known = known.join(F.broadcast(asked), "node", "left_semi")
    rows = met.join(known, "node").select("lead", "i", "j", "turn", "node", "near", "text")

    def compare(batches):
        group, held, room = None, {}, HELD_WORDS
        for batch in batches:
            for some in slices(batch, 1 << 20):
                out_a, out_b = [], []
                for lead, i, j, turn, node, near, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if group != (lead, i, j):
                        group, held, room = (lead, i, j), {}, HELD_WORDS
                    words = words_of(text)
                    if not turn:
                        held[node] = words if len(words) <= room else text
                        room -= len(words) if held[node] is words else 0
                        continue
                    for a in near:
                        own = held.get(a)
                        if own is not None and similar(words_of(own) if isinstance(own, str) else own, words, least):
                            out_a.append(a)
                            out_b.append(node)
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    group = ["lead", "i", "j"]
    return rows.repartition(*group).sortWithinPartitions(*group, "turn", "node").mapInArrow(compare, "a bigint, b bigint")


def audit(nodes: DataFrame, texts: DataFrame, merged: DataFrame, most: int = AUDITED, skip: int = 0) -> tuple[int, int]:
    """True pairs of some nodes with all nodes, by comparison with every node, and how many of them are in one class."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "words", "counts").collect()[skip:]
    told = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["words"], bytes(r["counts"])) for r in asked])

    def near(batches):
        queries = [(n, w, _bins(pa.array([c]))[0]) for n, w, c in told.value]
        for batch in batches:
            if batch.num_rows:
                ids, words, counts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _bins(batch.column(2))
                for node, own, bins in queries:
                    met = ids[_may_be_similar(own, bins, words, counts)]
                    met = met[met != node]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(met, node)), pa.array(np.maximum(met, node))], names=["a", "b"])

    true = verified(nodes.select("node", "words", "counts").mapInArrow(near, "a bigint, b bigint").distinct(), texts)
    of = lambda n: merged.select(F.col("node").alias(n), F.col("component").alias(f"of_{n}"))
    row = true.join(of("a"), "a", "left").join(of("b"), "b", "left").agg(F.count(F.lit(1)), F.count_if(F.col("of_a") == F.col("of_b"))).first()
    return row[0], row[1]


def check_recall(nodes: DataFrame, texts: DataFrame, merged: DataFrame) -> tuple[int, int]:
    """audit, of more and more nodes until LEAST_TRUE pairs are seen or MOST_AUDITED or all nodes are asked.

    A recall below LEAST_RECALL is an error. Where there are fewer pairs, as many
    may be missing as of LEAST_TRUE: the check is never left out.
    """
    true = found = skip = 0
    most, count = AUDITED, None
    while True:
        more, met = audit(nodes, texts, merged, most, skip)
        true, found = true + more, found + met
        if true < LEAST_TRUE and count is None:
            count = nodes.count()
        if true >= LEAST_TRUE or most >= min(count, MOST_AUDITED):
            break
        most, skip = min(most * AUDIT_GROWS, MOST_AUDITED), most
    if true - found > (1 - LEAST_RECALL) * max(true, LEAST_TRUE) + 1e-9:
        raise RuntimeError(f"near texts: {found} of {true} audited pairs are in one class, fewer than {LEAST_RECALL}")
    return true, found


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, class_id and kept of every row with an id and a text that is not blank."""
    spark = docs.sparkSession
    paths = {name: fresh_path(spark, f"near-{name}") for name in ("sketched", "least", "nodes", "buckets", "rows", "classes")}
    sketched = written(sketch_documents(docs), paths["sketched"])
    nodes = written(text_nodes(sketched, paths["least"]), paths["nodes"])
    discard(spark, paths["least"])
    keys = sketched.groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("n")).select("digest", "n.keys")
    buckets = bucket_rows(keys.join(nodes.select("digest", "node"), "digest").select("node", "keys"), hot_keys(sketched))
    buckets = written(buckets, paths["buckets"])
    rows = written(sketched.select("doc_id", "t1", "t2", "digest"), paths["rows"])
    discard(spark, paths["sketched"])
    texts = node_texts(docs, rows, nodes)
    merged = cut(components(linked(buckets, nodes, texts)))
    discard(spark, paths["buckets"])
    check_recall(nodes, texts, merged)
    placed = nodes.join(merged, "node", "left").select("digest", "node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("l")).select("component", "l.doc_id", F.col("l.digest").alias("first"))
    of_text = placed.select("digest", "component").join(least.withColumnRenamed("doc_id", "class_id"), "component").select("digest", "class_id", "first")
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("first"))
    classed = rows.join(of_text, "digest").select("doc_id", "t1", "t2", "class_id", kept.alias("kept"))
    classed = written(classed, paths["classes"])
    discard(spark, paths["nodes"])
    discard(spark, paths["rows"])
    return classed


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and kept (whether the row has that id and its text) of every row."""
    blank = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))
    own = F.col("doc_id").cast("bigint")
    alone = blank.select(own.alias("doc_id"), own.alias("class_id"), F.lit(True).alias("kept"))
    return _classed(docs).select("doc_id", "class_id", "kept").union(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, one for each class, with all their columns.

    A row is told by its id and text. Rows equal in both are one; rows without an id
    or with a blank text all stay.
    """
    decided = _classed(docs)
    keys = ["doc_id", "t1", "t2"]
    text = F.col("text").cast("string")
    told = [F.col("doc_id").cast("bigint"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [free_name(n, docs.columns) for n in ("_d", "_t", "_u")]
    rows = docs.select(*columns, *[t.alias(n) for t, n in zip(told, names, strict=True)])
    named = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    left = rows.join(named(decided.where("not kept")).distinct(), names, "left_anti")
    repeated = cut(named(decided.where("kept").groupBy(*keys).count().where("count > 1")))
    if not repeated.isEmpty():
        left = left.join(repeated, names, "left_anti").select(*columns, *names).union(
            left.join(repeated, names, "left_semi").dropDuplicates(names).select(*columns, *names)
        )
    return left.select(*columns)
