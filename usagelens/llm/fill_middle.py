"""Operator 12: fill-in-the-middle, with cuts found by rank and select over packed line ends.

The texts of an Arrow slice lie in one buffer. A bit vector over its bytes marks
the last byte of every line (a line ends with its line feed, or with the text),
another the first byte of every code point; both are packed eight to a byte,
with the ones before each block of 512 bits in a directory. Ranks at the texts'
bounds give their numbers of lines, a select for each of the two cuts gives its
byte, ranks in the other vector turn bytes into code points.

Where a document is cut and how it is put together come from the digest of a
seed and its id alone, so a run again gives the same. A text that is empty or
holds one of the marks stays plain, since marks would not tell its parts.

Cases: a null text is an empty text; a null doc_id counts as no digits and stays
null; rows of one id are cut by the same numbers, each by its own lines, so
repeated rows give equal results; both cuts may meet, at either end too, and
leave parts empty; an empty table gives no rows; other columns are ignored,
whatever they are called. Very long texts are cut whole, a few at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import slices

# What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BITS = 512
WORD_BYTES = 8
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class BitVector:
    """Packed bits with the ones before every block; rank and select of many places at once."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        per_block = BLOCK_BITS // 8
        self.packed = np.zeros((len(packed) // per_block + 1) * per_block, dtype=np.uint8)
        self.packed[: len(packed)] = packed
        self.words = self.packed.view("<u8")
        in_words = np.bitwise_count(self.words).astype(np.int64).reshape(-1, per_block // WORD_BYTES)
        #: Ones before each block, and in a block through each of its words.
        self.before_block = np.concatenate(([0], np.cumsum(in_words.sum(axis=1))))
        self.in_block = np.cumsum(in_words, axis=1)

    @property
    def ones(self) -> int:
        return int(self.before_block[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word, bit = at // BLOCK_BITS, at // 64, at % 64
        in_block = word % (BLOCK_BITS // 64)
        ahead = np.where(in_block > 0, self.in_block[block, in_block - 1], 0)
        below = self.words[word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before_block[block] + ahead + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, counted from 0."""
        block = np.searchsorted(self.before_block, k, side="right") - 1
        left = k - self.before_block[block]
        in_block = self.in_block[block]
        nth = (in_block <= left[:, None]).sum(axis=1)
        left = left - np.where(nth > 0, in_block[np.arange(len(k)), nth - 1], 0)
        word = block * (BLOCK_BITS // 64) + nth
        octets = self.packed.reshape(-1, WORD_BYTES)[word]
        through = np.cumsum(_ONES[octets], axis=1, dtype=np.int64)
        nth = (through <= left[:, None]).sum(axis=1)
        left = left - np.where(nth > 0, through[np.arange(len(k)), nth - 1], 0)
        bits = np.unpackbits(octets[np.arange(len(k)), nth][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return word * 64 + nth * 8 + bit


def numbers(doc_id, seed: int) -> list:
    """The first four 8-digit groups of the digest of a seed and an id, as columns h1 to h4."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def line_cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its lines, the bytes of its two cuts, and the code points before the first and between both."""
    offsets, data = _bytes_of(texts)
    starts, ends = offsets[:-1], offsets[1:]
    filled = ends > starts
    line_ends = data == 0x0A
    line_ends[ends[filled] - 1] = True
    lines, points = BitVector(line_ends), BitVector((data & 0xC0) != 0x80)
    before = lines.rank(starts)
    n = lines.rank(ends) - before
    a, b = h1 % (n + 1), h2 % (n + 1)
    cuts = [starts.copy(), starts.copy()]
    for cut, units in zip(cuts, (np.minimum(a, b), np.maximum(a, b)), strict=True):
        inside = units > 0
        cut[inside] = lines.select((before + units - 1)[inside]) + 1
    to_first, to_second = points.rank(cuts[0]), points.rank(cuts[1])
    return n, cuts[0] - starts, cuts[1] - starts, to_first - points.rank(starts), to_second - to_first


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 on and the bytes of an array of strings without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def put_together(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str) -> bytes:
    """The text from an output and its form alone."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, _, rest = output.partition(s if form == "psm" else p)
    second, _, middle = rest.partition(m)
    if form == "psm":
        return first.removeprefix(p) + middle + second
    return second + middle + first.removeprefix(s)


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, percent_spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and restored (both strings) of every row of docs (doc_id, text)."""
    def texts(output: bytes, restored: bytes) -> tuple:
        return output.decode(), restored.decode()

    return _run(docs, seed, percent, percent_spm, texts, "output string, restored string")


def digest_documents(docs: DataFrame, seed: int = 7, percent: int = 100, percent_spm: int = 50) -> DataFrame:
    """The same with output_sha256 and restored_sha256 for the texts, digested where they are made."""
    def digests(output: bytes, restored: bytes) -> tuple:
        return hashlib.sha256(output).hexdigest(), hashlib.sha256(restored).hexdigest()

    return _run(docs, seed, percent, percent_spm, digests, "output_sha256 string, restored_sha256 string")


def _run(docs: DataFrame, seed: int, percent: int, percent_spm: int, tell: Callable[[bytes, bytes], tuple], told: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    kept = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *numbers(doc_id, seed))
    schema = docs.sparkSession.createDataFrame([], f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, {told}").schema
    names = schema.names
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                text = part.column("text")
                h = [part.column(f"h{i}").to_numpy() for i in range(1, 5)]
                n, first, second, prefix_chars, middle_chars = line_cuts(text, h[0], h[1])
                forms, outputs, plain = [], [], []
                for raw, a, b, h3, h4 in zip(text.cast(pa.binary()).to_pylist(), first.tolist(), second.tolist(), h[2].tolist(), h[3].tolist(), strict=True):
                    keep = not raw or h3 % 100 >= percent or any(m in raw for m in marks)
                    form = "plain" if keep else "spm" if h4 % 100 < percent_spm else "psm"
                    output = raw if keep else put_together(form, raw[:a], raw[a:b], raw[b:])
                    plain.append(keep)
                    forms.append(form)
                    outputs.append(tell(output, restore(output, form)))
                counts = [pa.array(c, mask=np.array(plain)) for c in (prefix_chars, middle_chars)]
                columns = [part.column("doc_id"), pa.array(n), pa.array(forms), *counts, *[pa.array(c) for c in zip(*outputs, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
