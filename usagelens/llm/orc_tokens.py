"""Operator 1: token ids in ORC files, in ascending doc_id order.

Texts are range-partitioned and sorted by doc_id, encoded where they land and
written as ORC: integers are run-length encoded in stripes, row indexes and a
Bloom filter on doc_id let readers skip stripes and row groups. Each row carries
its start within its file, so the start in the whole corpus needs one running
sum over files, not over documents.

Cases: a null text is an empty text, encoded as the end id alone; a null
doc_id sorts first; rows that share a doc_id stay together, in neighbouring files
if they are many, ordered by a hash of the text; an empty table gives no rows;
other columns are ignored. Added tokens of the tokenizer that stand in a text are
found as the library finds them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import fresh_path, kept_in_worker, slices

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MEMO_WORDS = 800_000
LONGEST_REMEMBERED = 64
ROWS_PER_INDEX = 1000
WORDS_AT_ONCE = 2000
#: Signs that may end a word; an apostrophe isn't one, since it may begin a part with letters.
SIGNS = "!?.,;:%&*#$|()\"-"
SLICE_BYTES = 4 << 20


class WordEncoder:
    """The tokenizers library's ids of texts, with a memo of words.

    The library splits at white space and lower-cases, so no token reaches over
    white space: in plain texts each distinct word goes to the library once and
    Arrow finds the words. Any other text goes to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition)
        # The library finds added tokens in the text as it stands, glued to words too: such texts go to it whole.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # Which ids end a word, if every word has such an end: the library's quicker call doesn't number the words.
        vocabulary, suffix = self.tokenizer.get_vocab(), json.loads(definition)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        if suffix and all(letter + suffix in vocabulary for letter in ByteLevel.alphabet()):
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Combining marks reach over letters; the separators are white space and the
        # dotted capital has two lower-case letters to some libraries alone.
        self.not_plain = re.compile("[\x1c-\x1f\u0130\u0300-\U0010ffff]").search
        self.signs_meet = re.compile(r"[.,](?<=[^\s\w].|_.) ").search

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of letters alone, many at a time: each is one part to the library's splitter."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            [packed] = self._whole([" ".join(some)])
            edge = np.flatnonzero(self.ends[np.frombuffer(packed, dtype="<u4")]) + 1
            # Every part of a word has one end: as many ends as words are one each.
            if len(edge) != len(some) or 4 * edge[-1] != len(packed):
                out += self._whole(some)
                continue
            edge = (4 * edge).tolist()
            out += [packed[i:j] for i, j in zip([0, *edge[:-1]], edge, strict=True)]
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Signs after letters are a part of their own, so both sides are looked up apart."""
        plain, others = [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            else:
                core = w.rstrip(SIGNS)
                others.append((w, core if len(core) < len(w) and core.isalpha() else ""))
        out = dict(zip(plain, self._letters(plain), strict=True))
        parts = {p for w, core in others for p in ((core, w[len(core) :]) if core else (w,)) if p not in out}
        known = {p: ids for p in parts if (ids := self.words.get(p) or self.older.get(p)) is not None}
        rest = [p for p in parts if p not in known]
        letters, signed = [p for p in rest if p.isalpha()], [p for p in rest if not p.isalpha()]
        known.update(zip(letters, self._letters(letters), strict=True))
        known.update(zip(signed, self._whole(signed), strict=True))
        self._keep(known)
        for w, core in others:
            one = out.get(core) or known.get(core) if core else known[w]
            out[w] = one + known.get(w[len(core) :], out.get(w[len(core) :], b"")) if core else one
        return [out[w] for w in words]

    def _keep(self, found: dict[str, bytes]) -> None:
        if found and len(max(found, key=len)) > LONGEST_REMEMBERED:
            found = {w: ids for w, ids in found.items() if len(w) <= LONGEST_REMEMBERED}
        self.words.update(found)

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of words, looked up or encoded; long words are not remembered."""
        found = list(map(self.words.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not missing:
            return found
        if len(self.words) + len(missing) > MEMO_WORDS // 2:
            self.older, self.words = self.words, {}
        told = dict(zip(missing, map(self.older.get, missing), strict=True))
        new = [w for w, ids in told.items() if ids is None]
        told.update(zip(new, self._new(new), strict=True))
        self._keep(told)
        return [told[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has."""
        plain, lowered = [], []
        for i, text in enumerate(texts):
            if not self.not_plain(text):
                low = text.lower()
                if not any(a in low for a in self.added):
                    plain.append(i)
                    lowered.append(low)
        # A lone sign between a word and a space is a part of its own.
        lowered = [t if self.signs_meet(t) else t.replace(". ", " . ").replace(", ", " , ") for t in lowered]
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = split.values.dictionary_encode()
        known = self._learned(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        pool = pa.array(np.frombuffer(b"".join(known), dtype="<u4"))
        # A slice has a few million ids, so places fit 32 bits; each word's ids are copied from the pool.
        told = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pool).take(coded.indices)
        ids, edge = told.values.to_numpy(), told.offsets.to_numpy()[split.offsets.to_numpy()]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[plain] = np.diff(edge)
        others = sorted(set(range(len(texts))) - set(plain))
        if not others:
            return ids, counts
        parts = [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        whole = dict(zip(plain, parts, strict=True))
        for i, packed in zip(others, self._whole([texts[i] for i in others]), strict=True):
            whole[i] = np.frombuffer(packed, dtype="<u4")
            counts[i] = len(whole[i])
        return np.concatenate([whole[i] for i in range(len(texts))]), counts


def write_orc(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write doc_id, start_in_file, n_tokens and ids of every row of docs (doc_id, text) to path."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        encoder = kept_in_worker(("orc_tokens", tokenizer), lambda: WordEncoder(definition.value))
        written = 0
        for batch in batches:
            for rows in slices(batch, SLICE_BYTES):
                ids, counts = encoder.encode(rows.column(1).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end)
                edges = np.concatenate([[0], np.cumsum(counts + 1)])
                listed = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [rows.column(0), pa.array(written + edges[:-1]), pa.array(counts + 1), listed]
                written += int(edges[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start_in_file", "n_tokens", "ids"])

    # Every file is one task's range, so start_in_file counts from the file's first row.
    # Rows that share an id may fill several ranges, so a hash of the text and the row's number deal them too.
    text = F.coalesce("text", F.lit(""))
    order = ["doc_id", "hash", "row"]
    ordered = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = ordered.mapInArrow(run, "doc_id bigint, start_in_file bigint, n_tokens bigint, ids array<int>")
    (
        encoded.write.mode("errorifexists")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.dictionary.key.threshold", "0").option("compression", "zstd")
        .option("maxRecordsPerFile", 0).orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, start_in_file, n_tokens and ids of every row of the files."""
    rows = spark.read.schema("doc_id bigint, start_in_file bigint, n_tokens bigint, ids array<int>").orc(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "*")


def file_starts(rows: DataFrame) -> DataFrame:
    """How many ids the files before each file hold. Only small columns are read; the table has a row a file."""
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("in_file"))
    # Part names ascend with the ranges; they break ties between files of null ids.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))


def digest(rows: DataFrame) -> DataFrame:
    """file, doc_id, start_in_file, n_tokens and ids_crc32, counted from the ids that were read."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            edges = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            counted = pa.array(np.diff(edges).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], counted, pa.array(sums, pa.int64())],
                names=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
            )

    kept = rows.select("file", "doc_id", "start_in_file", "ids")
    return kept.mapInArrow(run, "file string, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as ORC in the shared folder, read the files back and digest what they hold."""
    path = fresh_path(docs.sparkSession, "orc_tokens")
    write_orc(docs, path, tokenizer)
    rows = read_orc(docs.sparkSession, path)
    start = (F.col("file_start") + F.col("start_in_file")).alias("start")
    return digest(rows).join(file_starts(rows), "file").select("doc_id", start, "n_tokens", "ids_crc32")
