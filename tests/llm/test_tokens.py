import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from usagelens.llm import byte_bpe, orc_tokens
from usagelens.llm.queries import op1_orc_tokens, op10_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def random_texts():
    rng = random.Random(1)
    letters = "abthe'sé1 \n漢\U0001f389ing  "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 500, "x  \n y", "\x1ca\x1d b"]


def test_byte_bpe_is_merging_by_rank(ranks, encoding):
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    for text in random_texts():
        ids = np.frombuffer(codec.encode(text), dtype="<u4").tolist()
        assert ids == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_query(spark, small, encoding):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op10_byte_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_byte_bpe_of_odd_and_no_documents(odd_documents, no_documents, encoding):
    rows = byte_bpe.encode_documents(odd_documents).collect()
    told = sorted((r.ids, bytes(r.decoded)) for r in rows)
    assert told == sorted((encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd_documents.collect())
    assert byte_bpe.digest_documents(no_documents).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder_gives_the_librarys_ids(tokenizer):
    encoder = orc_tokens.WordEncoder(tokenizer.to_str())
    texts = [*random_texts(), "İstanbul ǅ", "Don't ..., stop. _a, b"]
    for mark in ("<|endoftext|>", "<|startoftext|>"):
        texts += [mark, f"{mark} x", f"pre {mark} post", f"pre{mark}post.", f"a {mark}{mark} b {mark}", f"A{mark.upper()}b {mark.title()}", f"{mark[:-1]} {mark[1:]}", f"é{mark}é, {mark}"]
    for _ in range(2):  # the second time from the memo
        ids, counts = encoder.encode(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_files(rows, docs, tokenizer):
    docs = sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id, d.text or ""))
    rows = sorted(rows, key=lambda r: r.start)
    start = 0
    for d, r in zip(docs, rows, strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(le(ids)))
        start += len(ids)


def test_words_of_letters_are_told_apart_by_their_ends(tokenizer):
    """Many words go through the library's quicker call at once; without known ends each goes alone."""

    class Quick:
        encode_batch_fast = staticmethod(tokenizer.encode_batch_fast)

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abehtéßñöw") for _ in range(rng.randint(1, 12))) for _ in range(5000)})
    encoder = orc_tokens.WordEncoder(tokenizer.to_str())
    assert encoder.ends.any()
    encoder.tokenizer = Quick()
    wanted = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
    assert encoder._letters(words) == wanted and encoder._letters(["a b", *words]) == [encoder._whole(["a b"])[0], *wanted]
    encoder.ends[:] = False
    assert encoder._letters(words) == wanted


def test_orc_query(spark, small, tokenizer):
    check_files(op1_orc_tokens(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet").collect(), tokenizer)


def test_orc_of_odd_and_no_documents(odd_documents, no_documents, tokenizer):
    check_files(orc_tokens.token_files(odd_documents).collect(), odd_documents.collect(), tokenizer)
    assert orc_tokens.token_files(no_documents).count() == 0


def test_rows_of_one_id_fill_several_files(spark, tokenizer, tmp_path):
    rows = spark.createDataFrame([(5, f"text {i % 40}") for i in range(400)] + [(None, "x")] * 50 + [(9, None), (1, "<|endoftext|>")], "doc_id bigint, text string")
    path = f"file://{tmp_path}/orc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        orc_tokens.write_orc(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = orc_tokens.read_orc(spark, path)
    assert read.where("doc_id = 5").select("file").distinct().count() > 1
    found = sorted(orc_tokens.digest(read).join(orc_tokens.file_starts(read), "file").selectExpr("file_start + start_in_file AS start", "doc_id", "n_tokens").collect())
    assert [r.doc_id for r in found] == [None] * 50 + [1] + [5] * 400 + [9]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    want = sorted(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows.collect())
    assert sorted(r.n_tokens for r in found) == want


def test_orc_files_are_sorted_and_prunable(spark, small, tmp_path):
    path = f"file://{tmp_path}/orc"
    orc_tokens.write_orc(spark.read.parquet(f"{small}/documents.parquet"), path)
    import pyarrow.orc

    for file in tmp_path.glob("orc/*.orc"):
        found = pyarrow.orc.ORCFile(file)
        ids = found.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and found.row_index_stride == orc_tokens.ROWS_PER_INDEX
        assert b"doc_id" in file.read_bytes()[-4096:]
    rows = orc_tokens.read_orc(spark, path).where("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in rows._jdf.queryExecution().toString()
    assert rows.count() == 1


def test_a_codec_keeps_bounded_memory():
    """A word that is one piece with its space is remembered once, and the memos stay small beside each other."""
    codec = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.DEFAULT_RANKS)), public_tokenizers.PATTERN)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(5000)]
    packed = codec.encode(" ".join(["first", *words]))
    assert packed == codec.pack(" ".join(["first", *words])) and len(codec.after_space) == 5000
    fresh = byte_bpe.Codec(codec.encoder.ranks, public_tokenizers.PATTERN)
    fresh.encode(" ".join(["first", *words]))
    assert len(fresh.pieces) == 1
    assert byte_bpe.MEMO_WORDS + byte_bpe.MEMO_PIECES + byte_bpe.MEMO_PAIRS <= 600_000
