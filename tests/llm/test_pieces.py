import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from usagelens.llm import piece_bpe
from usagelens.llm.common import table
from usagelens.llm.queries import op13_piece_bpe


@pytest.fixture(scope="module")
def serialized():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(serialized):
    return SentencePieceProcessor(model_proto=serialized)


def odd_texts():
    rng = random.Random(4)
    letters = "abthe'sé1 \n漢\U0001f389ing   ▁\u0000Åﬁ​﻿0123THE\t　�"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    return texts + [" " * k for k in range(40)] + ["▁" * 300 + "x", "a" * 20_000, "the" * 9000, " the" * 5000, "x ", " x", "<s> </s> <unk> <0x41>"]


def test_ids_and_texts_are_the_librarys(serialized, library):
    codec = piece_bpe.Codec(serialized)
    for _ in range(2):  # the second time from the memo
        for text in odd_texts():
            ids = codec.encode(text)
            assert ids == library.encode(text), text[:80]
            assert codec.decode([ids]) == [library.decode(ids)]
    codec.check()


def test_short_segments_are_merged_by_the_list(serialized, library, monkeypatch):
    """Words take no heap, cut or not; their ids are the heap's and the library's, ties and unknown letters too."""
    codec = piece_bpe.Codec(serialized)
    words = {w for text in odd_texts() for w in text.replace(" ", piece_bpe.MARK).split(piece_bpe.MARK) if len(w) <= piece_bpe.LONGEST_REMEMBERED}
    told = {w: codec.model.encode(piece_bpe.MARK + w) for w in words}
    assert all(list(ids) == library.encode(w) for w, ids in told.items() if w) and len(told) > 3000
    monkeypatch.setattr(piece_bpe.heapq, "heapify", None)
    assert {w: codec.after_mark[w] for w in words} == told
    codec.check()


def test_whole_texts_without_cuts(serialized, library):
    codec = piece_bpe.Codec(serialized)
    codec.model.cuts_before_marks = False
    for text in odd_texts()[:500]:
        assert codec.encode(text) == library.encode(text)
    codec.check()


def test_a_wrong_segment_is_an_error(serialized):
    codec = piece_bpe.Codec(serialized)
    del codec.model.score_of["▁the"]
    codec.encode("so the other")
    with pytest.raises(ValueError, match="unlike the library"):
        codec.check()


def test_other_kinds_of_models_are_refused(serialized):
    for change in ("unigram", "trimmed", "defined"):
        model = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        if change == "unigram":
            model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
        elif change == "trimmed":
            model.normalizer_spec.remove_extra_whitespaces = True
        else:
            model.pieces[500].type = model.SentencePiece.USER_DEFINED
        with pytest.raises(ValueError):
            piece_bpe.MergeModel(model.SerializeToString())


def test_query(spark, small, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    rows = op13_piece_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_and_no_documents(odd_documents, no_documents, library):
    told = sorted(((r.doc_id, r.ids, r.decoded) for r in piece_bpe.encode_documents(odd_documents).collect()), key=repr)
    wanted = [(r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in odd_documents.collect()]
    assert told == sorted(wanted, key=repr)
    assert piece_bpe.digest_documents(no_documents).count() == 0
