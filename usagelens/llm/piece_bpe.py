"""Operator 13: SentencePiece models of the merge type, encoded by an agenda of adjacent symbol pairs.

Each character of a text is a symbol first. An agenda holds the pairs of
neighbours that together are a piece, best score first and leftmost among equal
scores; the pair taken becomes one symbol and its two new neighbour pairs are
put on the agenda. A pair one of whose symbols has changed since is passed over.
The agenda is a heap; that of a short segment is a plain list of its pairs' scores
in the order of their places. What is left are the pieces; a symbol that is none is told byte by byte.

Two characters that stand side by side in no piece are never merged, so a text
may be cut between them. If no piece reaches from another character to a space
mark, texts are cut before each run of marks first, and these segments at all
other such places if they are long; both are remembered. Each segment that a worker encodes is
compared with the sentencepiece library, all new ones of an Arrow slice at once;
a difference is an error. Ids are decoded by the library.

Cases: a null text is an empty text; an empty text has no ids, and its digests
are those of no bytes; a null doc_id stays null; repeated rows are encoded each;
equal scores go by place; an empty table gives no rows; other columns are
ignored, whatever they are called. A text of any length is encoded whole, and
one without a space takes time in proportion to n log n.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import Memo, kept_in_worker, map_texts

DEFAULT_MODEL = "piece_bpe_32k.model"
#: What stands for a space in pieces.
MARK = "▁"
#: Segments and parts of longer ones that each worker remembers, and the longest of them.
MEMO_SEGMENTS, MEMO_PARTS = 700_000, 100_000
LONGEST_REMEMBERED = 64
#: The score of a pair that is no piece, below all others.
NO_PIECE = float("-inf")


class MergeModel:
    """Pieces and scores of a merge-type model that takes texts as they are, with a mark put before."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        kinds = model.SentencePiece.Type
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model with the space mark in front")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models that take texts as they are, with a space put before, are encoded")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not encoded")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.id_of = {p.piece: i for i, p in normal}
        self.score_of = {p.piece: p.score for _, p in normal}
        self.digits = [str(i) for i in range(len(model.pieces))]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE] if model.trainer_spec.byte_fallback else []
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("byte pieces are incomplete")
        #: What stands side by side in a piece.
        self.neighbours = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cuts_before_marks = all(a == MARK for a, b in self.neighbours if b == MARK)

    def parts(self, text: str) -> Iterator[str]:
        """text, cut wherever no merge can reach across."""
        neighbours, at = self.neighbours, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in neighbours:
                yield text[at:i]
                at = i
        yield text[at:]

    def encode(self, marked: str) -> tuple[int, ...]:
        """Ids of a text in which spaces are marks already."""
        score_of, push, pop = self.score_of.get, heapq.heappush, heapq.heappop
        symbols = list(marked)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        #: The piece that each symbol is together with its right neighbour now; None where they are none.
        joint: list[str | None] = [None] * size
        agenda: list[tuple[float, int, str]] = []
        for left in range(size - 1):
            pair = symbols[left] + symbols[left + 1]
            if (score := score_of(pair)) is not None:
                agenda.append((-score, left, pair))
                joint[left] = pair
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = pop(agenda)
            if joint[left] is not pair:
                continue  # one of the two has changed since
            right = after[left]
            symbols[left], symbols[right] = pair, ""
            joint[left] = joint[right] = None
            further = after[left] = after[right]
            nearer = before[left]
            if further >= 0:
                before[further] = left
                joined = pair + symbols[further]
                if (score := score_of(joined)) is not None:
                    push(agenda, (-score, left, joined))
                    joint[left] = joined
            if nearer >= 0:
                joined = symbols[nearer] + pair
                if (score := score_of(joined)) is not None:
                    push(agenda, (-score, nearer, joined))
                    joint[nearer] = joined
                else:
                    joint[nearer] = None
        return self._ids(symbols)

    def encode_short(self, marked: str) -> tuple[int, ...]:
        """As encode; time is in proportion to the square of the length, and a few microseconds for a word."""
        score_of, symbols = self.score_of.get, list(marked)
        scores = [score_of(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while scores and (best := max(scores)) != NO_PIECE:
            at = scores.index(best)  # the leftmost
            symbols[at] = joined = symbols[at] + symbols.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = score_of(joined + symbols[at + 1], NO_PIECE)
            if at:
                scores[at - 1] = score_of(symbols[at - 1] + joined, NO_PIECE)
        ids = tuple(map(self.id_of.get, symbols))
        return self._ids(symbols) if None in ids else ids

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                if (known := self.id_of.get(symbol)) is not None:
                    ids.append(known)
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in symbol.encode())
                else:
                    ids.append(self.unknown)
        return tuple(ids)


class Codec:
    """Whole texts to ids and back; every segment that is encoded is compared with the library by `check`."""

    def __init__(self, serialized: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=serialized)
        self.model = MergeModel(serialized)
        self.unchecked: list[tuple[str, tuple[int, ...]]] = []
        self.after_mark = Memo(self._segment, MEMO_SEGMENTS)
        self.of_part = Memo(lambda p: (self.model.encode_short if len(p) <= LONGEST_REMEMBERED else self.model.encode)(p), MEMO_PARTS)

    def _segment(self, rest: str) -> tuple[int, ...]:
        if len(rest) <= LONGEST_REMEMBERED:
            ids = self.model.encode_short(MARK + rest)
        else:
            known = self.of_part
            parts = self.model.parts(MARK + rest)
            ids = tuple(chain.from_iterable([known[p] if len(p) <= LONGEST_REMEMBERED else known.compute(p) for p in parts]))
        self.unchecked.append((rest, ids))
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if not self.model.cuts_before_marks:
            return list(self._segment(marked))
        parts = marked.split(MARK)
        if "" in parts:
            parts = _runs(parts)
        known = self.after_mark
        return list(chain.from_iterable([known[p] if len(p) <= LONGEST_REMEMBERED else self._segment(p) for p in parts]))

    def check(self) -> None:
        """Compare what was encoded since the last call with the library."""
        told, self.unchecked = self.unchecked, []
        rests = [rest for rest, _ in told]
        for (rest, ids), wanted in zip(told, self.library.encode(rests, num_threads=1) if rests else [], strict=True):
            # The library puts no mark before an empty text.
            if rest and list(ids) != wanted:
                raise ValueError(f"encoded unlike the library: {rest[:80]!r}")

    def decode(self, many: list[list[int]]) -> list[str]:
        return self.library.decode(many, num_threads=1) if many else []


def _runs(parts: list[str]) -> list[str]:
    """The parts between single marks, with empty ones put before the next as marks: a run of marks belongs to what follows it."""
    out, marks = [], 0
    for part in parts[:-1]:
        if part:
            out.append(MARK * marks + part)
            marks = 0
        else:
            marks += 1
    return [*out, MARK * marks + parts[-1]]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row of docs (doc_id, text)."""
    return _run(docs, path, whole=True)


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, digested where the ids are made."""
    return _run(docs, path, whole=False)


def _run(docs: DataFrame, path: str | None, whole: bool) -> DataFrame:
    path = path or public_tokenizers.path(DEFAULT_MODEL)
    with open(path, "rb") as f:
        # A vocabulary is of a fixed size, whatever the texts.
        serialized = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = kept_in_worker(("piece_bpe", path), lambda: Codec(serialized.value))

        def work(rows: list[tuple]) -> dict[str, list]:
            ids = [codec.encode(text or "") for _, text in rows]
            codec.check()
            decoded = codec.decode(ids)
            digits = codec.model.digits.__getitem__
            out: dict[str, list] = {"doc_id": [doc_id for doc_id, _ in rows]}
            if whole:
                return out | {"ids": ids, "decoded": decoded}
            return out | {
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(digits, i)).encode()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
            }

        return work

    columns = "ids array<int>, decoded string" if whole else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(kept, make, f"doc_id bigint, {columns}")
