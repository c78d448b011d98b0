"""Operator 10: byte-level BPE by backtracking from longest matches.

Token bytes are mapped to Latin-1 strings and put in an Aho-Corasick automaton,
which lists every token that occurs in a piece. From left to right the longest
token is taken whose pair with its left neighbour survives merging unchanged;
where none does, the last token is given back for its next shorter one.
Positions from which no way leads on are marked, so work is linear in a piece.
A sequence whose neighbours are all stable is the result of merging by rank.

Cases: a null text is an empty text; an empty text has no tokens, and its
digests are those of no bytes; an empty table gives no rows; other columns are
ignored. Repeated rows are encoded each. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import Memo, kept_in_worker, map_texts

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Entries of each worker's memos; with two workers an executor, and models of earlier stages before them, larger ones fill its memory.
MEMO_WORDS = 200_000
MEMO_PIECES = 100_000
MEMO_PAIRS = 200_000
#: Longer pieces are encoded but not remembered.
LONGEST_REMEMBERED = 64
#: Beyond every rank.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingEncoder:
    """Encodes one piece of text at a time; state is only memos of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {token: raw for raw, token in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for raw, token in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), token))
        self.automaton.make_automaton()
        self.stable = Memo(self._stable, MEMO_PAIRS)
        self.edges = Memo(self._edges, 2 * len(ranks))

    def _edges(self, token: int):
        """How the first and the last part of a token grow while it is merged: (part, rank of the merge that ends it).

        False for a token that merging its own bytes does not give back.
        """
        parts = [bytes([b]) for b in self.bytes_of[token]]
        first: list[tuple[bytes, int]] = []
        last: list[tuple[bytes, int]] = []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return False
            if at == 0:
                first.append((parts[0], rank))
            if at == len(parts) - 2:
                last.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*first, (parts[0], NEVER)], [*last, (parts[0], NEVER)]

    def _stable(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both tokens leaves just these two.

        Both sides merge as they would alone unless, at some time, the last part
        of the left and the first part of the right may merge before either grows.
        Of equal ranks the leftmost merge comes first.
        """
        left, right = pair
        if left < 0:
            return self.edges[right] is not False
        if self.edges[left] is False or self.edges[right] is False:
            return False
        ends, starts = self.edges[left][1], self.edges[right][0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            rank = self.ranks.get(a + b, NEVER)
            if rank != NEVER and rank < a_until and rank <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - length + 1].append((length, token))
        # In each list lengths ascend; untried[p] counts the tokens at p that are still to be tried.
        size, at = len(piece), 0
        dead = bytearray(size + 1)
        chosen: list[tuple[int, int, int]] = []
        untried = len(starts[0])
        while at < size:
            left = chosen[-1][1] if chosen else -1
            while untried:
                untried -= 1
                length, token = starts[at][untried]
                if not dead[at + length] and self.stable[left, token]:
                    chosen.append((at, token, untried))
                    at += length
                    untried = len(starts[at]) if at < size else 0
                    break
            else:
                if not chosen:
                    raise ValueError("no tokens for a byte: the vocabulary lacks single bytes")
                dead[at] = 1
                at, _, untried = chosen.pop()
        return [token for _, token, _ in chosen]


class Codec:
    """Whole texts to packed ids and back, with a memo of the words of this worker's texts.

    Pieces of the pattern never reach from one word over a single space into the
    next, so a text whose spaces all follow a non-space is encoded word by word.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.encoder = BacktrackingEncoder(ranks)
        self.find = regex.compile(pattern).findall
        self.spaces_meet = regex.compile(r"\s ").search
        top = max(self.encoder.bytes_of, default=-1)
        self.bytes_of = [self.encoder.bytes_of.get(i, b"") for i in range(top + 1)]
        self.pieces = Memo(self._piece, MEMO_PIECES)
        self.after_space = Memo(self._after_space, MEMO_WORDS)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encoder.encode(piece.encode())).tobytes()

    def _after_space(self, word: str) -> bytes:
        """A word that is one piece with its space is remembered here alone."""
        found = self.find(" " + word)
        return self._piece(found[0]) if len(found) == 1 else self._packed(found)

    def pack(self, text: str) -> bytes:
        return self._packed(self.find(text))

    def _packed(self, found: list[str]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] if len(p) <= LONGEST_REMEMBERED else self._piece(p) for p in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.spaces_meet(text):
            return self.pack(text)
        first, *others = text.split(" ")
        after = self.after_space
        if others and len(max(others, key=len)) > LONGEST_REMEMBERED:
            packed = [after[w] if len(w) <= LONGEST_REMEMBERED else after.compute(w) for w in others]
        else:
            packed = [after[w] for w in others]
        return b"".join([self.pack(first), *packed])

    def decode(self, ids) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids])


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every row of docs (doc_id, text), with its text if asked."""
    return _run(docs, path, pattern, whole=True, keep_text=keep_text)


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, digested where the ids are made."""
    return _run(docs, path, pattern, whole=False)


def _run(docs: DataFrame, path: str | None, pattern: str | None, whole: bool, keep_text: bool = False) -> DataFrame:
    path = path or public_tokenizers.path(DEFAULT_RANKS)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    pattern = pattern or public_tokenizers.PATTERN

    def make():
        codec = kept_in_worker(("byte_bpe", path, pattern), lambda: Codec(ranks.value, pattern))

        def work(rows: list[tuple]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "text": [], "ids": [], "decoded": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for doc_id, text in rows:
                raw = codec.encode(text or "")
                ids = array("I", raw)
                decoded = codec.decode(ids)
                out["doc_id"].append(doc_id)
                if whole:
                    out["text"].append(text or "")
                    out["ids"].append(ids.tolist())
                    out["decoded"].append(decoded)
                else:
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            return out

        return work

    columns = ("text string, " if keep_text else "") + "ids array<int>, decoded binary" if whole else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(kept, make, f"doc_id bigint, {columns}")
