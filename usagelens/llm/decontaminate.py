"""Operator 8: benchmark decontamination with a generalised suffix automaton.

The automaton is built from the words of all test items. A document's words are
streamed through it: after each word the automaton knows the longest suffix
read so far that occurs in some item. Where that length reaches a window of 10
words (or a whole shorter item), the window's words are hit.

An automaton holds about WORDS_A_PASS words of items, as flat arrays that are
broadcast. A larger benchmark takes several passes, between which the rows and
what was found in them are written to the shared folder; the result is the same.

Cases: a null or wordless text has no words, no hits and no items; an item
without words is left out; equal items all count; an empty benchmark leaves all
documents clean; an empty document table gives no rows; other columns are
ignored, or kept by clean. Items and documents of any length are read whole;
rows that repeat are read each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import cut, free_name, kept_in_worker, map_texts

# Fixed value: what a word is, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
WINDOW = 10
#: Words of items in one automaton; longer items are split into pieces that overlap by a window less one word.
WORDS_A_PASS = 400_000


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(LOWER)) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences.

    follow[s] maps a word to the next state, length[s] is the longest sequence
    of state s, link[s] its longest proper suffix in another state.
    """

    def __init__(self, sequences: list[list[int]]):
        self.follow: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state reached from parent by word, split off if it also stands for longer sequences."""
        target = self.follow[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._state(self.length[parent] + 1, dict(self.follow[target]), self.link[target])
        self.link[target] = copy
        while parent >= 0 and self.follow[parent].get(word) == target:
            self.follow[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.follow[last]:  # an earlier item has this sequence
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.follow[at]:
            self.follow[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new


class Flat:
    """An automaton over some pieces of items as arrays, with the windows that end in each state.

    first_word and first_target hold one way on from each state, more_* those of
    states with several; owners lists the items of each window of each size.
    """

    def __init__(self, pieces: list[tuple[str, list[str]]], window: int):
        ids: dict[str, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words] for _, words in pieces]
        self.vocabulary = list(ids)
        built = SuffixAutomaton(sequences)
        self.length, self.link = np.array(built.length, dtype=np.int32), np.array(built.link, dtype=np.int32)
        self.first_word, self.first_target = np.full(len(self.length), -1, np.int32), np.full(len(self.length), -1, np.int32)
        more = []
        for state, follow in enumerate(built.follow):
            for k, (word, target) in enumerate(follow.items()):
                if k:
                    more.append((state << 32 | word, target))
                else:
                    self.first_word[state], self.first_target[state] = word, target
        self.more = np.array(more, dtype=np.int64).reshape(-1, 2)
        sizes = [min(window, len(seq)) for seq in sequences]
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        self.sizes = sorted(set(sizes))
        self.groups, self.owners, self.edges = {}, {}, {}
        by_length = np.argsort(self.length, kind="stable").tolist()
        for size in self.sizes:
            # The state that stands for the last `size` words of each state's sequences.
            suffix = array("i", bytes(4 * len(self.length)))
            length, link = built.length, built.link
            for state in by_length:
                if length[state] < size:
                    suffix[state] = -1
                elif length[link[state]] < size:
                    suffix[state] = state
                else:
                    suffix[state] = suffix[link[state]]
            told = set()
            for (item, _), seq, own in zip(pieces, sequences, sizes, strict=True):
                if own == size:
                    state = 0
                    for i, word in enumerate(seq):
                        state = built.follow[state][word]
                        if i + 1 >= size:
                            told.add((suffix[state], number[item]))
            pairs = np.array(sorted(told), dtype=np.int64).reshape(-1, 2)
            states, first = np.unique(pairs[:, 0], return_index=True)
            group = np.full(len(self.length) + 1, -1, dtype=np.int32)
            group[states] = np.arange(len(states))
            self.groups[size] = group[np.frombuffer(suffix, dtype=np.int32)]
            self.owners[size], self.edges[size] = pairs[:, 1].astype(np.int32), np.append(first, len(pairs)).astype(np.int32)


class Matcher:
    """Finds windows of items in documents; kept in a worker while it is used."""

    def __init__(self, flat: Flat):
        self.flat, self.sizes = flat, flat.sizes
        self.ids = {w: i for i, w in enumerate(flat.vocabulary)}
        told = lambda x: array("i", x.astype(np.int32).tobytes())
        self.length, self.link, self.first_word, self.first_target = told(flat.length), told(flat.link), told(flat.first_word), told(flat.first_target)
        self.more = dict(flat.more.tolist())
        self.groups = [(size, told(flat.groups[size])) for size in flat.sizes]

    def spans(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [start, end) of occurring windows, and the items they belong to."""
        if not self.sizes or len(words) < self.sizes[0]:
            return [], set()
        ids = self.ids
        codes = np.array([ids.get(w, -1) for w in words], dtype=np.int64)
        # A word outside every item leaves the automaton at its root: only runs of known words need it.
        edge = np.diff(np.concatenate([[0], (codes >= 0).astype(np.int8), [0]]))
        found: list[tuple[int, int]] = []
        met: set[tuple[int, int]] = set()
        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if end - start >= self.sizes[0]:
                self._stream(codes[start:end].tolist(), start, found, met)
        owners: set[str] = set()
        for size, group in met:
            edges = self.flat.edges[size]
            owners.update(self.flat.items[i] for i in self.flat.owners[size][edges[group] : edges[group + 1]])
        return found, owners

    def _stream(self, run: list[int], start: int, found: list, met: set) -> None:
        """Feed known words to the automaton; windows that end are added to found and met."""
        length, link, first_word, first_target, more = self.length, self.link, self.first_word, self.first_target, self.more
        least = self.sizes[0]
        state = size = 0
        for end, word in enumerate(run, start + 1):
            while True:
                target = first_target[state] if first_word[state] == word else more.get(state << 32 | word, -1)
                if target >= 0 or not state:
                    break
                state = link[state]
                size = length[state]
            if target >= 0:
                state = target
                size += 1
            if size >= least:
                for window, groups in self.groups:
                    if window > size:
                        break
                    if (group := groups[state]) >= 0:
                        found.append((end - window, end))
                        met.add((window, group))


def item_pieces(benchmark: DataFrame, window: int, most: int) -> Iterator[tuple[str, list[str]]]:
    """(item_id as text, words) of every item with words, long ones in pieces that hold all their windows."""
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        words = words_of(row[1])
        for at in range(0, max(1, len(words) - window + 1), most):
            if piece := words[at : at + most + window - 1]:
                yield row[0] if row[0] is not None else "", piece


def automata(benchmark: DataFrame, window: int, most: int) -> Iterator[tuple[Flat, bool]]:
    """Automata over the items, of about `most` words each, and whether it is the last; one at least."""
    held: list = []
    size = 0
    for piece in item_pieces(benchmark, window, most):
        if held and size + len(piece[1]) > most + window:
            yield Flat(held, window), False
            held, size = [], 0
        held.append(piece)
        size += len(piece[1])
    yield Flat(held, window), True


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges)."""
    return _run(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, remove=False)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hit: int = 50, most_share: float = 0.5) -> DataFrame:
    """docs without hit passages: their words go, with what stands between them.

    A document with over most_hit hit words covering more than most_share of
    its words goes whole. Untouched documents keep their text as it is.
    """
    return _run(docs, benchmark, window, True, most_hit, most_share)


def _run(docs, benchmark, window, remove, most_hit=0, most_share=1.0) -> DataFrame:
    names = docs.columns
    carried = [free_name("found_spans", names), free_name("found_items", names)]
    kinds = dict(docs.dtypes)
    kept = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    rows, first = docs, True
    for flat, last in automata(benchmark, window, WORDS_A_PASS):
        told = docs.sparkSession.sparkContext.broadcast(flat)
        if not last:
            rows = cut(map_texts(rows, _pass(told, names, carried, first), f"{kept}, `{carried[0]}` array<array<bigint>>, `{carried[1]}` array<string>"))
            told.unpersist()
        first = first and last
    if remove:
        return map_texts(rows, _pass(told, names, carried, first, _removing(names, most_hit, most_share)), kept)
    schema = f"doc_id {kinds['doc_id']}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<array<bigint>>"
    return map_texts(rows, _pass(told, names, carried, first, _digest(names)), schema)


def _pass(told, names: list[str], carried: list[str], first: bool, finish=None):
    """What one automaton finds in rows, added to what earlier ones found; the last pass turns it into the result."""
    text_at = names.index("text")
    key = ("decontaminate", uuid.uuid4().hex)

    def make():
        matcher = kept_in_worker(key, lambda: Matcher(told.value))

        def work(rows: list[tuple]) -> dict[str, list]:
            out: dict[str, list] = {}
            for row in rows:
                words = words_of(row[text_at])
                spans, owners = matcher.spans(words)
                if not first:
                    spans, owners = [*spans, *row[len(names)]], owners | set(row[len(names) + 1])
                mask = np.zeros(len(words) + 1, dtype=np.int32)
                for a, b in spans:
                    mask[a] += 1
                    mask[b] -= 1
                hit = np.cumsum(mask)[:-1] > 0
                if finish:
                    one = finish(row, words, hit, owners)
                else:
                    one = dict(zip(names, row)) | {carried[0]: [list(s) for s in merged_spans(hit)], carried[1]: sorted(owners)}
                for name, value in (one or {}).items():
                    out.setdefault(name, []).append(value)
            return out

        return work

    return make


def _digest(names: list[str]):
    at = names.index("doc_id")

    def finish(row, words, hit, owners):
        n_hit = int(hit.sum())
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        return {"doc_id": row[at], "n_words": len(words), "n_hit": n_hit, "n_items": len(owners), "items_sha256": digest,
                "contaminated": n_hit > 0, "spans": [list(s) for s in merged_spans(hit)]}

    return finish


def _removing(names: list[str], most_hit: int, most_share: float):
    at = names.index("text")

    def finish(row, words, hit, owners):
        n_hit = int(hit.sum())
        if n_hit > most_hit and n_hit > most_share * len(words):
            return None
        return dict(zip(names, row)) | ({"text": without(row[at], hit)} if n_hit else {})

    return finish


def merged_spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def without(text: str, hit: np.ndarray) -> str:
    """The text without the passages of hit words."""
    places = [m.span() for m in re.finditer(WORD, text.translate(LOWER))]
    kept, at = [], 0
    for a, b in merged_spans(hit):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])
