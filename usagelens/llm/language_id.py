"""Operator 2: language identification with segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability,
fitted by expectation maximisation on word counts. A word's probability is the
sum over all its segmentations into pieces (forward algorithm); a text's is the
product over its words. Pieces never reach over a word's ends, so words are
scored once and remembered.

Cases: a null text and a text without a letter are `und` with score 0; so are
all texts when no language was learned; of equally likely languages the first
in alphabetical order is taken; an empty table gives no rows; rows that repeat
are scored each; texts of any length are learned and scored whole; other columns
are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import bucket_of_id, kept_in_worker, map_texts
from usagelens.llm.fitting import class_share

DEFAULT_PIECES = "piece_bpe_32k.model"
#: Documents a language that the probabilities are fitted on, about.
FIT_DOCUMENTS = 500
#: Word types a language, and of all languages, that are kept of those documents, the most frequent first.
FIT_WORDS, ALL_FIT_WORDS = 60_000, 3_000_000
ROUNDS = 4
#: Longer runs of letters are scored in blocks of this many, so probabilities stay in range.
BLOCK = 24
#: Probability of a letter that no piece covers, and pseudo-count of each piece.
UNSEEN = 1e-7
PSEUDO_COUNT = 0.05
#: Texts of fewer letters than this have no rarity.
FEW_LETTERS = 40
MEMO_WORDS = 400_000
SLICE_BYTES = 3 << 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in blocks. Signs for numbers that are no digits stand in words, but make none."""
    found = [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if found and len(max(found, key=len)) > BLOCK:
        found = [w[i : i + BLOCK] for w in found for i in range(0, len(w), BLOCK)]
    return found


class Segmenter:
    """All occurrences of vocabulary pieces in words, and sums over segmentations.

    Words stand behind each other in one text, each after its start mark and
    before a separator; `place` counts positions in that text.
    """

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, len(piece) << 32 | i)
        self.automaton.make_automaton()
        self.size = len(pieces)

    def lattice(self, words: list[str]):
        """(end, start, piece, end within the word) of every occurrence by that end, then each word's first and last place.

        A letter without a piece of its own gets the piece number `size`.
        """
        joined = "▁" + "\n▁".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        first = np.cumsum(lengths + 1) - lengths - 1
        told = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        end, length, piece = told[:, 0] + 1, told[:, 1] >> 32, told[:, 1] & 0xFFFFFFFF
        bare = np.zeros(len(joined) + 1, dtype=bool)
        within = np.arange(len(joined) + 1) - np.repeat(first, lengths + 1)[: len(joined) + 1]
        bare[1:] = within[1:] > 0
        bare[end[length == 1]] = False
        more = np.flatnonzero(bare)
        end = np.concatenate([end, more])
        start = end - np.concatenate([length, np.ones(len(more), dtype=np.int64)])
        piece = np.concatenate([piece, np.full(len(more), self.size)])
        order = np.argsort(within[end], kind="stable")
        return end[order], start[order], piece[order], within[end][order], first, first + lengths

    def forward(self, lattice, probabilities) -> np.ndarray:
        """alpha[place, language]: summed probability of all segmentations of a word up to a place.

        probabilities has a row a piece and one for letters without a piece.
        """
        end, start, piece, within, first, last = lattice
        alpha = np.zeros((int(last[-1]) + 1, probabilities.shape[1]))
        alpha[first] = 1
        for a, b in _runs(within):
            np.add.at(alpha, end[a:b], alpha[start[a:b]] * probabilities[piece[a:b]])
        return alpha

    def expected(self, lattice, probabilities, counts) -> np.ndarray:
        """Expected uses of each piece over all segmentations of words with counts, for one language."""
        end, start, piece, within, first, last = lattice
        alpha = self.forward(lattice, probabilities[:, None])[:, 0]
        beta = np.zeros_like(alpha)
        beta[last] = counts / alpha[last]
        for a, b in reversed(_runs(within)):
            np.add.at(beta, start[a:b], beta[end[a:b]] * probabilities[piece[a:b]])
        return np.bincount(piece, weights=alpha[start] * probabilities[piece] * beta[end], minlength=self.size + 1)


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edge = np.flatnonzero(np.diff(key)) + 1
    bounds = [0, *edge.tolist(), len(key)]
    return list(zip(bounds[:-1], bounds[1:], strict=True)) if len(key) else []


def vocabulary(path: str | None = None) -> list[str]:
    """The ordinary pieces of a public vocabulary, lower case only, since words are lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(DEFAULT_PIECES))
    found = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in found if p == p.lower()]


class Model:
    """Pieces, languages, probabilities (pieces x languages) and usual: the log-probability a letter of each language's own words."""

    def __init__(self, pieces: list[str], languages: list[str], probabilities: np.ndarray, usual: list[float] = ()):
        self.pieces, self.languages, self.probabilities, self.usual = pieces, languages, probabilities, list(usual)


def fit(docs: DataFrame, pieces_path: str | None = None, per_language: int = FIT_DOCUMENTS) -> Model:
    """Piece probabilities of each language from rows with doc_id, text and lang (null: not used)."""
    spark = docs.sparkSession
    pieces = vocabulary(pieces_path)
    chosen, counts = class_share(docs.select("doc_id", "text", "lang"), "lang", per_language, "language")
    languages = sorted(counts)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))

    def make():
        def work(rows):
            out = {"lang": [], "word": []}
            for lang, text in rows:
                found = words_of(text)
                out["lang"] += [lang] * len(found)
                out["word"] += found
            return out

        return work

    typed = map_texts(chosen.where("text is not null").select("lang", "text"), make, "lang string, word string").groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    typed = typed.withColumn("rank", rank).where(F.col("rank") <= max(1, min(FIT_WORDS, ALL_FIT_WORDS // len(languages)))).collect()
    by_language: dict = {language: [] for language in languages}
    for r in typed:
        by_language[r["lang"]].append(r)
    segmenter = Segmenter(pieces)
    size = len(pieces)
    probabilities, usual = np.empty((size + 1, len(languages))), []
    for k, language in enumerate(languages):
        own = [(c, w) for _, c, w in sorted((r["rank"], r["count"], r["word"]) for r in by_language[language])]
        lattice = segmenter.lattice([w for _, w in own]) if own else None
        weight = np.array([c for c, _ in own], dtype=float)
        p = np.full(size + 1, 1.0 / size)
        p[size] = UNSEEN
        for _ in range(ROUNDS if own else 0):
            uses = segmenter.expected(lattice, p, weight)[:size] + PSEUDO_COUNT
            p[:size] = uses / uses.sum()
        probabilities[:, k] = p
        if own:
            letters = weight @ np.array([len(w) for _, w in own])
            usual.append(float(weight @ np.log(segmenter.forward(lattice, p[:, None])[lattice[-1], 0]) / letters))
        else:
            usual.append(-np.inf)
    return Model(pieces, languages, probabilities, usual)


class Scorer:
    """Log-probabilities of texts; words are remembered as rows of a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.segmenter = Segmenter(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def _scores(self, chunks: list[str]) -> np.ndarray:
        """How many letters each chunk has, and its words' log-probability in each language."""
        parts = [words_of(c) for c in chunks]
        words = list(chain.from_iterable(parts))
        out = np.zeros((len(chunks), len(self.model.languages) + 1))
        if words:
            lattice = self.segmenter.lattice(words)
            told = np.log(self.segmenter.forward(lattice, self.model.probabilities)[lattice[-1]])
            owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
            letters = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
            np.add.at(out, owner, np.concatenate([letters[:, None], told], axis=1))
        return out

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """Rows of the table for distinct chunks, after learning what is new."""
        if len(self.row) + len(chunks) > MEMO_WORDS:
            self._forget()
        new = [c for c in chunks if c not in self.row]
        added = [self.table]
        for at in range(0, len(new), 16384):
            added.append(self._scores(new[at : at + 16384]))
        self.row.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate(added)
        return np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language and score of each text, and how usual its letters are there (1: as in its own words, more: rarer)."""
        # Whatever is not a letter ends a word, so the commonest signs may become spaces.
        lowered = [(t or "").lower().replace(". ", " ").replace(", ", " ") for t in texts]
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = split.values.dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())
        per_word = self.table[row][coded.indices.to_numpy()]
        edge = split.offsets.to_numpy()
        totals = np.zeros((len(texts), self.table.shape[1]))
        filled = np.flatnonzero(np.diff(edge) > 0)
        if len(filled):
            totals[filled] = np.add.reduceat(per_word, edge[filled], axis=0)
        langs, scores, rarity = [], [], []
        for total in totals:
            if not total[0] or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
                rarity.append(0.0)
                continue
            likely = total[1:]
            best = int(np.argmax(likely))
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(likely - likely[best]).sum()))
            rarity.append(float(likely[best] / total[0] / self.model.usual[best]) if total[0] >= FEW_LETTERS else 0.0)
        return langs, scores, rarity


def predict(docs: DataFrame, model: Model, columns: tuple[str, str, str] = ("lang_pred", "score", "rarity")) -> DataFrame:
    """docs (all columns) with the predicted language, its score and rarity; columns of these names are replaced.

    The score compares languages, so it is near 1 for any longer text. Rarity tells
    how far a text is from the language: its log-probability a letter over the usual
    one; 0 for texts of few letters.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n.lower() not in [c.lower() for c in columns]]
    at = names.index("text")
    key = ("language_id", hash(model.probabilities.tobytes()), len(model.pieces))

    def make():
        scorer = kept_in_worker(key, lambda: Scorer(told.value))

        def work(rows):
            out = {n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
            out[columns[0]], out[columns[1]], out[columns[2]] = scorer.predict([r[at] for r in rows])
            return out

        return work

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return map_texts(docs.select(*(F.col(f"`{n}`") for n in names)), make, f"{schema}, `{columns[0]}` string, `{columns[1]}` double, `{columns[2]}` double", SLICE_BYTES)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((bucket_of_id(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, learned from its own labelled rows."""
    model = model or fit(training_rows(docs))
    held_out = (bucket_of_id(F.col("doc_id"), 3) == 1).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")
