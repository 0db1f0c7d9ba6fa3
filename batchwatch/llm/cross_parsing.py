"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded amount of labelled text.  A text is cut greedily into the
longest phrases that occur in that text; a phrase costs log2 of the labelled text's length, so the cost per
symbol estimates the cross entropy.  The language with the lowest cost wins.  Of every sampled text of a language an
equal share of symbols, from a place that depends on the text, goes into its automaton.

Symbols are lower-case letters; a run of anything else is one blank.  Texts are parsed ``SEGMENT`` symbols
at a time, all segments of a batch side by side, so a very long text takes no longer steps than a short one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import held_out, sample_per_class

#: bounds of the labelled sample: texts per language, and symbols of them all that go into the automaton
TRAIN_TEXTS, TRAIN_SYMBOLS = 200, 30_000
SEGMENT = 1024
#: segments parsed side by side
LANES = 4096
UNKNOWN = "und"
#: a phrase has to span this many symbols on average, else no language is accepted by ``known_language``
LEAST_PHRASE = 2.0

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """True for code points that are letters."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def symbols(text: str, letter: np.ndarray) -> np.ndarray:
    """Code points with each run of non-letters as one 0, none at either end."""
    points = np.where(letter[(p := code_points(text))], p, 0)
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    points = points[keep]
    return points[:-1] if len(points) and points[-1] == 0 else points


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all factors of ``sequence``; state 0 is the start."""
    go, link, length = [{}], [-1], [0]
    last = 0
    for c in sequence:
        current = len(go)
        go.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = current
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(go)
                go.append(dict(go[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return go


def share_of_text(sequence: np.ndarray, most: int, at: int) -> np.ndarray:
    """At most ``most`` symbols of a sequence from a place that ``at`` (any whole number) picks."""
    spare = len(sequence) - most
    return sequence if spare <= 0 else sequence[(start := at % (spare + 1)):start + most]


class Edges:
    """Transitions (state, symbol) -> state in one open-addressed table, whatever the size of the alphabet."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int32)
        place, left = self._places(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]  # of several that want a place one stays
            settled = self.keys[place[left]] == keys[left]
            self.to[place[left[settled]]] = to[left[settled]]
            left = left[~settled]
            place[left] = (place[left] + 1) & self.mask

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is such a transition, where it leads)."""
        place = self._places(keys)
        held = self.keys.take(place)
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            place[other] = (place[other] + 1) & self.mask
            held[other] = again = self.keys[place[other]]
            other = other[(again != keys[other]) & (again >= 0)]
        return held == keys, self.to.take(place)


class Model:
    """Automata of all languages in one table of transitions.

    Where a phrase cannot go on it ends before the symbol and the next one begins with it; a symbol that a language
    never shows is a phrase of its own, after which the last state of the language waits.  Of each text the same
    number of symbols goes into the automaton of its language.
    """

    def __init__(self, texts: dict[str, list[str]]):
        letter = _letters()
        self.languages, kept = [], []
        for language in sorted(texts):
            parts = [p for t in texts[language] if len(p := symbols(t, letter))]
            most = TRAIN_SYMBOLS // max(1, len(parts))
            shares = [share_of_text(p, most, zlib.crc32(p.tobytes())) for p in parts]
            if shares:
                self.languages.append(language)
                kept.append(np.concatenate([x for p in shares for x in (p, np.zeros(1, p.dtype))])[:-1])
        alphabet = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint32)
        alphabet = alphabet[alphabet != 0]
        self.width = len(alphabet) + 2  # 0 blank, 1 unseen anywhere, then the alphabet
        self.alphabet = alphabet
        self.starts, self.bits, self.fresh = [], [], []
        keys, to, base = [], [], 0
        for sequence in kept:
            coded = np.where(sequence == 0, 0, np.searchsorted(alphabet, sequence) + 2)
            go = suffix_automaton(coded.tolist())
            waiting = base + len(go)
            fresh = np.full(self.width, waiting, np.int32)
            for c, state in go[0].items():
                fresh[c] = base + state
            keys += [(base + state) * self.width + c for state, edges in enumerate(go) for c in edges]
            to += [base + state for edges in go for state in edges.values()]
            self.fresh.append(fresh)
            self.starts.append(base)
            self.bits.append(np.log2(max(2, len(sequence))))
            base = waiting + 1
        self.edges = Edges(np.array(keys, np.int64), np.array(to, np.int64))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text)."""
        letter = _letters()
        code = np.ones(0x110000, np.uint8 if self.width < 256 else np.uint16)
        code[0] = 0
        code[self.alphabet] = np.arange(2, self.width)
        pieces, owner = [], []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            coded = code[symbols(text, letter)]
            sizes[i] = len(coded)
            for at in range(0, len(coded), SEGMENT):
                pieces.append(coded[at:at + SEGMENT])
                owner.append(i)
        counts = np.zeros((len(texts), len(self.languages)))
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        for at in range(0, len(order), LANES):
            lanes = order[at:at + LANES]
            counted = self._parse([pieces[k] for k in lanes])
            np.add.at(counts, np.array([owner[k] for k in lanes]), counted)
        return counts, sizes

    def _parse(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases per piece and language; pieces come longest first."""
        lengths = np.array([len(p) for p in pieces])
        grid = np.zeros((lengths[0], len(pieces)), np.int32)
        for k, piece in enumerate(pieces):
            grid[:len(piece), k] = piece
        alive = len(pieces) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        out = np.empty((len(pieces), len(self.languages)))
        for k, (start, fresh) in enumerate(zip(self.starts, self.fresh)):
            state = np.full(len(pieces), start, np.int64)
            ended = np.zeros(len(pieces), np.int32)
            for t, n in enumerate(alive):
                symbol = grid[t, :n]
                goes_on, to = self.edges.find(state[:n] * self.width + symbol)
                if t:  # nothing ends before the first symbol
                    ended[:n] += ~goes_on
                state[:n] = np.where(goes_on, to, fresh.take(symbol))
            out[:, k] = ended + 1
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """language, score and mean phrase length of the best language."""
        texts = [t or "" for t in texts]
        counts, sizes = self.phrases(texts) if self.languages else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
        if not self.languages:
            return pd.DataFrame({"language": [UNKNOWN] * len(texts), "score": 0.0, "phrase": 0.0})
        cost = counts * np.array(self.bits)
        best = cost.argmin(axis=1)
        at = np.arange(len(texts))
        ordered = np.sort(cost, axis=1)
        second = ordered[:, 1] if cost.shape[1] > 1 else ordered[:, 0] * 2
        some = sizes > 0
        least = np.where(some, ordered[:, 0], 1)
        score = np.where(some, second / (second + least + (second + least == 0)), 0.0)
        return pd.DataFrame({
            "language": [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)],
            "score": score, "phrase": np.where(some, sizes / np.maximum(counts[at, best], 1), 0.0)})


def fit(docs: DataFrame, labelled: DataFrame) -> Model:
    """A model of the languages in ``labelled`` (doc_id, label); texts come from ``docs`` (doc_id, text)."""
    texts: dict[str, list[str]] = {}
    for language, _, text in sample_per_class(labelled, docs, TRAIN_TEXTS):
        texts.setdefault(language, []).append(text)
    return Model(texts)


def with_language(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: language, score (0.5 a tie, towards 1 clear), phrase.

    ``und`` with score 0 where the text is null or has no letter.  Equal costs go to the first
    language by name.  Without any labelled text everything is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double, phrase double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return docs.withColumn(name, run(F.col(text)))


def training_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows one may learn from."""
    return docs.where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("lang").alias("label"))


def known_language(docs: DataFrame) -> DataFrame:
    """Rows whose text parses as one of the languages it was given labels for; all columns stay.

    Rejected: texts without a letter, and texts no language explains, i.e. whose phrases in the best
    language are shorter than ``LEAST_PHRASE`` symbols on average (texts of fewer symbols are kept).
    """
    model = fit(docs.select("doc_id", "text"), training_labels(docs))
    name = "_language"
    while name in docs.columns:
        name += "_"
    told = with_language(docs, model, name=name)
    return told.where(f"{name}.language <> '{UNKNOWN}' AND "
                      f"({name}.phrase >= {LEAST_PHRASE} OR char_length(text) < {2 * LEAST_PHRASE})").drop(name)
