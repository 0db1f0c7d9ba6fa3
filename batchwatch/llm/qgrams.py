"""Benchmark decontamination by the q-gram lemma.

Texts are compared as normalised UTF-8: lower case, every run of characters other than letters and digits
one blank.  Benchmark items are cut into overlapping segments.  An occurrence of a segment of m bytes with at
most k edits shares at least m + 1 - Q * (k + 1) q-grams with the segment, all within k + 1 neighbouring
diagonals.  Shared q-grams are counted in diagonal bands that overlap so far that some band holds all of
them; bands that reach the bound are verified by an alignment restricted to the band.  The filter loses
nothing: every occurrence within the edit budget is found, anywhere in the text.  Items too short for a budget are
searched for as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import utf8

Q = 8
#: bytes of a segment and between the starts of neighbouring segments; edits per byte
SEGMENT, STRIDE, BUDGET = 160, 80, 0.05
#: items of fewer normalised bytes have to stand as they are, between word boundaries
LEAST_ITEM = 24
#: from here on lie scripts that write words without blanks, whose letters bound a word on either side
_UNSPACED = "\u0e00"
#: benchmark bytes searched for in one pass over the documents
BLOCK_BYTES = 4_000_000
_TABLE_BITS = 21
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
#: ASCII other than letters and digits becomes a blank; other characters are letters unless listed
_ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_OTHER = re.compile(r"[^\w\x00-\x7f]+")


def normalise(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return b" ".join(utf8(text.lower()).translate(_ASCII).split())


def grams(data: bytes) -> np.ndarray:
    """The Q bytes at each place as one 64-bit value."""
    n = max(0, len(data) - Q + 1)
    out = np.empty(n, np.uint64)
    for at in range(min(Q, n)):
        part = out[at::Q]
        part[:] = np.frombuffer(data, "<u8", len(part), at)
    return out


def _slots(values: np.ndarray) -> np.ndarray:
    return (values * _SCRAMBLE) >> np.uint64(64 - _TABLE_BITS)


class Benchmark:
    """Segments of items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text = [], []
        short: dict[str, list[int]] = {}
        for item_id, body in items:
            data = normalise(body)
            if len(data) < LEAST_ITEM:
                if data:
                    short.setdefault(data.decode("utf-8", "surrogatepass"), []).append(item_id)
                continue
            starts = [*range(0, max(1, len(data) - SEGMENT), STRIDE), max(0, len(data) - SEGMENT)]
            for at in dict.fromkeys(starts):
                self.item.append(item_id)
                self.text.append(data[at:at + SEGMENT])
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for word, of in short.items():
                self.short.add_word(word, (word, of))
            self.short.make_automaton()
        sizes = np.array([len(t) for t in self.text], np.int64)
        # a budget for which the lemma still asks for one shared q-gram
        self.edits = np.minimum((BUDGET * sizes).astype(np.int64), (sizes - Q) // Q) if len(sizes) else sizes
        self.needed = sizes + 1 - Q * (self.edits + 1)
        values = [grams(t) for t in self.text]
        counts = np.array([len(v) for v in values], np.int64)
        joined = np.concatenate(values) if values else np.empty(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.values, first, self.size = np.unique(joined[order], return_index=True, return_counts=True)
        self.first = first
        self.segment = np.repeat(np.arange(len(counts)), counts)[order]
        self.place = (np.arange(len(joined)) - np.repeat(np.cumsum(counts) - counts, counts))[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[_slots(self.values)] = True
        # for the look over whole texts: the longest reach and weakest bound of segments of similar size
        similar = (sizes // 16).tolist()
        self.stretches = [(int((sizes + self.edits)[of].max()), int(self.needed[of].min()))
                          for of in ([k == g for k in similar] for g in sorted(set(similar)))]

    def dense(self, found: np.ndarray) -> np.ndarray:
        """Keep marks that lie in a stretch with as many marks as a segment of some size needs."""
        n = len(found)
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int32)])
        inside = np.zeros(n + 1, np.int32)
        for reach, needed in self.stretches:
            whole = max(0, n - reach)
            begin = np.flatnonzero(total[reach:reach + whole] - total[:whole] >= needed)
            if total[n] - total[whole] >= needed:
                begin = np.append(begin, whole)
            if len(begin):
                np.add.at(inside, begin, 1)
                np.add.at(inside, np.minimum(begin + reach, n), -1)
        return found & (np.cumsum(inside[:-1]) > 0) if inside.any() else np.zeros(n, bool)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) in the normalised text; one per segment and stretch of the text."""
        data = normalise(text)
        values = grams(data)
        if not len(values) or not len(self.values):
            return []
        at = np.flatnonzero(self.dense(self.maybe[_slots(values)]))
        if not len(at):
            return []
        slot = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
        real = self.values[slot] == values[at]
        at, slot = at[real], slot[real]
        repeats = self.size[slot]
        entry = np.repeat(self.first[slot] - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
        segment = self.segment[entry]
        diagonal = np.repeat(at, repeats) - self.place[entry] + SEGMENT  # never negative
        step = self.edits[segment] + 1
        band = diagonal // step
        key = segment * np.int64(len(data) + 2 * SEGMENT + 2)
        bands, counts = np.unique(np.concatenate([key + band, key + band - 1]), return_counts=True)
        out = []
        for k, count in zip(bands.tolist(), counts.tolist()):
            s, b = divmod(k, len(data) + 2 * SEGMENT + 2)
            if count >= self.needed[s]:
                low = b * int(self.edits[s] + 1) - SEGMENT
                found = align(data, self.text[s], low, 2 * int(self.edits[s]) + 2, int(self.edits[s]))
                if found:
                    out.append((s, *found))
        return _apart(out)

    def short_items(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) in the normalised text of items below ``LEAST_ITEM``, unchanged and as whole words."""
        if self.short is None:
            return
        data = normalise(text).decode("utf-8", "surrogatepass")
        for last, (word, items) in self.short.iter(data):
            start, end = last + 1 - len(word), last + 1
            if _bounded(data[start - 1:start], word[0]) and _bounded(data[end:end + 1], word[-1]):
                at = len(utf8(data[:start]))
                for item in items:
                    yield item, at, at + len(utf8(word))

    def clean(self, text: str | None) -> bool:
        return not self.matches(text) and next(self.short_items(text), None) is None

    def items_in(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, segments found, first start, last end, fewest edits) per item; an item without id comes first."""
        merged: dict[int, list[int]] = {}
        for item, start, end in self.short_items(text):
            m = merged.setdefault(item, [1, start, end, 0])
            m[2] = max(m[2], end)
        for s, start, end, edits in self.matches(text):
            m = merged.setdefault(self.item[s], [0, start, end, edits])
            m[:] = [m[0] + 1, min(m[1], start), max(m[2], end), min(m[3], edits)]
        return [(item, *m) for item, m in sorted(merged.items(), key=lambda x: (x[0] is not None, x[0] or 0))]


def _bounded(beside: str, own: str) -> bool:
    """Whether a word may end between two neighbouring characters."""
    return beside in ("", " ") or beside >= _UNSPACED or own >= _UNSPACED


def align(data: bytes, segment: bytes, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence on the diagonals low .. low + width - 1, or None above budget."""
    m = len(segment)
    at = data.find(segment, max(0, low), max(0, low) + m + width - 1 + min(0, low))
    if at >= 0:
        return at, at + m, 0
    area = np.zeros(m + width, np.uint8)
    a, b = max(0, low), min(len(data), low + m + width)
    if a >= b:
        return None
    area[a - low:b - low] = np.frombuffer(data, np.uint8, b - a, a)
    places = np.arange(width)
    far = m + width
    # a start outside the text costs as much as no match at all
    cost = np.where((places + low >= 0) & (places + low <= len(data)), 0, far)
    origin = places.copy()
    for j in range(m):
        other = cost + (area[j:j + width] != segment[j])
        skip = np.append(cost[1:] + 1, far)
        came = np.where(skip < other, np.append(origin[1:], 0), origin)
        other = np.minimum(other, skip)
        # a run of text bytes left out: the least of other[d'] + (d - d') over d' <= d
        shifted = other - places
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, places, 0))
        cost = least + places
        origin = came[source]
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    end = low + m + d
    return (low + int(origin[d]), min(end, len(data)), int(cost[d])) if cost[d] <= budget else None


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping occurrences of one segment the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for s, start, end, edits in sorted(found, key=lambda m: (m[0], m[1], m[2], m[3])):
        if out and out[-1][0] == s and start < out[-1][2]:
            if edits < out[-1][3]:
                out[-1] = (s, start, end, edits)
        else:
            out.append((s, start, end, edits))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, one after the other."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        items = {(r.item_id, r.text) for r in dealt.where(F.col("block") == k).collect()}
        yield Benchmark(sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item found in it.

    doc_id, item_id, n_segments, start and end (bytes of the normalised text), edits (of the best segment).
    Null and empty texts hold nothing; a repeated document row repeats its result rows, a repeated
    benchmark row does not.  Items of fewer than ``LEAST_ITEM`` normalised bytes count where they stand unchanged as
    whole words; an item without letters or digits is in no text.  Items without id are reported without id, together.
    Other columns are not read.
    """
    kind = "doc_id long, item_id long, n_segments int, start long, end long, edits int"
    out = None
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(key, *m) for key, body in zip(batch["doc_id"], batch["text"])
                         for m in shared.value.items_in(body)]
                frame = pd.DataFrame(found, columns=["doc_id", "item_id", "n_segments", "start", "end", "edits"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(run, kind)
        out = part if out is None else out.unionByName(part)
    return out


def _holds_nothing(shared):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.clean(t) for t in texts], dtype=bool)

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose text holds no benchmark item; all columns stay."""
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(_holds_nothing(shared)(F.col("text")))
    return docs
