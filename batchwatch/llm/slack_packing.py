"""Packing of token pieces into sequences by minimum bin slack.

For one bin after the other, a subset-sum over the lengths that are left, held as a bitset, finds the
fullest combination around the longest piece; it is taken out and the next bin begins.  Only the number of
pieces of each length matters, at most one count per possible length, so the driver plans on the counts: the
same combination is repeated as often as the counts allow.  The plan is a list of (length, first rank, ...)
ranges whose size depends on the sequence length alone.  Every piece then finds its place by its rank among
the pieces of its length, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .ranks import numbered
from .tokens import codec, default_vocabulary

SEQUENCE, END = 1024, 2
_PIECES = "row_no long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def fullest(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length whose sum is the largest that fits into ``room``; larger lengths are preferred."""
    lengths = {n: c for n, c in lengths.items() if c and n <= room}
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted(lengths, reverse=True):
        left = min(lengths[n], room // n)
        part = 1
        while left:  # 1, 2, 4, ... copies and the rest reach every number of copies
            take = min(part, left)
            grown = (reach | reach << (n * take)) & mask
            if grown != reach:
                steps.append((n, take, reach))
                reach = grown
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + take
            at -= n * take
    return chosen


def plan(counts: dict[int, int], room: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first bin, copies per bin, offset in the bin) of all pieces."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    out, first_bin = [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = fullest(rest, room - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            out.append((n, used[n], used[n] + c * times, first_bin, c, offset))
            used[n] += c * times
            offset += n * c
            left[n] -= c * times
            if not left[n]:
                del left[n]
        first_bin += times
    return out


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None,
           sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces (row_no, doc_id, piece, start, length, ids_crc32, ids) of at most ``sequence`` ids.

    A document is the ids of its text (null: empty) and ``end``.  Longer ones are cut so that all pieces
    but the first are full.  ``row_no`` tells rows with equal ids apart; ``ids`` is null unless asked for.
    Other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = codec(path, added=True)[0]
        for batch in batches:
            out = []
            for row_no, key, body in zip(batch["row_no"], batch["doc_id"], batch["text"]):
                ids = np.append(np.array(encode(body or ""), "<u4"), np.uint32(end))
                first = (len(ids) - 1) % sequence + 1
                bounds = [0, *range(first, len(ids) + 1, sequence)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[a:b]
                    out.append((row_no, key, k, a, b - a, zlib.crc32(part.tobytes()),
                                part.astype(np.int32) if with_ids else None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"),
                       F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, _PIECES)


def pack(rows: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``rows`` (row_no, piece, length, ...) with sequence_id and offset, gapless from 0 in each sequence."""
    stored = materialise(rows, "pieces")
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = sorted(plan(counts, sequence))
    width = max(counts.values(), default=0) + 1
    table = np.array(ranges, np.int64).reshape(-1, 6)
    start = table[:, 0] * width + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(start, length.to_numpy() * width + rank.to_numpy(), side="right") - 1
        row = table[at]
        nth = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 4],
                             "offset": row[:, 5] + nth % row[:, 4] * length.to_numpy()})

    ranked = numbered(stored, "length", ["row_no", "piece"], "rank", counts)
    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(*[c for c in stored.columns], "place.sequence_id", "place.offset")
