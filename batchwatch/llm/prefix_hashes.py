"""Document fingerprints from prefix polynomial hashes.

A text has two arrays of prefix sums of ``code point * BASE^place`` modulo a prime.  They give the hash of any span
in two look-ups, so spans of different texts are compared at once, and the longest common extension of two places
is found by binary search over span lengths.

The fingerprint of a text is its length, the hash of the whole, and the ``KEPT`` smallest hashes of the spans of up to
``SPAN`` code points that end at each place.  The likeness of two fingerprints is the share of common hashes
among the smallest ones of both, an estimate of the Jaccard similarity of the span sets (exact for texts of at
most ``KEPT`` spans).

Documents are dealt into ranges of doc_id and read in that order, so a document meets its successor without
another shuffle; only the first and last document of a range wait for those of the neighbouring ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .words import mix, sorted_distinct, utf8

PRIME = np.uint64(2**31 - 1)
#: drawn once; each with its own array
BASES = (1_302_784_723, 904_382_917)
SPAN, KEPT = 16, 64
#: bytes of text of a range of documents
RANGE_BYTES = 64_000_000
_BITS = np.uint64(31)

_powers: dict[str, list[np.ndarray]] = {"up": [], "down": []}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62 - 1."""
    x = (x & PRIME) + (x >> _BITS)
    return np.minimum(x, x - PRIME)  # the difference wraps around where x is the smaller one


def powers(kind: str, n: int) -> list[np.ndarray]:
    """BASE^0 .. BASE^(n - 1) for each base; ``down``: of the inverse bases.  Kept per process, at most doubled."""
    if not _powers[kind] or len(_powers[kind][0]) < n:
        grown = []
        for k, base in enumerate(BASES):
            step = base if kind == "up" else pow(base, -1, int(PRIME))
            table = _powers[kind][k] if _powers[kind] else np.ones(1, np.uint64)
            while len(table) < n:
                factor = np.uint64(pow(step, len(table), int(PRIME)))
                table = np.concatenate([table, _reduced(table * factor)])
            grown.append(table)
        _powers[kind] = grown
    return _powers[kind]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """Prefix sums of one text; ``span`` and ``common_extension`` need nothing else."""

    def __init__(self, points: np.ndarray, start: PrefixHashes | None = None, shared: int = 0):
        """Of the first ``shared`` code points of ``start`` followed by ``points``."""
        self.length = shared + len(points)
        up = powers("up", self.length)
        self.sums = []
        for k, table in enumerate(up):
            terms = _reduced((points.astype(np.uint64) + np.uint64(1)) * table[shared:self.length])
            sums = np.empty(self.length + 1, np.uint64)
            sums[:shared + 1] = start.sums[k][:shared + 1] if start else 0
            # fewer than 2^31 terms below 2^31 stay below 2^62
            np.cumsum(terms, out=sums[shared + 1:])
            sums[shared + 1:] = _reduced(sums[shared + 1:] + sums[shared])
            self.sums.append(sums)
        # spans that end in the shared part are the same
        fresh = self._ending(shared)
        self.ending = np.concatenate([start.ending[:shared], fresh]) if start else fresh

    def span(self, start: int, end: int) -> int:
        """62-bit hash of the code points [start, end); equal spans have equal hashes wherever they stand."""
        high, low = (
            (int(s[end]) - int(s[start])) * int(d[start]) % int(PRIME)
            for s, d in zip(self.sums, powers("down", self.length + 1)))
        return high << 31 | low

    def same(self, at: int, other: PrefixHashes, at_other: int, n: int) -> bool:
        """Whether the spans of length n at both places are equal."""
        return self.span(at, at + n) == other.span(at_other, at_other + n)

    def common_extension(self, at: int, other: PrefixHashes, at_other: int) -> int:
        """Code points that agree from both places on, by binary search over their number."""
        low, high = 0, min(self.length - at, other.length - at_other)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(at, other, at_other, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _ending(self, first: int) -> np.ndarray:
        """Mixed hashes of the spans of up to ``SPAN`` code points that end after places ``first`` and later.

        One of the two arrays is enough: what is compared are small sets.
        """
        sums, down = self.sums[0], powers("down", self.length + 1)[0]
        ends = np.arange(first + 1, self.length + 1)
        starts = np.maximum(ends - SPAN, 0)
        spans = _reduced(_reduced(sums[first + 1:] + (PRIME - sums[starts])) * down[starts])
        return mix(spans | (ends - starts).astype(np.uint64) << np.uint64(32)) >> np.uint64(32)

    def fingerprint(self) -> bytes:
        """Length and hash of the whole (8 bytes each), then the smallest span hashes (4 bytes each)."""
        few = self.ending
        if len(few) > 8 * KEPT:  # repeats can leave too few below the cut; then all are sorted
            few = few[few < np.uint64(2**32 * 4 * KEPT // len(few))]
        least = sorted_distinct(few)
        if len(least) < KEPT and len(few) < self.length:
            least = sorted_distinct(self.ending)
        head = np.array([self.length, self.span(0, self.length)], ">u8")
        return head.tobytes() + least[:KEPT].astype(">u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, else the share of common span hashes among the smallest of both."""
    if a == b:
        return 1.0
    one, two = (set(np.frombuffer(f, ">u4", offset=16).tolist()) for f in (a, b))
    both = one | two
    # beyond the largest hash of a full side nothing is known of that side
    known = min((max(s) for s in (one, two) if len(s) >= KEPT), default=2**32)
    both = [h for h in both if h <= known]
    return sum(h in one and h in two for h in both) / len(both) if both else 0.0


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
           "common_start", "common_end"]
#: digests are hexadecimal only in the result
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")
_KIND = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double, common_start long, common_end long")


class _Read:
    """A document with what its neighbours need of it."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id = None if pd.isna(doc_id) else int(doc_id)
        self.text = text or ""
        self.points = code_points(text)
        self.prefixes = PrefixHashes(self.points)
        self.fingerprint = self.prefixes.fingerprint()

    def against(self, following: _Read) -> tuple:
        """The result row."""
        n = len(self.points)
        taken = following.points[:n // 4]
        edited = PrefixHashes(taken, self.prefixes, n - n // 4)
        sha = hashlib.sha256(utf8(self.text[:n - n // 4] + following.text[:n // 4])).digest()
        fingerprint = edited.fingerprint()
        end = n - n // 4
        return (self.doc_id, n, sha, self.fingerprint, fingerprint, likeness(self.fingerprint, fingerprint),
                likeness(self.fingerprint, following.fingerprint),
                self.prefixes.common_extension(0, edited, 0), self.prefixes.common_extension(end, following.prefixes, 0))


def _frame(rows: list[tuple], place: str, part: int) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[*_RESULT, "text"]).astype({"doc_id": "Int64", "n_chars": "Int64",
                                                                  "common_start": "Int64", "common_end": "Int64"})
    return frame.assign(place=place, part=np.int32(part))


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of all documents of a range but the last; texts of the first and the last."""
    empty = (None,) * (len(_RESULT) - 1)
    last, part = None, None
    for batch in batches:
        rows = []
        for doc_id, text, of in zip(batch["doc_id"], batch["text"], batch["part"]):
            read = _Read(doc_id, text)
            if last is None:
                part = of
                yield _frame([(read.doc_id, *empty, text or "")], "first", part)
            else:
                rows.append((*last.against(read), None))
            last = read
        if rows:
            yield _frame(rows, "inner", part)
    if last is not None:
        yield _frame([(last.doc_id, *empty, last.text)], "last", part)


def _at_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_Read(doc_id, text).against(_Read(None, following))
                for doc_id, text, following in zip(batch["doc_id"], batch["text"], batch["following"])]
        if rows:
            yield pd.DataFrame(rows, columns=_RESULT).astype({"doc_id": "Int64"})


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_start, common_end.

    The edited text of a document has its last quarter (rounded down to code points) replaced by the first as
    many code points of the next document; after the last document comes the first.  ``common_start`` is the number
    of code points that text and edited text have in common from the start; ``common_end`` how far the replaced
    quarter agrees with the start of the next document.

    Null texts are empty: length 0, likeness 1 with an empty text and 0 with any other.  Documents with
    equal ids follow one another by a digest of their text; a null id comes first.  A repeated row is a document of
    its own.  A single document is its own successor.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row_no"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    # the row number parts repeated rows
    order = [F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row_no")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "doc_id", "text", F.spark_partition_id().alias("part"))
    read = materialise(dealt.mapInPandas(_in_order, f"{_KIND}, text string, place string, part int"), "fingerprints")

    # one row a range, without texts: the next range that has documents, the first one after the last
    follow = read.where("place = 'first'").select("part").withColumn("from", F.expr(
        "coalesce(lag(part) OVER (ORDER BY part), max(part) OVER ())"))
    firsts = read.where("place = 'first'").select("part", F.col("text").alias("following")).join(follow, "part")
    ends = read.where("place = 'last'").select(F.col("part").alias("from"), "doc_id", "text").join(
        firsts.select("from", "following"), "from")
    return read.where("place = 'inner'").select(*_RESULT).unionByName(
        ends.select("doc_id", "text", "following").mapInPandas(_at_ends, _KIND)).withColumns(
        {c: F.lower(F.hex(c)) for c in _BYTES})
