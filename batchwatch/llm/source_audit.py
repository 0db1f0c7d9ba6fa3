"""How the sources of a language differ in their words: a recount by minimal perfect hashes.

The first pass counts, exactly, in how many documents of a language each term stands and keeps the frequent
ones.  The kept terms are dealt into shards, and each shard becomes a minimal perfect hash that stores its terms.
Shards of at most ``ROUND_BYTES`` are broadcast at a time; the second pass looks terms up, compares them with the
stored ones and increments dense slots per group.  Shares and divergences are whole numbers throughout and are
computed for blocks of slots, with all groups of a language side by side.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .perfect_hash import PerfectHash
from .words import utf8

LEAST_DOCUMENTS, TOP = 3, 200
#: parts of a whole that shares are counted in
WHOLE = 1_000_000_000
#: terms of a shard; bytes of shards that are broadcast at once; counts that a task holds before it hands them on
SHARD_TERMS, ROUND_BYTES, HELD = 100_000, 128_000_000, 400_000
#: counts of a block of slots that meet in one task
BLOCK_COUNTS = 400_000

#: bytes outside terms become blanks, A-Z become a-z
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case."""
    return utf8(text).translate(_TERM_BYTES).split()


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(WHOLE * (counts + 1) / total), in Python's whole numbers where 64 bits do not suffice."""
    if counts.max(initial=0) >= (2**63 - 1) // WHOLE - 1:
        counts, total = counts.astype(object), np.asarray(total, object)
    return (1 + WHOLE * (counts + 1) // total).astype(np.int64)


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most WHOLE + 1, so 64 bits suffice."""
    apart = p - q
    return apart * apart // q


def _in_frames(columns: list[str], rows: list[tuple]) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[at:at + 100_000], columns=columns)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms that stand in at least ``least`` documents of their language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pd.DataFrame]:
            yield from _in_frames(["lang", "term", "n"], [(g, t, n) for g, c in held.items() for t, n in c.items()])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held[lang].update(set(terms(text)))
                if len(held[lang]) > HELD:
                    yield from flush()
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    counted = docs.select("lang", "text").mapInPandas(run, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def shards_of(kept: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(lang, part, n, hash): the kept terms of each language in perfect hashes of about ``SHARD_TERMS`` terms."""
    parts = kept.sparkSession.createDataFrame(
        [(lang, -(-n // SHARD_TERMS)) for lang, n in vocabulary.items()], "lang string, parts long")
    dealt = kept.join(F.broadcast(parts), "lang").withColumn("part", F.expr("pmod(crc32(term), parts)"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash([bytes(t) for t in rows["term"]])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "part": rows["part"].iloc[:1], "n": len(made),
                             "hash": [pickle.dumps(made)]})

    return dealt.select("lang", "part", "term").groupBy("lang", "part").applyInPandas(
        build, "lang string, part long, n long, hash binary")


class Shards:
    """Some shards of each language, with the number of the first slot of each."""

    def __init__(self, parts: dict[str, int]):
        self.parts = parts
        self.held: dict[str, dict[int, tuple[int, PerfectHash]]] = defaultdict(dict)

    def add(self, lang: str, part: int, base: int, made: PerfectHash) -> None:
        self.held[lang][part] = base, made

    def slots(self, lang: str, found: list[bytes]) -> np.ndarray:
        """Slots within the language; -1 for terms that are not kept or in no shard held here."""
        out = np.full(len(found), -1, np.int64)
        if lang not in self.held:
            return out
        part = np.fromiter((zlib.crc32(t) for t in found), np.int64, len(found)) % self.parts[lang]
        for k, (base, made) in self.held[lang].items():
            at = np.flatnonzero(part == k)
            slot = made.slots([found[i] for i in at.tolist()])
            out[at[slot >= 0]] = slot[slot >= 0] + base
        return out


def _recount(shared, number: dict[tuple[str, str], int], size: dict[str, int]) -> Callable:
    """Task that yields (gid, slot, n) of the terms in the broadcast shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

        def flush() -> Iterator[pd.DataFrame]:
            for lang, groups in held.items():
                found = list(set().union(*groups.values()))
                slot_of = dict(zip(found, shared.value.slots(lang, found).tolist()))
                dense = np.zeros(size.get(lang, 0) + 1, np.int64)  # the last one takes what is not kept
                for source, counts in groups.items():
                    dense[np.fromiter(map(slot_of.__getitem__, counts), np.int64, len(counts))] += np.fromiter(
                        counts.values(), np.int64, len(counts))
                    dense[-1] = 0
                    slot = np.flatnonzero(dense)
                    yield pd.DataFrame({"gid": np.int32(number[lang, source]), "slot": slot, "n": dense[slot]})
                    dense[slot] = 0
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                held[lang][source].update(terms(text))
                if len(held[lang][source]) > HELD:
                    yield from flush()
            if sum(len(c) for groups in held.values() for c in groups.values()) > HELD:
                yield from flush()
        yield from flush()

    return run


def _compare(sources: dict[int, list[int]], sums: dict[int, int], vocabulary: dict[int, int], top: int) -> Callable:
    """Task for one block of slots: sums per pair of groups, and the first terms of each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lid = int(rows["lid"].iloc[0])
        groups, size = sources[lid], vocabulary[lid]
        named, counted = rows[rows["gid"] < 0].sort_values("slot"), rows[rows["gid"] >= 0]
        slots, words = named["slot"].to_numpy(), [bytes(t) for t in named["term"]]
        n = np.zeros((len(groups), len(slots)), np.int64)
        n[np.searchsorted(groups, counted["gid"]), np.searchsorted(slots, counted["slot"])] = counted["n"]
        totals = [sums[g] for g in groups]
        p = shares(n, np.array([t + size for t in totals])[:, None])
        q = shares(n.sum(axis=0), sum(totals) + size)
        out = []
        for k, g in enumerate(groups):
            each = gain(p[k], p).sum(axis=1).tolist()
            out += [(g, other, None, v) for other, v in zip(groups, each) if other != g]
            ahead = np.flatnonzero((n[k] > 0) & (p[k] > q))
            value = gain(p[k, ahead], q[ahead])
            if len(ahead) > top:
                least = np.partition(value, -top)[-top]
                ahead, value = ahead[value >= least], value[value >= least]
            best = sorted(zip((-value).tolist(), [words[i] for i in ahead.tolist()]))[:top]
            out += [(g, -1, word, -v) for v, word in best]
        return pd.DataFrame(out, columns=["gid", "other", "term", "value"])

    return run


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, with the divergence from it summed over all kept terms.
    Part ``term``: the ``top`` kept terms that the source uses more than its language does.  Ranks run from the
    largest value down; equal values go by item in UTF-8 order.

    Null text, language and source are empty.  Groups without terms count like any other; without kept terms all
    values of pairs are 0.  A repeated row counts again.  No rows, no result.  Other columns are not read.  Groups
    (language and source) are numbered on the driver: the result has a row for every pair of them.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in (
        (lang, "lang"), (source, "source"), (text, "text"))])
    groups = sorted((r.lang, r.source) for r in rows.select("lang", "source").distinct().collect())
    number = {g: k for k, g in enumerate(groups)}
    langs = sorted({g[0] for g in groups})
    lid = {name: k for k, name in enumerate(langs)}

    kept = materialise(kept_terms(rows, least), "terms")
    vocabulary = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shards = materialise(shards_of(kept, vocabulary), "shards")

    # slots are numbered through the shards of a language
    listed = sorted(tuple(r) for r in shards.select("lang", "part", "n", F.octet_length("hash")).collect())
    base, rounds, size, full = {}, [[]], dict.fromkeys(langs, 0), 0
    for name, part, n, stored in listed:
        base[name, part] = size[name]
        size[name] += n
        if full and full + stored > ROUND_BYTES:
            rounds.append([])
            full = 0
        rounds[-1].append((name, part))
        full += stored
    parts = {name: -(-n // SHARD_TERMS) for name, n in vocabulary.items()}

    counts = None
    for chosen in rounds:
        wanted = spark.createDataFrame(chosen, "lang string, part long") if chosen else None
        held = Shards(parts)
        for r in shards.join(F.broadcast(wanted), ["lang", "part"]).toLocalIterator() if chosen else ():
            held.add(r.lang, r.part, base[r.lang, r.part], pickle.loads(r.hash))
        part = rows.mapInPandas(_recount(spark.sparkContext.broadcast(held), number, size),
                                "gid int, slot long, n long")
        counts = part if counts is None else counts.unionByName(part)
    counts = materialise(counts.groupBy("gid", "slot").agg(F.sum("n").alias("n")), "counts")
    sums = dict.fromkeys(range(len(groups)), 0)
    sums |= {r.gid: r.n for r in counts.groupBy("gid").agg(F.sum("n").alias("n")).collect()}

    def slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part, made in zip(batch["lang"], batch["part"], map(pickle.loads, batch["hash"])):
                first = base[name, part]
                yield pd.DataFrame({"gid": -1, "lid": lid[name], "slot": np.arange(first, first + len(made)), "n": 0,
                                    "term": [made.term(s) for s in range(len(made))]})

    sources = defaultdict(list)
    for g, k in number.items():
        sources[lid[g[0]]].append(k)
    width = {k: max(1, BLOCK_COUNTS // (len(of) + 1)) for k, of in sources.items()}
    named = spark.createDataFrame([(k, *g, lid[g[0]], width[lid[g[0]]]) for g, k in number.items()],
                                  "gid int, lang string, source string, lid int, width int")
    widths = named.select("lid", "width").distinct()
    cells = counts.join(F.broadcast(named.select("gid", "lid")), "gid").select("gid", "lid", "slot", "n")
    cells = cells.withColumn("term", F.lit(None).cast("binary")).unionByName(
        shards.mapInPandas(slotted, "gid int, lid int, slot long, n long, term binary"))
    cells = cells.join(F.broadcast(widths), "lid").withColumn("block", F.expr("slot div width")).drop("width")
    compared = materialise(cells.groupBy("lid", "block").applyInPandas(
        _compare(dict(sources), sums, {lid[k]: v for k, v in vocabulary.items()}, top),
        "gid int, other int, term binary, value long"), "compared")

    of = named.select("gid", "lang", "source")
    to = named.select(F.col("gid").alias("other"), "lang", F.col("source").alias("item"))
    summed = compared.where("other >= 0").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    pairs = of.join(to, "lang").where("gid <> other").join(summed, ["gid", "other"], "left").selectExpr(
        "lang", "source", "'pair' AS part", "item", "coalesce(value, 0L) AS value")
    ahead = compared.where("other < 0").join(F.broadcast(of), "gid").selectExpr(
        "lang", "source", "'term' AS part", "cast(term AS string) AS item", "value")
    ranked = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"
    return pairs.withColumn("rank", F.expr(ranked)).unionByName(
        ahead.withColumn("rank", F.expr(ranked)).where(F.col("rank") <= top))


def oracle(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """DuckDB SQL for ``audit_sources`` over the documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"CAST(1 + ({WHOLE}::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS BIGINT)"
    f = "((p - q)::HUGEINT * (p - q)) // q"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share} AS p
  FROM kept JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {share} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)
  JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY ALL) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p)::HUGEINT * (a.p - b.p)) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST({f} AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM u)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
