"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents are linked through keys they share; a key stands for all links among its documents, so a group of
copies is never written out as pairs.  Documents start evenly spread, whatever their links.  Each round counts, per
key, the documents in each shard, and every document wishes for the shard that holds most of its neighbours.  In even
rounds all shards can be wished for; how many wishes from one shard for another come true follows from all of them
together: a full shard takes as many as it sends away, so full shards swap documents.  In odd rounds the groups
that are still apart go to the best shard that has room.  Wishes are admitted by size of the neighbourhood.

What the rounds leave apart of a group follows its majority; then shards above their quota give
up whole groups, the smaller ones first, which follow one another into the room of the others.  Documents without
links fill the rest, so that counts are at most one apart.  Besides groups larger than a quota, fewer groups are cut
than there are shards.

Everything is DataFrame functions; the driver sees a few numbers per pair of shards.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .ranks import numbered

SHARDS, ROUNDS = 8, 8
#: one part in so many of a quota may be exceeded until the end
SLACK = 16
#: neighbourhoods are admitted by power of two of their size, then in this many hashed parts
_PARTS = 1024
#: rows of a block in which the rows of a shard are numbered group by group
TOGETHER = 2_000


def _spread(values: list[int], of: str) -> str:
    """SQL for the entry of a short list at the 0-based place ``of``."""
    return f"element_at(array({', '.join(f'{v}L' for v in values)}), cast({of} AS int) + 1)"


def _loads(labels: DataFrame, shards: int) -> list[int]:
    found = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def admitted(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``wanted`` moves from shard to shard are made so that no shard gains more than its room.

    First shards swap in cycles, which changes no size; then moves go where room is, and what they leave is room again.
    """
    left, room = [list(row) for row in wanted], list(room)
    shards = range(len(room))
    flow = [[0] * len(room) for _ in shards]

    def push(path: list[int], n: int) -> None:
        for a, b in zip(path, path[1:]):
            flow[a][b] += n
            left[a][b] -= n

    def way(a: int, b: int) -> list[int] | None:
        """A shortest path over moves that are still wanted."""
        came, queue = {a: a}, [a]
        for at in queue:
            for to in shards:
                if left[at][to] > 0 and to not in came:
                    came[to] = at
                    queue.append(to)
        if b not in came:
            return None
        path = [b]
        while path[-1] != a:
            path.append(came[path[-1]])
        return path[::-1]

    for a in shards:
        for b in shards:
            while a != b and left[a][b] > 0 and (back := way(b, a)):
                cycle = [a, *back]
                push(cycle, min(left[x][y] for x, y in zip(cycle, cycle[1:])))
    moving = True
    while moving:
        moving = False
        for to in shards:
            for a in shards:
                n = min(left[a][to], room[to])
                if n > 0:
                    push([a, to], n)
                    room[to] -= n
                    room[a] += n
                    moving = True
    return flow


def _votes(links: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """Per key, the documents in each shard."""
    return links.join(labels, "node").groupBy("key").agg(
        *[F.count(F.when(F.col("label") == s, 1)).alias(f"_{s}") for s in range(shards)])


def _first(shards: Iterable[int]) -> Column:
    """(n, o, s) of the shard with the highest count; ties fall the same way for all documents of a ``hub``."""
    ranks = [F.struct(F.col(f"_{s}").alias("n"), F.xxhash64("hub", F.lit(s)).alias("o"), F.lit(s).alias("s")) for s in shards]
    return F.greatest(*ranks) if len(ranks) > 1 else ranks[0]


def cut_links(links: DataFrame, labels: DataFrame, shards: int) -> int:
    """Pairs of documents that share a key and lie in different shards."""
    n = " + ".join(f"_{s}" for s in range(shards))
    same = " + ".join(f"_{s} * _{s}" for s in range(shards))
    return _votes(links, labels, shards).agg(F.expr(f"sum((({n}) * ({n}) - ({same})) div 2)")).first()[0] or 0


def propagate(links: DataFrame, labels: DataFrame, quotas: list[int], rounds: int = ROUNDS, first: int = 0) -> DataFrame:
    """Labels (node, label) after at most ``rounds`` rounds over links (node, key).

    ``labels`` holds every linked node once.  During the rounds a shard may exceed its quota by ``SLACK``; one that is
    above does not gain.  Ties between shards are drawn anew each round, for all documents of a key alike.
    """
    shards = len(quotas)
    votes = [f"_{s}" for s in range(shards)]
    idle = 0
    for turn in range(first, first + rounds):
        room = [q + q // SLACK - n for q, n in zip(quotas, _loads(labels, shards))]
        scores = links.join(_votes(links, labels, shards), "key").groupBy("node").agg(
            *[F.sum(v).alias(v) for v in votes], F.min(F.xxhash64("key", F.lit(turn))).alias("hub"))
        apart = scores.where(f"greatest({', '.join(votes)}) < {' + '.join(votes)}")
        swap = turn % 2 == 0
        open_to = [s for s in range(shards) if swap or room[s] > 0]
        if not open_to:
            continue
        wished = apart.withColumn("best", _first(open_to)).join(labels, "node")
        moves = materialise(wished.where("best.s <> label").selectExpr(
            "node", "best.s AS to", f"{f'label * {shards} + ' if swap else ''}best.s AS pair",
            "cast(floor(log2(best.n + 1)) AS int) AS size", f"pmod(xxhash64(hub), {_PARTS}) AS part"), "moves")
        counts = {r["pair"]: r.n for r in moves.groupBy("pair").agg(F.count("*").alias("n")).collect()}
        if swap:
            flow = admitted([[counts.get(a * shards + b, 0) for b in range(shards)] for a in range(shards)], room)
            limits = [n for row in flow for n in row]
        else:
            limits = [min(counts.get(s, 0), max(0, room[s])) for s in range(shards)]
        idle = 0 if any(limits) else idle + 1
        if idle == 2:
            break
        cells = moves.groupBy("pair", "size", "part").agg(F.count("*").alias("n")).selectExpr(
            "pair", "size", "part", "n", f"{_spread(limits, 'pair')} "
            "- sum(n) OVER (PARTITION BY pair ORDER BY size DESC, part) + n AS left_for")
        ready = moves.join(cells.where("left_for > 0"), ["pair", "size", "part"])
        going = ready.where("n <= left_for").select("node", "to")
        # the first cell of a pair that does not fit sends as many rows as may still move
        partly = ready.where("n > left_for")
        waiting = {r["pair"]: r.n for r in partly.groupBy("pair").agg(F.count("*").alias("n")).collect()}
        if waiting:
            going = going.unionByName(
                numbered(partly, "pair", ["node"], "rank", waiting).where("rank < left_for").select("node", "to"))
        labels = materialise(labels.join(going, "node", "left").selectExpr(
            "node", "cast(coalesce(to, label) AS int) AS label"), "labels")
    return labels


def gathered(links: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """Labels in which all documents of a key follow their majority; ``links`` has one key per node."""
    to = _votes(links, labels, shards).withColumn("hub", F.xxhash64("key")).select("key", _first(range(shards))["s"].alias("label"))
    return links.join(to, "key").select("node", "label")


def _together(rows: DataFrame, loads: list[int], quotas: list[int]) -> DataFrame:
    """Rows (node, hub, n, label) with rank: 0, 1, 2, ... within ``label``, one group (``hub``) after the other.

    Groups of more than ``TOGETHER`` rows (``n``) or an eighth of a quota come first, the largest first, each in
    hashed blocks of its own; the others share blocks by a hash of their hub.  No task holds a whole shard or a
    large group.
    """
    large = min(TOGETHER, max(quotas) // 8)
    blocks = [max(1, -(-n // TOGETHER)) for n in loads]
    dealt = rows.selectExpr(
        "*", f"IF(n > {large}, n, 0L) AS _big",
        f"IF(n > {large}, hub, pmod(xxhash64(hub, 1), {_spread(blocks, 'label')})) AS _at",
        f"IF(n > {large}, pmod(xxhash64(node, 2), cast(ceil(n / {TOGETHER}) AS bigint)), 0L) AS _part")
    block = ["label", "_big", "_at", "_part"]
    starts = dealt.groupBy(*block).agg(F.count("*").alias("_n")).selectExpr(
        *block, "sum(_n) OVER (PARTITION BY label ORDER BY _big DESC, _at, _part) - _n AS _before")
    ranked = dealt.withColumn("_rank", F.expr(
        f"row_number() OVER (PARTITION BY {', '.join(block)} ORDER BY hub, node)"))
    return ranked.join(starts, block).selectExpr("node", "hub", "label", "_before + _rank - 1 AS rank")


def _kept(ranked: DataFrame, loads: list[int], quotas: list[int]) -> list[int]:
    """Rows each shard keeps: its quota, or less by the part of the group that the quota would cut.

    A group that is larger than the quota is cut.
    """
    keep = [min(n, q) for n, q in zip(loads, quotas)]
    full = [s for s, (n, q) in enumerate(zip(loads, quotas)) if n > q > 0]
    if not full:
        return keep
    edge = f"rank IN ({_spread(keep, 'label')} - 1, {_spread(keep, 'label')})"
    cut = ranked.where(F.col("label").isin(full)).where(edge).groupBy("label").agg(
        F.min("hub").alias("hub"), F.max("hub").alias("other")).where("hub = other").collect()
    if cut:
        whole = " OR ".join(f"label = {r.label} AND hub = {r.hub}L" for r in cut)
        for r in ranked.where(whole).groupBy("label").agg(F.min("rank").alias("first"), F.count("*").alias("n")).collect():
            if r.n <= quotas[r.label]:
                keep[r.label] = r["first"]
    return keep


def shard_rows(rows: DataFrame, key: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row_no, ...) with shard and slot; counts differ by at most one, slots are gapless from 0.

    Rows with equal non-null ``key`` are linked.  ``row_no`` has to be unique; ties are broken by hashes
    of it and of the key.
    """
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    start = rows.select(F.col("row_no").alias("node"), F.col(key).alias("key"))
    shared = start.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    linked = materialise(start.join(shared, "key").selectExpr(
        "node", "key", "n", "xxhash64(key) AS hub", f"cast(pmod(node, {shards}) AS int) AS label"), "linked")
    labels = propagate(linked.select("node", "key"), linked.select("node", "label"), quotas, rounds)
    labels = materialise(gathered(linked.select("node", "key"), labels, shards), "gathered")

    loads = _loads(labels, shards)
    ranked = materialise(_together(linked.select("node", "hub", "n").join(labels, "node"), loads, quotas), "ranked")
    stay = _kept(ranked, loads, quotas)
    kept = ranked.where(f"rank < {_spread(stay, 'label')}").selectExpr("node", "label AS shard", "rank AS slot")
    # what shards give up, group by group, then the rows without links, go where room is left
    given = [n - s for n, s in zip(loads, stay)]
    before = [sum(given[:s]) - stay[s] for s in range(shards)]
    given_up = ranked.where(f"rank >= {_spread(stay, 'label')}").selectExpr(
        "node", f"rank + {_spread(before, 'label')} AS rank")
    alone = start.join(linked.select("node"), "node", "left_anti").select("node", F.lit(0).alias("all"))
    alone = numbered(alone, "all", ["node"], "rank", {0: total - sum(loads)}).selectExpr(
        "node", f"rank + {sum(given)}L AS rank")
    room = [q - s for q, s in zip(quotas, stay)]
    order = sorted(range(shards), key=lambda s: (-room[s], s))
    ends = [sum(room[s] for s in order[:k + 1]) for k in range(shards)]
    place = "cast(0" + "".join(f" + IF(rank >= {e}L, 1, 0)" for e in ends[:-1]) + " AS int)"
    moved = given_up.unionByName(alone).selectExpr("node", "rank", f"{place} AS place").selectExpr(
        "node", f"cast({_spread(order, 'place')} AS int) AS shard",
        f"rank + {_spread([stay[s] - e + room[s] for s, e in zip(order, ends)], 'place')} AS slot")
    return rows.join(kept.unionByName(moved).withColumnRenamed("node", "row_no"), "row_no")


def shard_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; documents with equal texts are linked.

    ``size`` is the UTF-8 bytes of the text plus 1.  Null texts are empty for size and checksum and are
    linked with nothing.  The law is ``rows``, so ``grown_shard`` is null.  A repeated row is a document
    of its own.  Other columns are not read.
    """
    rows = materialise(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha1(F.col(text).cast("binary"))).alias("content")), "documents")
    placed = shard_rows(rows, "content", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
