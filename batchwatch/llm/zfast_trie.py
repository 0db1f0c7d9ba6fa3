"""Prefix trie of conversations as a z-fast trie.

A conversation is a sequence of turns; the hash of its first d turns is chained, so equal hashes are equal prefixes.
The trie is compacted: its nodes are the root, the places where conversations part and the places where one
ends.  A node is stored under the hash at its handle, the two-fattest depth between its parent's depth and its own, so
a conversation finds the edge on which it leaves the trie by a fat binary search over its own prefix hashes.

Insertion goes in batches.  A bounded random batch of each large group of sequences becomes a trie that is broadcast;
all others find their exits in it, which split its edges, and form new groups by exit and next turn.  Groups that
are small enough are finished by one task each.  Every sequence ends up with the depths of the nodes on its path;
counts go from there up by ordinary aggregation, and the member with the smallest id expands the edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from ..storage import materialise

#: turns taken from the first conversation of a hundred: fewer than this many
HEADS = 6
#: sequences of a batch; sequences and turns of a group that one task finishes
BATCH, GROUP, GROUP_TURNS = 4_000, 2_000, 200_000
#: hashed parts of the children of one node
PARTS = 16
ROOT = bytes(16)


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    low = (a ^ b).bit_length() - 1
    return b >> low << low


class Prefixes:
    """Chained hashes of one sequence, 16 bytes a turn."""

    __slots__ = ("data", "turns")

    def __init__(self, data: bytes):
        self.data, self.turns = data, len(data) // 16

    def at(self, depth: int) -> bytes:
        return self.data[16 * depth - 16:16 * depth] if depth else ROOT


class ZFastTrie:
    """Compacted trie of sequences that agree in their first ``top`` turns."""

    def __init__(self, top: int = 0):
        self.depth, self.parent, self.of = [top], [-1], [Prefixes(b"")]
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}  # by the hash one turn below the parent

    def _enter(self, node: int) -> None:
        above, of = self.depth[self.parent[node]], self.of[node]
        self.handles[of.at(fattest(above, self.depth[node]))] = node
        self.first[of.at(above + 1)] = node

    def _add(self, depth: int, parent: int, of: Prefixes) -> int:
        self.depth.append(depth), self.parent.append(parent), self.of.append(of)
        self._enter(len(self.depth) - 1)
        return len(self.depth) - 1

    def _agree(self, node: int, of: Prefixes, low: int) -> int:
        """The greatest depth of the node's edge at which both prefixes are equal; they are at ``low``."""
        own, high = self.of[node], min(self.depth[node], of.turns)
        while low < high:
            middle = (low + high + 1) // 2
            if own.at(middle) == of.at(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def locate(self, of: Prefixes) -> tuple[int, int]:
        """(node, depth): the sequence leaves the trie at this depth, on the edge that ends in the node."""
        node, a, b = 0, self.depth[0], of.turns
        while a < b:
            f = fattest(a, b)
            found = self.handles.get(of.at(f))
            if found is None:
                b = f - 1
                continue
            end = self.depth[found]
            if end > of.turns or self.of[found].at(end) != of.at(end):
                return found, self._agree(found, of, f)
            node, a = found, end
        below = self.first.get(of.at(a + 1)) if a < of.turns else None
        return (node, a) if below is None else (below, self._agree(below, of, a + 1))

    def split(self, node: int, depth: int) -> int:
        """The node at ``depth`` on the way to ``node``, made where there is none."""
        while node and depth <= self.depth[self.parent[node]]:
            node = self.parent[node]
        if depth == self.depth[node]:
            return node
        above, of = self.parent[node], self.of[node]
        del self.handles[of.at(fattest(self.depth[above], self.depth[node]))]
        middle = self._add(depth, above, of)
        self.parent[node] = middle
        self._enter(node)
        return middle

    def insert(self, of: Prefixes) -> None:
        node, depth = self.locate(of)
        node = self.split(node, depth)
        if depth < of.turns:
            self._add(of.turns, node, of)

    def path(self, node: int) -> list[int]:
        """Depths of the nodes from below the root to ``node``."""
        out = []
        while node:
            out.append(self.depth[node])
            node = self.parent[node]
        return out[::-1]


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, token, chars) of every rebuilt conversation, with a row of depth 0 for each.

    ``turns`` (conv_id, turn, role, text).  A conversation c takes the first crc32(c) % 6 turns of conversation
    c - c % 100 and goes on with its own turns after as many.  Turns are numbered in value ranges, so a long
    conversation is not one task; equal turn numbers go by role and by a digest of role and text.
    """
    light = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).selectExpr("conv_id", "turn", "role", "unhex(md5(concat(octet_length(role), ':', role, text))) AS token",
                 "char_length(text) AS chars", "monotonically_increasing_id() AS row_no")
    order = ["turn", "role", "token", "row_no"]
    dealt = materialise(light.repartitionByRange("conv_id", *order).withColumn("slice", F.spark_partition_id()), "turns")
    placed = materialise(positions(dealt, ["conv_id"], order, F.col("slice")).selectExpr(
        "conv_id", "position - 1 AS pos", "token", "chars"), "placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.selectExpr("conv_id", "conv_id - conv_id % 100 AS base",
                             f"crc32(cast(cast(conv_id AS string) AS binary)) % {HEADS} AS h")
    convs = convs.join(sizes.selectExpr("conv_id AS base", "size"), "base", "left").selectExpr(
        "conv_id", "base", "h", "least(h, coalesce(size, 0L)) AS taken")
    own = placed.join(convs, "conv_id").where("pos >= h").selectExpr(
        "conv_id", "pos - h + taken + 1 AS depth", "token", "chars")
    heads = placed.where(f"conv_id % 100 = 0 AND pos < {HEADS}").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("pos < h").selectExpr("conv_id", "pos + 1 AS depth", "token", "chars")
    begin = convs.selectExpr("conv_id", "0L AS depth", "cast(NULL AS binary) AS token", "0 AS chars")
    return own.unionByName(heads).unionByName(begin)


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation from its turns in order; the running hash is carried through batches."""
    columns = ["conv_id", "seq", "turns", "hashes", "chars"]
    open_id, hashes, chars = None, [], []

    def row() -> tuple:
        return open_id, hashes[-1] if hashes else ROOT, len(hashes), b"".join(hashes), np.array(chars, "<i4").tobytes()

    for batch in batches:
        rows = []
        for conv, depth, token, n in zip(batch["conv_id"], batch["depth"], batch["token"], batch["chars"]):
            if depth == 0:
                if open_id is not None:
                    rows.append(row())
                open_id, hashes, chars = conv, [], []
            else:
                hashes.append(xxhash.xxh3_128_digest((hashes[-1] if hashes else ROOT) + bytes(token)))
                chars.append(n)
        yield pd.DataFrame(rows, columns=columns)
    if open_id is not None:
        yield pd.DataFrame([row()], columns=columns)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each sequence, from rows ordered by sequence and id; only its state is held."""
    open_seq, digest = None, None
    for batch in batches:
        rows = []
        for seq, conv in zip(batch["seq"], batch["conv_id"]):
            if seq == open_seq:
                digest.update(b",%d" % conv)
                continue
            if open_seq is not None:
                rows.append((open_seq, digest.hexdigest()))
            open_seq, digest = seq, hashlib.sha256(b"%d" % conv)
        yield pd.DataFrame(rows, columns=["seq", "ends_sha256"])
    if open_seq is not None:
        yield pd.DataFrame([(open_seq, digest.hexdigest())], columns=["seq", "ends_sha256"])


_STATE = "seq binary, n long, first long, turns int, hashes binary, chars binary, key binary, top int, path array<int>"
_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def _exits(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for key, hashes in zip(batch["key"], batch["hashes"]):
                trie = shared.value[bytes(key)]
                node, depth = trie.locate(Prefixes(hashes))
                if depth < trie.depth[node]:
                    rows.add((bytes(key), node, depth))
            yield pd.DataFrame(list(rows), columns=["key", "node", "depth"])

    return run


def _descend(shared):
    """Path of each sequence down to its exit, and the group that it goes on in; no key where it ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch[_COLUMNS].itertuples(index=False):
                trie, of = shared.value[bytes(r.key)], Prefixes(r.hashes)
                node, depth = trie.locate(of)
                on = of.at(depth + 1) if depth < of.turns else None
                rows.append((*r[:6], on, depth, [*r.path, *trie.path(node)]))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tries of whole groups, from rows ordered by group."""
    held: list = []

    def done() -> pd.DataFrame:
        trie = ZFastTrie(held[0].top)
        for r in held:
            trie.insert(Prefixes(r.hashes))
        rows = [(*r[:6], None, r.top, [*r.path, *trie.path(trie.locate(Prefixes(r.hashes))[0])]) for r in held]
        return pd.DataFrame(rows, columns=_COLUMNS)

    for batch in batches:
        out = []
        for r in batch[_COLUMNS].itertuples(index=False):
            if held and held[0].key != r.key:
                out.append(done())
                held = []
            held.append(r)
        if out:
            yield pd.concat(out)
    if held:
        yield done()


def with_paths(sequences: DataFrame, batch: int = BATCH, group: int = GROUP, turns: int = GROUP_TURNS) -> DataFrame:
    """``sequences`` (seq, n, first, turns, hashes, chars) with ``path``: the depths of the trie's nodes on its way.

    Group sizes come from counts, and only batches of ``batch`` sequences reach the driver.
    """
    spark = sequences.sparkSession
    waiting = sequences.selectExpr("*", "cast('' AS binary) AS key", "0 AS top", "array(0) AS path").select(*_COLUMNS)
    done = []
    while True:
        sizes = waiting.groupBy("key").agg(F.count("*").alias("_n"), F.sum("turns").alias("_t"))
        large = sizes.where(f"_n > {group} OR (_n > 1 AND _t > {turns})").select("key")
        chosen = waiting.join(large, "key", "left_semi").orderBy(F.xxhash64("seq"), "seq").limit(batch).collect()
        if not chosen:
            break
        tries: dict[bytes, ZFastTrie] = {}
        for r in chosen:
            tries.setdefault(bytes(r.key), ZFastTrie(r.top)).insert(Prefixes(bytes(r.hashes)))
        keys = spark.createDataFrame([(bytearray(k),) for k in tries], "key binary")
        active = waiting.join(F.broadcast(keys), "key", "left_semi")
        # exits are places on the edges of the batch, so there are no more of them than it has turns
        exits = active.select("key", "hashes").mapInPandas(
            _exits(spark.sparkContext.broadcast(tries)), "key binary, node int, depth int").distinct().collect()
        for r in exits:
            tries[bytes(r.key)].split(r.node, r.depth)
        moved = materialise(active.mapInPandas(_descend(spark.sparkContext.broadcast(tries)), _STATE), "descended")
        done.append(moved.where("key IS NULL"))
        waiting = materialise(waiting.join(F.broadcast(keys), "key", "left_anti").select(*_COLUMNS).unionByName(
            moved.where("key IS NOT NULL")), "waiting")
    found = waiting.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_finish, _STATE)
    for part in done:
        found = found.unionByName(part)
    return found.drop("key", "top")


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for n, first, hashes, path in zip(batch["n"], batch["first"], batch["hashes"], batch["path"]):
            of, above = Prefixes(hashes), -1
            for depth in path:
                rows.append((of.at(depth), depth, of.at(above) if above >= 0 else None, above, n, first))
                above = depth
        yield pd.DataFrame(rows, columns=["node", "depth", "parent", "above", "n", "first"])


def _sums(chars: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(chars, "<i4"), dtype=np.int64)])


def _upward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the edges owned by a sequence add to the nodes above them, and its leaf."""
    for batch in batches:
        rows = []
        for hashes, chars, path, owned in zip(batch["hashes"], batch["chars"], batch["path"], batch["owned"]):
            of, read, below, leaves = Prefixes(hashes), _sums(chars), 0, 0
            edges = {o["depth"]: o for o in owned}
            for depth in list(path)[::-1]:
                o = edges.get(depth)
                leaves += o is not None and o["children"] == 0
                rows.append((of.at(depth), below, leaves))
                if o is not None:
                    below += (o["convs"] - 1) * int(read[depth] - read[max(o["above"], 0)])
        yield pd.DataFrame(rows, columns=["node", "below", "leaves"])


_RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")
_NOTHING = hashlib.sha256(b"").hexdigest()


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as one row per depth."""
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    for batch in batches:
        rows = []
        for first, chars, owned in zip(batch["first"], batch["chars"], batch["owned"]):
            read = _sums(chars)
            for o in owned:
                end = o["depth"]
                for depth in range(end, o["above"], -1):
                    saved = o["below"] + (o["convs"] - 1) * int(read[end] - read[max(depth - 1, 0)])
                    parent = first if depth > o["above"] + 1 else o["parent_conv"]
                    rows.append((first, depth, parent if depth else None, o["convs"],
                                 1 if depth < end else o["children"], o["leaves"], saved,
                                 (depth == end and o["ends"]) or _NOTHING))
            if len(rows) > 100_000:
                yield pd.DataFrame(rows, columns=columns).astype({"parent_conv_id": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=columns).astype({"parent_conv_id": "Int64"})


def prefix_trie(turns: DataFrame, batch: int = BATCH, group: int = GROUP) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (code points saved by sharing the subtree's turns) and ends_sha256 of the ids that end here.

    ``turns`` (conv_id, turn, role, text); rows without conv_id belong to no conversation, null roles and texts
    are empty, null turns come first.  A repeated row is another turn.  No rows, no node.  Other columns are
    not read.  A task holds 16 bytes a turn of one sequence at a time, and of a whole group of ``group`` sequences.
    """
    # stored first: above a union whose parts are partitioned alike Spark takes the repartitioning for redundant, and
    # then changes the parts' partitions one by one
    ordered = materialise(rebuilt(turns), "rebuilt").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    chained = materialise(ordered.mapInPandas(
        _chained, "conv_id long, seq binary, turns int, hashes binary, chars binary"), "chained")
    sequences = materialise(chained.groupBy("seq").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("turns").alias("turns"),
        F.first("hashes").alias("hashes"), F.first("chars").alias("chars")), "sequences")
    ends = materialise(chained.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInPandas(
        _ends, "seq binary, ends_sha256 string"), "ends")
    found = materialise(with_paths(sequences, batch, group), "paths")

    nodes = materialise(found.select("n", "first", "hashes", "path").mapInPandas(
        _nodes, "node binary, depth int, parent binary, above int, n long, first long").groupBy(
        "node", "depth", "parent", "above").agg(F.sum("n").alias("convs"), F.min("first").alias("owner")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    nodes = materialise(nodes.join(children, "node", "left").fillna(0, ["children"]), "nodes")
    # a node can have very many children, so parents are repeated for hashed parts of them
    above = nodes.where("children > 0").select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv"),
                                               F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    nodes = nodes.withColumn("part", F.expr(f"cast(pmod(xxhash64(node), {PARTS}) AS int)")).join(
        above, ["parent", "part"], "left").drop("part")

    def owned(of: DataFrame, *columns: str) -> DataFrame:
        """Nodes by owner; an owner has no more of them than its path."""
        return of.groupBy(F.col("owner").alias("first")).agg(F.collect_list(F.struct(*columns)).alias("owned"))

    lifted = found.join(owned(nodes, "depth", "above", "convs", "children"), "first").select(
        "hashes", "chars", "path", "owned").mapInPandas(_upward, "node binary, below long, leaves long")
    sums = lifted.groupBy("node").agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    whole = nodes.join(sums, "node").join(
        ends.select(F.col("seq").alias("node"), F.col("ends_sha256").alias("ends")), "node", "left")
    stats = owned(whole, "depth", "above", "convs", "children", "parent_conv", "below", "leaves", "ends")
    return found.join(stats, "first").select("first", "chars", "owned").mapInPandas(_expanded, _RESULT)


def oracle() -> str:
    """DuckDB SQL for ``prefix_trie`` over the conversations."""
    return f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
    md5(strlen(role) || ':' || role || text)) - 1 AS pos FROM src),
crc AS (SELECT conv_id, conv_id - conv_id % 100 AS base, size, 0 AS digit, 4294967295 AS c
    FROM (SELECT conv_id, count(*) AS size FROM src GROUP BY ALL)
  UNION ALL SELECT conv_id, base, size, digit + 1,
    xor(c >> 8, t[xor(c & 255, ascii(substr(conv_id::VARCHAR, digit + 1, 1))) + 1])
  FROM crc, tab WHERE digit < length(conv_id::VARCHAR)),
conv AS (SELECT conv_id, base, size, xor(c, 4294967295) % {HEADS} AS h FROM crc WHERE digit = length(conv_id::VARCHAR)),
took AS (SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.size, 0)) AS taken
  FROM conv AS a LEFT JOIN conv AS b ON b.conv_id = a.base),
reb AS (SELECT conv_id, pos - h + taken + 1 AS depth, role, text FROM num JOIN took USING (conv_id) WHERE pos >= h
  UNION ALL SELECT took.conv_id, pos + 1, role, text FROM took JOIN num ON num.conv_id = took.base WHERE pos < h),
pre AS (SELECT conv_id, depth, length(text) AS chars, string_agg(md5(strlen(role) || ':' || role || text), '')
    OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM reb
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
last AS (SELECT conv_id, max(depth) AS turns FROM pre GROUP BY ALL),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns) AS ends
  FROM pre JOIN last USING (conv_id) GROUP BY k, depth),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
under AS (SELECT p.k, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM whole JOIN pre AS p ON p.conv_id = whole.conv_id AND p.depth <= whole.depth GROUP BY p.k)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, u.n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM whole AS a JOIN under AS u ON u.k = a.k
LEFT JOIN node AS b ON a.depth > 0 AND b.k = left(a.k, length(a.k) - 32)"""
