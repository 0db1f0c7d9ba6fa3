"""Near-duplicate classes by HyperMinHash sketches, confirmed on full shingle sets.

A sketch has ``REGISTERS`` buckets.  The top bits of a shingle's hash choose the bucket; of the smallest
remaining value the bucket keeps the number of leading zeros and ``MANTISSA`` further bits, 16 bits in
all.  Empty buckets copy a filled one chosen by a fixed permutation.  Four registers make a band; texts
that share a band are candidates.

Rows with equal shingle sets are one class from the start, so copies never form pairs.  Within a bucket
one leader is compared with the rest: by size, by the sketches' estimate, then on the full sets.  Links make
components.  What is left are pairs of different components that share a bucket; texts that cannot have
another link are ruled out by their shingles, the rest is compared block by block.  No bucket is capped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .words import mix, shingle_set

REGISTERS = 128
MANTISSA = 10
BAND = 4
#: a block of a family has at most about this many nodes, and shingles
BLOCK_NODES, BLOCK_SHINGLES = 512, 4_000_000
_VALUE_BITS = 64 - 7

_PROBES = np.argsort(np.random.default_rng(88).random((REGISTERS, REGISTERS)), axis=1)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
#: ids of at most this many rows are sent to the tasks that read the texts; more are joined by a shuffle
BROADCAST_ROWS = 200_000


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a sorted, distinct, non-empty set of 64-bit hashes."""
    at = np.searchsorted(shingles, _BOUNDS)
    end = np.append(at[1:], len(shingles))
    filled = at < end
    value = (shingles[np.minimum(at, len(shingles) - 1)] << np.uint64(7)) >> np.uint64(7)
    # the float's exponent gives the leading zeros, its first fraction bits the mantissa
    bits = np.maximum(value, np.uint64(1)).astype(np.float64).view(np.int64) >> (52 - MANTISSA)
    zeros = (1023 + _VALUE_BITS) - (bits >> MANTISSA)
    registers = ((zeros << MANTISSA) | (bits & ((1 << MANTISSA) - 1))).astype("<u2")
    if not filled.all():
        source = _PROBES[np.arange(REGISTERS), filled[_PROBES].argmax(axis=1)]
        registers = np.where(filled, registers, registers[source])
    return registers


@lru_cache(maxsize=100_000)
def _collisions(log_a: int, log_b: int) -> float:
    """Chance that a register agrees for disjoint sets of 2^(log/4) elements each."""
    a, b = 2.0 ** (log_a / 4) / REGISTERS, 2.0 ** (log_b / 4) / REGISTERS
    level = 2.0 ** -np.arange(0, _VALUE_BITS)
    within = np.exp(-(a + b) * level / 2) - np.exp(-(a + b) * level)
    return float((level / 2 ** (MANTISSA + 1) * a * b / (a + b) * within).sum())


def estimate(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> float:
    """Jaccard similarity from two sketches, less the collisions expected of unrelated sets."""
    agree = float((x == y).mean())
    by_chance = _collisions(round(4 * np.log2(n_x)), round(4 * np.log2(n_y)))
    return max(0.0, (agree - by_chance) / (1 - by_chance))


def _sketched(width: int):
    kind = "n_shingles long, digest binary, registers binary"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            shingles = shingle_set(text, width)
            if len(shingles) == 0:
                out.append((0, None, None))
                continue
            registers = sketch(shingles)
            digest = np.array([mix(shingles * np.uint64(3)).sum(), mix(shingles + np.uint64(5)).sum()])
            out.append((len(shingles), digest.tobytes(), registers.tobytes()))
        return pd.DataFrame(out, columns=["n_shingles", "digest", "registers"])

    return run


def _plausible(percent: int):
    """Whether the estimate leaves room for a link: six standard errors below the threshold."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series, n_x: pd.Series, n_y: pd.Series) -> pd.Series:
        share = percent / 100
        out = []
        for a, b, m, n in zip(x, y, n_x, n_y):
            independent = REGISTERS * (1 - np.exp(-max(m, n) / REGISTERS))
            margin = 6 * np.sqrt(max(share * (1 - share), 0.02) / independent)
            got = estimate(np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2"), m, n)
            out.append(got >= share - margin)
        return pd.Series(out, dtype=bool)

    return run


def _linked(width: int, percent: int):
    """100 * intersection >= percent * union on the full sets."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, a = [], None, None
        for text, other in zip(x, y):
            if a is None or text != last:  # rows arrive sorted by leader
                last, a = text, shingle_set(text, width)
            b = shingle_set(other, width)
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(both) - common))
        return pd.Series(out, dtype=bool)

    return run


def _sized(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """As many tasks as ``rows`` rows need, no more than Spark would use."""
    return df.coalesce(max(24, -(-rows // per_task)))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for all nodes but the smallest ones.

    Alternates the large-star and small-star steps until every node hangs on a root; each step is a grouped
    minimum and a join, so a hub with many neighbours is aggregated before it is shuffled.
    """
    edges = materialise(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "links")
    rows = edges.count()
    while rows:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        edges = materialise(_sized(small.unionByName(least.selectExpr("u", "m AS v")).distinct(), rows, 500_000), "links")
        # done when nobody has two parents and no parent has one
        twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if twice.unionByName(edges.select("u").join(edges.selectExpr("v AS u"), "u", "left_semi")).isEmpty():
            break
    return edges.selectExpr("u AS node", "v AS component")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after new links; a node without a row is its own component."""
    of = labels.withColumnRenamed("component", "c")
    between = links
    for end in ("a", "b"):
        between = between.join(of.withColumnRenamed("node", end), end, "left").withColumn(
            end, F.coalesce("c", end)).drop("c")
    joined = components(between)
    moved = labels.join(joined.toDF("component", "to"), "component", "left").selectExpr(
        "node", "coalesce(to, component) AS component")
    return materialise(moved.unionByName(joined), "labels")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_no, text) of the rows that ``wanted`` names in its lists ``ends`` of (row_no, id, text_hash)."""
    keys = materialise(wanted.select(F.explode("ends").alias("e")).select("e.*").distinct(), "wanted")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    found = rows.withColumn("text_hash", F.xxhash64("text")).join(keys, "text_hash").where("doc_id <=> id")
    return materialise(found.select("row_no", "text").dropDuplicates(["row_no"]), "texts")


def _links_among(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame | None:
    """The pairs (a, b) that are links: by size, by estimate, then on the full sets; None if there are none."""
    sided = (pairs.join(nodes.toDF("a", "id_a", "hash_a", "n_a", "r_a"), "a")
             .join(nodes.toDF("b", "id_b", "hash_b", "n_b", "r_b"), "b")
             .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    likely = materialise(sided.where(_plausible(percent)("r_a", "r_b", "n_a", "n_b")).select(
        "a", "b", "id_a", "hash_a", "id_b", "hash_b"), "likely")
    count = likely.count()
    if not count:
        return None
    texts = _texts_of(rows, likely.selectExpr("array(" + ", ".join(
        f"struct({e} AS row_no, id_{e} AS id, hash_{e} AS text_hash)" for e in "ab") + ") AS ends"))
    both = likely.select("a", "b").join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return materialise(_sized(both, count, 2000).where(_linked(width, percent)("text_a", "text_b")).select("a", "b"), "linked")


def _unsettled(members: DataFrame) -> DataFrame:
    """Rows (bucket, node, component) of buckets with members of different components, stored."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return materialise(members.join(mixed.select("bucket"), "bucket"), "buckets")


def _remaining_links(live: DataFrame, labels: DataFrame, nodes: DataFrame, rows: DataFrame, width: int,
                     percent: int) -> DataFrame | None:
    """Links that join different components, among the pairs that share a bucket in ``live`` (bucket, node).

    Most nodes are ruled out first: a link needs more common shingles than the node has that occur in any
    other open node.  The others are dealt into families of buckets that hang together, families into
    blocks, and blocks are compared two by two, without writing out their pairs.
    """
    members = _unsettled(live.join(labels, "node", "left").selectExpr(
        "bucket", "node", "coalesce(component, node) AS component"))
    if members.isEmpty():
        return None
    known = nodes.select(F.col("row_no").alias("node"), "doc_id", "text_hash", "n_shingles", "registers")
    sized = members.join(known.select("node", "n_shingles"), "node")
    least = sized.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    ends = sized.join(least, "bucket").groupBy("node").agg(
        F.min("least").alias("least"), F.first("component").alias("component"))
    texts = _texts_of(rows, ends.join(known, "node").selectExpr(
        "array(struct(node AS row_no, doc_id AS id, text_hash)) AS ends"))

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in texts])

    sets = materialise(texts.select(F.col("row_no").alias("node"), shingles("text").alias("shingles")), "sets")
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    viable = materialise(ends.join(known, "node").join(alone, "node", "left").where(
        f"{100 + percent} * (n_shingles - coalesce(alone, 0)) >= "
        f"{percent} * (n_shingles + greatest(least, {percent} * n_shingles / 100))").select(
        "node", "component", "n_shingles", "registers"), "viable")
    members = _unsettled(members.join(viable.select("node"), "node"))
    if members.isEmpty():
        return None
    hang = members.groupBy("bucket").agg(F.min("component").alias("first"))
    families = components(members.join(hang, "bucket").selectExpr("first AS a", "component AS b"))
    within = viable.join(members.select("node").distinct(), "node").join(
        families.toDF("component", "to"), "component", "left").withColumn("family", F.coalesce("to", "component")).drop("to")
    sizes = within.groupBy("family").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = within.join(sizes, "family").join(sets, "node").withColumn(
        "block", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = dealt.selectExpr(
        "family", "least(block, other) AS x", "greatest(block, other) AS y", "block", "node", "component", "registers",
        "shingles").groupBy("family", "x", "y")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_between(group, key[1], key[2], percent), columns=["a", "b"], dtype="int64")

    found = materialise(grouped.applyInPandas(compare, "a long, b long"), "linked")
    return None if found.isEmpty() else found


def links_between(group: pd.DataFrame, x: int, y: int, percent: int) -> list[tuple[int, int]]:
    """Enough links to join all components that have one between the blocks ``x`` and ``y`` of ``group``.

    ``group`` has node, block, component, registers and shingles; only pairs that share a band and are of
    different components are looked at, with the exact sizes of intersection and union.
    """
    group = group.sort_values("node")
    block = group["block"].to_numpy()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    if not len(left) or not len(right):
        return []
    component, node = group["component"].to_numpy(), group["node"].to_numpy()
    bands = np.stack([np.frombuffer(r, "<u8") for r in group["registers"]])
    sets = [np.asarray(s) for s in group["shingles"]]
    size = np.array([len(s) for s in sets])
    share = np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1]):
        share |= bands[left, k][:, None] == bands[right, k][None]
    share &= component[left][:, None] != component[right][None]
    if not share.any():
        return []
    # columns: shingles that at least two texts have
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)[times[column] > 1]
    column = place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None] - common
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(share & (100 * common >= percent * union))):
        p, q = find(component[left[i]]), find(component[right[j]])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(node[left[i]]), int(node[right[j]])))
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_no, text_hash, n_shingles, component_id, first_of_component.

    ``row_no`` numbers rows in the order of their tasks; ``first_of_component`` marks one row of a
    component, among those with the component's id the one with the least ``row_no``.  Texts without
    words are linked with nothing: component_id is their own id.  Null ids count as the greatest, so
    a component takes the id null only if all its ids are null.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = materialise(
        rows.withColumn("s", _sketched(width)("text")).select(
            "doc_id", F.monotonically_increasing_id().alias("row_no"), F.xxhash64("text").alias("text_hash"),
            "s.*"), "sketches")
    some = sketched.where("n_shingles > 0")
    # equal sets are one class, known by its first row
    classes = materialise(some.groupBy("digest").agg(
        F.min("row_no").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    nodes = materialise(some.join(classes.select(F.col("node").alias("row_no")), "row_no", "left_semi").select(
        "row_no", "doc_id", "text_hash", "n_shingles", "registers"), "nodes")
    size = 2 * BAND  # bytes of a band
    index = nodes.select(F.col("row_no").alias("node"), "registers", F.explode(
        F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band")).selectExpr(
        "node", f"xxhash64(band, substring(registers, band * {size} + 1, {size})) AS bucket")

    # the least node of each bucket leads and is compared with all others
    lead = index.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    live = materialise(index.join(lead, "bucket").where("node <> leader"), "buckets")
    pairs = live.selectExpr("leader AS a", "node AS b").distinct()
    links = _links_among(pairs, nodes, rows, width, percent)
    none = sketched.selectExpr("row_no AS node", "row_no AS component").limit(0)
    labels = none if links is None else components(links)
    links = _remaining_links(live.select("bucket", "node"), labels, nodes, rows, width, percent)
    if links is not None:
        labels = _merged(labels, links)

    labelled = classes.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_digest = materialise(labelled.join(ids, "component").select("digest", "component", "component_id"), "components")
    out = sketched.drop("registers").join(by_digest, "digest", "left").select(
        "doc_id", "row_no", "text_hash", "n_shingles", "component",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    own = out.where("component IS NOT NULL AND doc_id <=> component_id").groupBy("component").agg(
        F.min("row_no").alias("first_row"))
    return out.join(own, "component", "left").select(
        "doc_id", "row_no", "text_hash", "n_shingles", "component_id",
        F.expr("component IS NULL OR row_no = first_row").alias("first_of_component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the least id, and the rows without words; all columns stay.

    Rows that agree in id and text count as one row.
    """
    found = near_duplicates(docs, width=width, percent=percent)
    keys = materialise(found.groupBy("doc_id", "text_hash").agg(
        F.max("first_of_component").alias("keep"), F.count("*").alias("n")), "keys")
    repeated = keys.where("keep AND n > 1")
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.struct(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b")))
    once = keyed.join(_hinted(keys.where("NOT keep OR n > 1"), name), name, "left_anti").drop(name)
    if repeated.isEmpty():
        return once
    again = keyed.join(_hinted(repeated, name), name, "left_semi").dropDuplicates([name]).drop(name)
    return once.unionByName(again)


def _hinted(keys: DataFrame, name: str) -> DataFrame:
    """Keys as one column, with a broadcast hint where they are few."""
    few = keys.count() <= BROADCAST_ROWS
    keys = keys.select(F.struct(F.col("doc_id").alias("a"), F.col("text_hash").alias("b")).alias(name))
    return F.broadcast(keys) if few else keys
