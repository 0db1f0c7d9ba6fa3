"""Running numbers within groups of any size, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a block in which the rows of a group are numbered
BLOCK = 20_000


def numbered(rows: DataFrame, group: str, key: list[str], name: str, counts: dict[int, int]) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... within ``group``, in any order; ``key`` has to be unique.

    Groups are small whole numbers with ``counts`` rows each.  A group is cut into hashed blocks of about
    ``BLOCK`` rows, numbered one by one; a block starts where the counts of the blocks before it end.  No
    task holds a whole group.
    """
    blocks = ", ".join(str(max(1, -(-counts.get(g, 0) // BLOCK))) for g in range(max(counts, default=0) + 1))
    dealt = rows.withColumn("_block", F.expr(
        f"pmod(xxhash64({', '.join(key)}), coalesce(get(array({blocks}), cast({group} AS int)), 1))"))
    starts = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n")).selectExpr(
        group, "_block", f"sum(_n) OVER (PARTITION BY {group} ORDER BY _block) - _n AS _before")
    ranked = dealt.withColumn("_rank", F.expr(
        f"row_number() OVER (PARTITION BY {group}, _block ORDER BY {', '.join(key)})"))
    return ranked.join(starts, [group, "_block"]).withColumn(name, F.expr("_before + _rank - 1")).drop(
        "_block", "_before", "_rank")
