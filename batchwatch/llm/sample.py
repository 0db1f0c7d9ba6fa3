"""Bounded samples of labelled rows, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def sample_per_class(labelled: DataFrame, docs: DataFrame, rows: int) -> list:
    """At most ``rows`` (label, text) per label, chosen by a hash of the id, ordered by label and id.

    ``labelled`` (doc_id, label) holds ids only.  Counts per leading bits of the hash tell which ids can be
    among the first, and only those are ranked, so a frequent label is not gathered.  ``docs`` (doc_id, text)
    is read once, filtered by the chosen ids: they are at most ``rows`` times the number of labels, which is
    what makes the broadcast bounded.
    """
    ids = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").distinct().withColumn(
        "slot", F.shiftrightunsigned(F.xxhash64("doc_id"), 48))
    first = ids.groupBy("label", "slot").agg(F.count("*").alias("n")).withColumn("before", F.expr(
        "sum(n) OVER (PARTITION BY label ORDER BY slot) - n")).where(F.col("before") < rows).select("label", "slot")
    ranked = ids.join(first, ["label", "slot"]).withColumn("rank", F.expr(
        "row_number() OVER (PARTITION BY label ORDER BY slot, xxhash64(doc_id), doc_id)")).where(F.col("rank") <= rows)
    chosen = docs.where("text IS NOT NULL").join(F.broadcast(ranked.select("doc_id", "label")), "doc_id")
    return sorted(((r.label, r.doc_id, r.text) for r in chosen.distinct().collect()), key=lambda r: (str(r[0]), r[1], r[2]))
