"""Small tables with every awkward case, with extra columns whose names the operators use inside."""

from pyspark.sql import functions as F

PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and wonder "
         "why anybody would run so fast on such a warm and quiet afternoon in the middle of june")


def documents(spark, rows):
    """(doc_id, text) rows with clashing extra columns."""
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return (plain.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
            .withColumn("score", F.lit("clash")).withColumn("label", F.lit(None).cast("string"))
            .withColumn("rank", F.lit(0)).withColumn("key", F.lit("k")).withColumn("row_no", F.lit(5))
            .withColumn("text_hash", F.lit(1)).withColumn("rules", F.lit(0)).withColumn("node", F.lit(2)))


def awkward():
    long_text = " ".join(f"{w}{k}" for k in range(4000) for w in ("alpha", "beta", "gamma"))
    return [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "one two"),
            (8, long_text), (9, long_text + " end"), (None, PROSE), (10, "Ünïcödé 😀 Straße\x00 ok."), (11, "1234 5678")]
