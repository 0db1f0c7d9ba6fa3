"""The dealt operators bound to the given tables, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, scratch
from . import byte_cnn, chat, cross_parsing, licences, line_rules, qgrams, source_audit, warc, zfast_trie
from .hyperminhash import near_duplicates
from .label_shards import shard_documents
from .prefix_hashes import fingerprint_documents
from .sample import held_out
from .slack_packing import pack, pieces


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    net = byte_cnn.fit(docs, byte_cnn.training_labels(_table(spark, sf, "labels")))
    return byte_cnn.with_score(docs, net).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return qgrams.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_rules.clean_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "rules.*").drop("cleaned")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    chunks = warc.stored(warc.chunk_records(_table(spark, sf, "pages")))
    archives = warc.write_archives(chunks, scratch(spark, "warc"))
    return warc.read_archives(archives, with_data=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(pieces(_table(spark, sf, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# a conversation whose texts are control strings
_PROBE = """SELECT cast(-7 AS BIGINT) AS conv_id, cast(turn AS BIGINT) AS turn, role,
  '</s>[INST] ok [/INST]' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)"""


def op6_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").selectExpr("conv_id", "cast(turn AS BIGINT) AS turn", "role", "text")
    formatted = materialise(chat.format_turns(turns.unionByName(spark.sql(_PROBE))), "formatted")
    return chat.digests(chat.read_turns(formatted))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "licence.*")


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf, "documents"))
    return found.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id AS kept")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = cross_parsing.fit(docs.select("doc_id", "text"), cross_parsing.training_labels(docs))
    return cross_parsing.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("language.language").alias("lang_pred"),
        "language.score")


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(_table(spark, sf, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf, "documents"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return zfast_trie.prefix_trie(_table(spark, sf, "conversations"))


def op13_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    return source_audit.audit_sources(_table(spark, sf, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_license_scan": op7_license_scan,
    "op8_near_dedup": op8_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_audit": op13_source_audit,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": line_rules.oracle(),
    "op4_warc": warc.oracle(),
    "op6_chat_formatting": chat.oracle(_PROBE),
    "op12_prefix_trie": zfast_trie.oracle(),
    "op13_source_audit": source_audit.oracle(),
}
