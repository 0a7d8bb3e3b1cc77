"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import embeddings, html_text, language, manifest, merkle, mixing, negatives, packing, secrets, simhash, toxicity, warc, wordpiece
from panelyard.llm.common import id_crc32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = language.identify(docs, language.fit(language.training_rows(docs)))
    return got.select("doc_id", (id_crc32() % 4 == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    got = toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels), docs))
    return got.select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "score", "predicted", F.transform("evidence", lambda x: x["doc_id"]).alias("evidence"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edit(_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_simhash": op3_simhash,
        "op4_html_text": op4_html_text,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_warc": op8_warc,
        "op9_token_counts": op9_token_counts,
        "op10_merkle": op10_merkle,
        "op11_secret_scan": op11_secret_scan,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """Compression, neural labels, SimHash, kNN, tokenizers and decoded layers are beyond SQL; their queries are tested by brute force."""
    return {
        "op2_embedding_dedup": embeddings.NEAR_SQL,
        "op7_mixing": mixing.MIX_SQL,
        "op8_warc": warc.ROUND_TRIP_SQL,
        "op10_merkle": merkle.COMPARE_SQL,
        "op12_hard_negatives": negatives.MINE_SQL,
        "op13_manifest": manifest.MANIFEST_SQL,
    }
