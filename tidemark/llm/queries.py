"""One query for each operator, over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, decontaminate, html_blocks, lang_ppm, media_matroska, merkle_manifest, mix_sources, pii_boost, shard_ring, toxicity_chain, url_filter, warc_normalise, whitening
from .common import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_matroska.features(table(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.reported(pages)).select("page_id", "host", "path", "rule", "verdict")


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_ppm.predicted(table(spark, sf_dir, "documents"))


def op5_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.taken(table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ring.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.found(table(spark, sf_dir, "documents"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normalise.round_trip(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(table(spark, sf_dir, "documents"))


def op12_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


def op13_choleskyqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_bloom_url_filter": op3_bloom_url_filter,
    "op4_ppm_language": op4_ppm_language,
    "op5_efraimidis_mix": op5_efraimidis_mix,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_bounded_ring": op7_bounded_ring,
    "op8_pii_boosting": op8_pii_boosting,
    "op9_bagminhash": op9_bagminhash,
    "op10_warc_normaliser": op10_warc_normaliser,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_block_lstm": op12_block_lstm,
    "op13_choleskyqr_whitening": op13_choleskyqr_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_bloom_url_filter": url_filter.SQL,
    "op5_efraimidis_mix": mix_sources.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
}
