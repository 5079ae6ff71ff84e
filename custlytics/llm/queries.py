"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlytics.llm import (ann, burst_trie, html_crf, jaccard_trie, line_dedup, merkle, mixing, quality_rules,
                            sentencepiece_bpe, sharding, token_orc, toxicity, url_filter)
from custlytics.llm.tables import read_table
from custlytics.session import materialize_table, scratch_path, track


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs, keep=["doc_id"]))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = ann.vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vecs, vecs.where(F.col("vec_id") % 50 == 0))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source", "text")).drop("text")


def op4_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs.select("doc_id", "text"))


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read_table(spark, sf_dir, "pages"))


def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.assign(docs.select("doc_id", "text")).drop("text")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    track(spark, path)
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path)
    return token_orc.offsets(spark, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = burst_trie.conversations(read_table(spark, sf_dir, "conversations"))
    return burst_trie.trie(burst_trie.rebuild(materialize_table(convs, "conversations")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_ann, op3_temperature_mix, op4_jaccard_trie, op5_toxicity, op6_quality_rules,
        op7_line_dedup, op8_html_crf, op9_extendible_shards, op10_token_orc, op11_merkle_manifest,
        op12_conversation_trie, op13_url_filter)}

ORACLE: dict[str, str] = {
    "op3_temperature_mix": mixing.duckdb_sql(),
    "op6_quality_rules": quality_rules.duckdb_sql(),
    "op7_line_dedup": line_dedup.duckdb_sql(),
    "op9_extendible_shards": sharding.duckdb_sql(),
    "op11_merkle_manifest": merkle.duckdb_sql(),
    "op12_conversation_trie": burst_trie.duckdb_sql(),
    "op13_url_filter": url_filter.duckdb_sql(),
}
