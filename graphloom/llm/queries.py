"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, lines, mixing, neardup, neighbours, secrets, sharding, spans, tokens, toxicity
from graphloom.llm.common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).drop("found")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), 50)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.scored(docs, model).drop("offending")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf_dir, "documents"), 24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_near_duplicates, op4_token_ids, op5_nearest, op6_decontaminate, op7_toxicity, op8_sentence_spans, op9_shard, op10_line_dedup)}
