"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import neardup

    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import packing

    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import sstable

    return sstable.digest(sstable.read_shards(sstable.write_shards(_table(spark, sf_dir, "documents"))))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import topk

    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import urls

    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import repeats

    return repeats.digest(repeats.find_repeats(_table(spark, sf_dir, "documents"), whole=True))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import secrets

    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import matroska

    return matroska.read_back(matroska.store_media(_table(spark, sf_dir, "documents")))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm import mixture

    return mixture.digest(mixture.mix(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_neardup, op2_packing, op3_sstable, op4_topk, op5_urls, op6_repeats, op7_quality, op8_secrets, op9_matroska, op10_mixture]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from granary.llm import mixture, secrets, topk, urls

    return {"op4_topk": topk.SQL, "op5_urls": urls.sql(), "op8_secrets": secrets.SQL, "op10_mixture": mixture.SQL}
