"""Documents to training batches in five stages, each on what the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import decontamination, language_id, minhash_dedup, packing, pii
from riskspark.llm.tables import col, free_name, read, without_ids
from riskspark.plans.registry import query
from riskspark.sources.staging import stage, work_path

LEAST_SCORE = 0.35
"""Texts whose likeliest language pools less than this are rejected, and so are texts without a letter."""


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; all with a letter if no row has a language to learn from."""
    net = language_id.fit(docs)
    if net is None:
        return docs.where(col(docs, "text").rlike(r"\p{L}"))
    name = free_name(docs, "language")
    known = F.col(name)["lang"].isNotNull() & (F.col(name)["lang"] != language_id.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)
    return docs.withColumn(name, language_id.language(col(docs, "text"), net)).where(known).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id. Of rows that repeat an id, one stays."""
    found = stage(minhash_dedup.near_duplicates(docs, cfg=minhash_dedup.NearDupConfig(percent=80, floor_percent=55)), "near")
    left = without_ids(docs, "doc_id", found.where("not kept").select("doc_id"))
    twice = stage(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return without_ids(left, "doc_id", twice).unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = stage(decontamination.contamination(docs, read(spark, sf_dir, "benchmark")), "contamination")
    dirty = found.where("contaminated")
    left = without_ids(docs, "doc_id", dirty.select("doc_id").where("doc_id is not null"))
    if dirty.where("doc_id is null").isEmpty():
        return left
    texts = decontamination.matches(docs, read(spark, sf_dir, "benchmark")).select("th", "tl").distinct()
    th, tl = F.xxhash64(col(left, "text")), F.length(col(left, "text"))
    return left.join(texts, (F.col("doc_id").isNull()) & (th == texts.th) & (tl == texts.tl), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    clean = pii.redacted(docs, pii.fit(docs))
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained network, trained trees and dynamic programming have no SQL; tests/llm runs it on odd rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline")(run)
