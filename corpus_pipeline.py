"""From raw documents to packed training sequences in five stages."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, neardup, packing, pii, quality
from tidemark.llm.common import collected, delete, saved, table, tuned
from tidemark.session import shared_dir


_LAST = threading.local()


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage's work tables are needed until its result is written, that is, until the next stage begins."""
    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(tuned(spark))
        with collected() as folders:
            out = work(spark, docs, sf_dir)
        _LAST.folders = folders
        return out
    return staged


def clear(spark: SparkSession) -> None:
    """Delete the work tables of this thread's last stage."""
    for folder in _LAST.__dict__.pop("folders", []):
        delete(spark, folder)


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


@stage
def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: of the least id (null last), then of the least digest; of equal rows one.

    Rows are told apart by id and text, so different texts of one id each stay or go by themselves.
    """
    keyed = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    classes = neardup.near_duplicates(keyed, id_column="__digest", columns=["doc_id", "__digest"])
    rows = saved(classes.groupBy("class_id", "doc_id", "__digest").agg(F.count(F.lit(1)).alias("n")), "classes")
    first = rows.groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__digest")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__digest") == F.col("first.__digest"))
    dropped = rows.join(first, "class_id").where(~same).select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__text"))

    def matching(other: DataFrame, how: str) -> DataFrame:
        return kept.join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__text")), how)

    kept = keyed
    kept = matching(dropped, "left_anti")
    repeated = rows.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__text"))
    if not repeated.isEmpty():
        kept = matching(repeated, "left_anti").unionByName(matching(repeated, "left_semi").dropDuplicates(["doc_id", "__digest"]))
    return kept.select(*docs.columns)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    clean = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _recounted(clean.select(*docs.columns))


@stage
def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _recounted(pii.find_personal_data(docs, redact=True).select(*docs.columns))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 1024."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

# Perplexity models, weighted sketches and tokenizers are beyond SQL; tests hold brute force against each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs, before = table(tuned(spark), sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/tidemark-llm/pipeline-{uuid.uuid4().hex}"
    for name, work in STAGES:
        path = f"{folder}/{name}"
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    clear(spark)
    return docs
