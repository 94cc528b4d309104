"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, exact_dedup, html_crf, lm_score, mixing, quality, simhash, suffix_dedup, url_filter
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), quality.classify(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_corpus(docs).withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["share"])), F.lit(0.0)).alias("share"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_chats(chats.unionByName(spark.sql(chat_format.PLANTED)), together=True))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_html_crf, op3_simhash, op4_mixing, op5_exact_dedup, op6_lm_score, op7_decontamination, op8_chat_format, op9_url_filter, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op8_chat_format": chat_format.ORACLE, "op9_url_filter": url_filter.oracle()}
