"""A corpus through quality, dedup, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

Defined results: null texts count as empty; they and empty texts are scored like any
other, and of those that pass one stays, the rest being copies of it.  Rows with the
same id stay apart until a stage finds them equal, null ids are the smallest in exact
dedup and the last in near-dedup, and of rows equal in all that decides one stays.  Null
sources are a source.  Extra columns travel along; a table without rows stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm import decontam, exact_dedup, mixing, overlap, quality, simhash
from facetloom.llm.common import cut, free_name, new_folder, read, remove_folder, with_row_key
from facetloom.llm.components import connected_components


#: Bits of a row's place in its file; the rest of its number is a hash of the file's path.
PLACE_BITS, SEEDS = 24, (1, 2, 3, 4)


def file_number(seed: int):
    return F.shiftrightunsigned(F.xxhash64("_metadata.file_path", F.lit(seed)), PLACE_BITS + 1)


def by_place(docs: DataFrame, key: str) -> DataFrame | None:
    """``docs`` with a number for each row from its file and its place there, None if that is no number of its own.

    That takes a plain scan of files, no file of more than 2^24 rows, and a hash that
    tells all files apart, which is checked.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in {c.lower() for c in docs.columns}:
        return None
    names = [f"n{seed}" for seed in SEEDS]
    try:
        files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), *[file_number(s).alias(n) for s, n in zip(SEEDS, names, strict=True)])
    except AnalysisException:
        return None
    files = files.groupBy("path", *names).agg(F.max("place").alias("place"))
    found = files.agg(F.count(F.lit(1)).alias("files"), F.max("place").alias("place"), *[F.count_distinct(n).alias(n) for n in names]).first()
    seed = next((s for s, n in zip(SEEDS, names, strict=True) if found[n] == found["files"]), None)
    if seed is None or (found["place"] or 0) >> PLACE_BITS:
        return None
    return docs.withColumn(key, F.shiftleft(file_number(seed), PLACE_BITS) + F.col("_metadata.row_index"))


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name.

    Every later scan finds the numbers again however it is split, after lost executors
    too: they follow a row's place in its file, or are written with the rows.
    """
    key = free_name(docs, "row_key")
    placed = by_place(docs, key)
    if placed is not None:
        return placed, key
    folder = new_folder(spark, "rows")
    with_row_key(docs, key).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder), key


def keep_rows(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose key is in ``dropped``, and without the key; neither side is assumed small."""
    return rows.join(dropped, key, "left_anti").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.classify(docs, model) >= quality.CUT)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    rows, key = numbered(spark, docs)
    found = exact_dedup.exact_dedup(rows, key_col=key)
    return keep_rows(rows, key, found.filter("NOT kept").select(F.col("key").alias(key)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies are texts with close fingerprints, as op3 finds them, and those whose
    five-word shingles overlap by 0.8 or more, which fingerprints alone mostly miss.
    """
    rows, key = numbered(spark, docs)
    found = cut(simhash.near_dedup(rows, key_col=key).select("key", "id", "head"))
    texts = rows.select(F.col(key).alias("key"), F.col("text"))
    edges = found.filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).union(overlap.links(texts))
    grouped = found.join(connected_components(edges).withColumnRenamed("node", "key"), "key")
    # Nulls last, then the first row of the smallest id.
    heads = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    dropped = grouped.join(heads, "root").filter("key <> first.key")
    return keep_rows(rows, key, dropped.select(F.col("key").alias(key)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The first stage learns a model, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``.

    A stage's table is removed once the next is written; the last one's stays until the
    session ends, as the result is read from it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return docs
