"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import common, crf, jaccard, lines, packing, winnowing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the field has learned; null texts, texts without letters and unclear ones go."""
    model = crf.fit(docs)
    found = crf.predict(docs, model)
    return found.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= crf.least_score(model))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line passages that stand in an earlier document; those of which nothing is left go."""
    found = lines.drop_repeated_passages(docs).where((F.col("n_removed_chunks") == 0) | (F.length("text") > 0))
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id."""
    return jaccard.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    found = winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("tid").alias("__bad")).distinct()
    return docs.withColumn("__id", common.text_id(F.col("text"))).join(found, F.col("__id") == F.col("__bad"), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("line dedup", line_dedup), ("near copies", near_copies), ("decontaminate", decontaminate), ("pack", pack)]

#: The language and packing stages are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
