"""The curation pipeline: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes documents (doc_id, text, lang, source, n_chars, in any order and with further columns) and keeps the
columns of what it gets; an empty table stays empty. Arrow batches are bounded by bytes, as texts may be very long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, langid, ngram_join, packing, pii
from loomspark.llm.common import bound_batches, delete, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the language classifier accepts; it learns from the languages given in the documents.

    Null, empty and letterless texts are rejected; repeated rows stay or go together.
    """
    bound_batches(spark)
    model = langid.fit(docs)
    found = docs.select(F.struct(*docs.columns).alias("row"), langid.classify("text", model).alias("found"))
    return found.filter("found.accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of linked documents.

    Of rows that repeat doc_id and text one stays; a row without doc_id stays, and so does one without words.
    """
    bound_batches(spark)
    groups = ngram_join.jaccard_components(docs, k=5, threshold="0.8")
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once, several = kept.join(again, "doc_id", "left_anti"), kept.join(again, "doc_id", "left_semi")
    return once.select(*docs.columns).unionByName(several.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks; all rows of such a doc_id go. Null and empty texts stay."""
    bound_batches(spark)
    found = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind of each identifier found in its place; n_chars follows the new text, null texts stay null."""
    bound_batches(spark)
    masked = pii.mask(docs, pii.find(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with their length bucket, batch and slot, which replace columns of these names; null and empty texts have no tokens."""
    return packing.pack(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again by the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
