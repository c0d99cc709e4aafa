"""Calls of an embedding provider from tasks, and the table of what it answered."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from loomspark.operators.indexing import missing_embeddings
from loomspark.sources import shared

#: What a provider is: texts in, (index of the text, vector) out, in any order. It is sent to the tasks.
Provider = Callable[[list[str]], Sequence[tuple[int, Sequence[float]]]]
#: Texts of one call at most.
SHARD = 32


class BadAnswer(ValueError):
    """An answer that is not one fitting vector for each text; asking again would not help."""


def checked(answer: Sequence[tuple[int, Sequence[float]]], n: int, dim: int, tolerance: float = 1e-3) -> list[list[float]]:
    """The vectors in the order of the texts; each text has one, of the dimension, finite and of length one."""
    if len(answer) != n or {i for i, _ in answer} != set(range(n)) or any(isinstance(i, bool) for i, _ in answer):
        raise BadAnswer("the provider did not answer each text once")
    out: list[list[float]] = [[]] * n
    for i, vector in answer:
        values = [float(x) for x in vector]
        if len(values) != dim or not all(map(math.isfinite, values)):
            raise BadAnswer("the provider answered with a vector of another dimension or without finite values")
        if not math.isclose(math.sqrt(sum(x * x for x in values)), 1.0, rel_tol=tolerance, abs_tol=tolerance):
            raise BadAnswer("the provider answered with a vector that is not of length one")
        out[i] = values
    return out


def asked(provider: Provider, texts: list[str], dim: int, tries: int = 3, wait: float = 0.5) -> list[list[float]]:
    """One call, again after failures of the connection, waiting twice as long each time."""
    for n in range(tries):
        try:
            return checked(provider(texts), len(texts), dim)
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("tries must be positive")


def embedded(chunks: DataFrame, provider: Provider, dim: int, shard: int = SHARD, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """(chunk_id, embedding) of chunks (chunk_id, text), asked in calls of at most shard texts; null texts are left out."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), shard):
                part = batch.iloc[at : at + shard]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": asked(provider, part["text"].tolist(), dim, tries, wait)})

    return chunks.select("chunk_id", "text").filter("text is not null").mapInPandas(call, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, embedding array<double>")


def held(spark, folder: str, revision: str, chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding) of a revision in a folder, each chunk once; empty where nothing was written."""
    path = f"{folder}/revision={revision}"
    schema = f"chunk_id {dict(chunks.dtypes)['chunk_id']}, embedding array<double>"
    if not shared.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/*").dropDuplicates(["chunk_id"])


def embed_missing(chunks: DataFrame, folder: str, revision: str, provider: Provider, dim: int, **call: float) -> DataFrame:
    """Asks for the active chunks (chunk_id, text, active) that a revision lacks, adds the answers to folder and returns all it holds.

    A run writes a part of its own that Spark puts in place as a whole, so a run that failed leaves nothing, and one that
    is repeated asks for nothing twice.
    """
    from pyspark.sql import functions as F

    spark = chunks.sparkSession
    wanted = missing_embeddings(chunks, held(spark, folder, revision, chunks).withColumn("revision", F.lit(revision)), revision)
    embedded(wanted, provider, dim, **call).write.parquet(f"{folder}/revision={revision}/part={uuid.uuid4().hex}")
    return held(spark, folder, revision, chunks)
