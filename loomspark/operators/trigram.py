"""Trigram similarity of many queries and texts, in tasks that take texts whole.

A text's words, of letters and digits in lower case, have two blanks before and one after; its trigrams are their windows
of three signs, each a number of 63 bits, so equal numbers are equal trigrams. Queries are the stated side: a block's
trigrams go to the executors as one inverted list, and a text meets all queries of it in one lookup of its own trigrams.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators.vectors import Best

_WORD = re.compile(r"[^\W_]+")
#: Characters of the queries of a block, and texts that are compared before the best are chosen.
BLOCK_CHARS, TEXTS = 4 << 20, 64


def keys(lowered: str) -> np.ndarray:
    """The distinct trigrams of a lower-cased text, sorted."""
    words = _WORD.findall(lowered)
    if not words:
        return np.empty(0, dtype=np.int64)
    signs = np.frombuffer(("  " + "   ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    windows = (signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:]
    return np.unique(windows[(signs[1:-1] != 32) | (signs[2:] != 32)])  # a window that ends in two blanks spans two words


@functools.lru_cache(maxsize=4096)
def _of_query(lowered: str) -> np.ndarray:
    return keys(lowered)


@dataclass(frozen=True)
class Asked:
    """A block of queries: ids, numbers of trigrams, and for each trigram the queries that have it."""

    ids: list
    kind: pa.DataType
    sizes: np.ndarray
    grams: np.ndarray
    ends: np.ndarray
    who: np.ndarray

    @classmethod
    def of(cls, ids: list, kind: pa.DataType, texts: list[str]) -> Asked:
        own = [keys(t) for t in texts]
        gram = np.concatenate(own) if own else np.empty(0, dtype=np.int64)
        who = np.repeat(np.arange(len(own)), [len(k) for k in own])
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        return cls(ids, kind, np.array([len(k) for k in own], dtype=np.int64), grams, np.append(first, len(gram)), who[order])

    def similarity(self, text: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a text's trigrams to each query's, 0 where both are empty."""
        if not len(self.grams):
            return np.zeros(len(self.ids))
        at = np.minimum(np.searchsorted(self.grams, text), len(self.grams) - 1)
        at = at[self.grams[at] == text]
        n = self.ends[at + 1] - self.ends[at]
        which = np.arange(n.sum()) + np.repeat(self.ends[at] - (np.cumsum(n) - n), n)
        both = np.bincount(self.who[which], minlength=len(self.ids))
        return both / np.maximum(1, self.sizes + len(text) - both)


def _blocks(queries: DataFrame, qid: str, query: str) -> Iterator[Asked]:
    rows = queries.select(F.col(qid).alias("q"), F.lower(F.coalesce(query, F.lit(""))).alias("t"))
    chars = rows.agg(F.coalesce(F.sum(F.length("t") + 8), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS)
    for b in range(n):
        table = rows.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == b).toArrow()
        if table.num_rows:
            yield Asked.of(table.column("q").to_pylist(), table.column("q").type, table.column("t").to_pylist())


def similar(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """The k chunks of the highest trigram similarity to each query, ties by id: (qid, cid, score, rank); only positive ones.

    Each block of queries meets all chunks in one scan. A task hands on its own k best of each query, so what is shuffled
    grows with tasks; similarities count to 12 digits. Null texts are empty.
    """
    kinds, out = (dict(queries.dtypes)[qid], dict(corpus.dtypes)[cid]), None
    rows = corpus.select(F.col(cid).alias("c"), F.lower("text").alias("t")).filter("t is not null")
    for asked in _blocks(queries, qid, "query"):
        shared = corpus.sparkSession.sparkContext.broadcast(asked)

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            side = shared.value
            best, everyone, kind = Best(len(side.ids), k), np.arange(len(side.ids)), None
            for batch in batches:
                kind = batch.column("c").type
                ids, texts = np.array(batch.column("c").to_pylist()), batch.column("t").to_pylist()
                for at in range(0, len(texts), TEXTS):
                    sims = np.stack([side.similarity(keys(t)) for t in texts[at : at + TEXTS]], axis=1)
                    best.add(everyone, np.where(sims > 0, sims, -np.inf), ids[at : at + TEXTS])
            if best.id is not None and len(best.id):
                columns = [pa.array([side.ids[i] for i in best.query], type=side.kind), pa.array(best.id.tolist(), type=kind), pa.array(best.sim)]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "c", "score"])

        part = rows.mapInArrow(nearest, f"q {kinds[0]}, c {kinds[1]}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"{qid} {kinds[0]}, {cid} {kinds[1]}, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("c").alias(cid), "score", "rank")


def _jaccard(one: np.ndarray, other: np.ndarray) -> float:
    if not len(one) or not len(other):
        return 0.0
    both = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return both / (len(one) + len(other) - both)


def scored(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """(qid, cid, score) of pairs (qid, cid): their trigram similarity.

    A chunk meets its queries as one row, so its trigrams are made once; that row has as many queries as ask for it. Both
    sides are dealt by chunk into the session's number of partitions, as the work is more than their bytes say.
    """
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pairs.join(queries.select(qid, F.lower(F.coalesce("query", F.lit(""))).alias("query")), qid).repartition(n, cid)
    lists = asked.groupBy(cid).agg(F.collect_list(F.struct(qid, "query")).alias("asked"))
    met = corpus.select(cid, F.lower("text").alias("text")).repartition(n, cid).join(lists, cid)

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series, asked: pd.Series) -> pd.Series:
        own = (keys(t or "") for t in texts)
        return pd.Series([[_jaccard(k, _of_query(q)) for q in qs] for k, qs in zip(own, asked, strict=True)], dtype=object)

    scores = each(F.col("text"), F.transform("asked", lambda a: a["query"]))
    both = met.select(cid, F.col("asked")[qid].alias("q"), scores.alias("s"))
    return both.select(cid, F.explode(F.arrays_zip("q", "s")).alias("x")).select(F.col("x.q").alias(qid), cid, F.col("x.s").alias("score"))


def similarity(one: Column | str, other: Column | str) -> Column:
    """Trigram similarity of two texts, nulls as empty."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_jaccard(keys(y or ""), _of_query(x or "")) for x, y in zip(a, b, strict=True)], dtype="float64")

    return jaccard(F.lower(one), F.lower(other))
