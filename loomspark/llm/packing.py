"""Packing by optimal length buckets: boundaries from dynamic programming over the global length histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.llm.common import cut

#: A token: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]"

#: What pack() adds to a row.
RESULTS = ("n_tokens", "bucket", "bucket_end", "batch", "slot")


def token_length(text: str = "text") -> Column:
    """Words and marks of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bucket lengths with the least total padding, for a histogram sorted by length.

    cost(i, j) pads lengths i..j-1 up to lengths[j-1]; it has the Monge property, so each layer is filled by divide
    and conquer in n log n. Among equal totals the earliest cut is taken.
    """
    n = len(lengths)
    rows = np.concatenate(([0], np.cumsum(counts)))
    mass = np.concatenate(([0], np.cumsum(lengths * counts)))
    best = lengths * rows[1:] - mass[1:]
    best = np.concatenate(([0], best)).astype(np.int64)
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, where = best.copy(), np.zeros(n + 1, dtype=np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, first, last = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            total = best[i] + lengths[mid - 1] * (rows[mid] - rows[i]) - (mass[mid] - mass[i])
            at = int(total.argmin())
            new[mid], where[mid] = total[at], i[at]
            stack += [(lo, mid - 1, first, int(i[at])), (mid + 1, hi, int(i[at]), last)]
        cuts.append(where)
        best = new
    ends, j = [], n
    for where in [*reversed(cuts), None]:
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(where[j]) if where is not None else 0
    return ends[::-1]


def boundaries(lengths: DataFrame, column: str, buckets: int) -> list[int]:
    """Optimal bucket ends of a column of lengths.

    The histogram is counted over all rows and reaches the driver with one bin for each distinct length. d distinct
    lengths take at least d * (d - 1) / 2 tokens, so a table of 5e9 tokens has at most about 1e5 of them.
    """
    histogram = lengths.groupBy(F.col(column).alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect()
    if not histogram:
        return []
    return best_boundaries(np.array([r["n"] for r in histogram], dtype=np.int64), np.array([r["c"] for r in histogram], dtype=np.int64), buckets)


def pack(docs: DataFrame, length: Column | None = None, key: str = "doc_id", buckets: int = 8, budget: int = 16384, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, n_tokens, bucket, bucket_end, batch, slot, and the columns of docs named in carry.

    Rows of a bucket are padded to bucket_end, so a batch holds max(1, budget // bucket_end) of them; a document
    longer than the budget has a batch of its own. Inside a bucket rows are numbered in the order of the first three
    digits of md5(key), then key, then length: the digits deal even a bucket with most rows over 4096 groups that are
    numbered apart and joined by a running total of their counts. Equal rows take separate slots; a null key counts as
    the text 'null'; null and empty texts have length 0; an empty table gives an empty result. Other columns of docs
    are not used, and a carried one of a result's name (in capitals or not) gives way to the result. Equal lengths share
    a bucket; a text of any length is counted whole.
    """
    taken = {name.lower() for name in (key, *RESULTS)}
    carry = tuple(c for c in carry if c.lower() not in taken)
    length = token_length() if length is None else length
    salt = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 3)
    own = [F.col(key).alias("k"), length.cast("long").alias("n_tokens"), salt.alias("salt")]
    rows = cut(docs.select(*own))
    ends = boundaries(rows, "n_tokens", buckets)
    edge = F.lit(None).cast("int")
    for i in reversed(range(len(ends))):
        edge = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(edge)
    table = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast(T.ArrayType(T.LongType()))
    place = lambda df: df.withColumn("bucket", edge).withColumn("bucket_end", F.get(table, F.col("bucket")))
    sizes = place(rows).groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("k", "n_tokens"))
    whole = docs.select(*own, F.struct(*carry).alias("carried")) if carry else rows
    numbered = place(whole).withColumn("nth", local).join(F.broadcast(offsets), ["bucket", "salt"])
    at = F.col("before") + F.col("nth") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_end"), F.lit(1))))
    return numbered.select(
        F.col("k").alias(key), "n_tokens", "bucket", "bucket_end",
        F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"),
        *([F.col("carried")[c].alias(c) for c in carry]),
    )
