"""Running sums over a distributed sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from loomspark.llm.common import Scratch, parts


def _segments(group: np.ndarray) -> np.ndarray:
    """Where each row's run of equal values starts."""
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch, group: str | None = None) -> DataFrame:
    """df with one column for each of sums: the sum of its expression over all rows up to this one in `order`.

    With group, the integral first column of order, sums start anew with each of its values. Expressions are integral and
    not negative. The rows are dealt by ranges of the order, so a group may lie over many tasks; a task sums what it
    reads, and what lies before it is added from one row of totals for each task. Ties in the order may come in any
    order. Rows are written to scratch once; the work of df is not repeated.
    """
    spark, names = df.sparkSession, list(sums)
    ready = df.withColumns({n: e.cast("long") for n, e in sums.items()})
    kept = [c for c in ready.columns if c not in names]
    schema = StructType([f for f in ready.schema if f.name not in names])
    for n in names:
        schema = schema.add(n, LongType())
    schema = schema.add("_part", IntegerType()).add("_head", BooleanType())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, carried = TaskContext.get().partitionId(), None, None, {n: 0 for n in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(batch.num_rows, dtype=np.int64)
            starts = _segments(key)
            first = key[0] if first is None else first
            out = [batch.column(c) for c in kept]
            for n in names:
                value = batch.column(n).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                total -= (total - value)[starts]
                if last is not None and key[0] == last:
                    total[starts == 0] += carried[n]
                carried[n] = int(total[-1])
                out.append(pa.array(total, type=pa.int64()))
            last = key[-1]
            out += [pa.array(np.full(len(key), part, dtype=np.int32)), pa.array(key == first)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *names, "_part", "_head"])

    dealt = ready.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    files = scratch.keep(dealt.mapInArrow(add_up, schema))
    key = F.col(group) if group else F.lit(0)
    ends = files.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("key"), *names)).alias("end")).orderBy("_part").collect()
    carry, last, total = [], None, [0] * len(names)
    for row in ends:
        before = total if row["first"] == last else [0] * len(names)
        carry.append((row["_part"], *before))
        alone = row["first"] == row["end"]["key"]
        total = [row["end"][n] + (b if alone else 0) for n, b in zip(names, before, strict=True)]
        last = row["end"]["key"]
    table = spark.createDataFrame(carry, "_part int" + "".join(f", _before_{i} long" for i in range(len(names))))
    added = {n: F.col(n) + F.when(F.col("_head"), F.col(f"_before_{i}")).otherwise(0) for i, n in enumerate(names)}
    return files.join(F.broadcast(table), "_part").withColumns(added).select(*kept, *names)
