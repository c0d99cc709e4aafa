"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
#: Odd multipliers of the word and shingle hashes.
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = tuple(_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C88C6E3D6E8FEB9], dtype=_U)
#: The six ASCII white-space bytes: space, tab, LF, VT, FF, CR.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rows of a file of a small scratch table, and edges whose components are found in one task.
ROWS_OF_A_FILE, EDGES_OF_A_TASK = 200_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Given with its file system. Where that is unset, the session's checkpoint folder, or on a local master a new local one; a cluster must name it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
        configured = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(configured)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: The largest Arrow batch that goes to a Python worker at once: rows of very long texts come in small batches.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of what the session runs from now on, unless its bound is lower already."""
    now = spark.conf.get(BATCH)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of what is run inside, and sets them back."""
    before = spark.conf.get(BATCH)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder from now on.

    Not for loops of joins: a checkpoint keeps its plan's size estimate, the product of what was joined, and that number
    doubles its digits with each round until planning takes longer than the work. See Scratch.
    """
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of a loop, written to a folder of its own in the shared folder, which goes when the block ends.

    What is returned from the block must have been cut() before.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """The same rows, read from a Parquet table; a small one has few files. most: a bound of the rows where one is known."""
        if most is not None:
            return self.written(df.coalesce(1 + most // ROWS_OF_A_FILE))
        files = self.written(df)
        wanted, first = 1 + files.count() // ROWS_OF_A_FILE, self.n
        if len(files.inputFiles()) <= 4 * wanted:
            return files
        few = self.written(files.coalesce(wanted))
        delete(self.spark, f"{self.folder}/{first}")
        return few

    def written(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a Parquet table with a file for each task."""
        self.n += 1
        # pages end with the row that fills them: a page of large values would be buffered outside the heap as a whole
        df.write.option("compression", "uncompressed").option("parquet.page.size.row.check.min", "1").parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, number: int) -> None:
        """The table written as the number-th goes; nothing reads it any more."""
        delete(self.spark, f"{self.folder}/{number}")

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and starts and ends of the maximal runs without ASCII white space."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return data, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; words are runs without ASCII white space, A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=_U)
    data, starts, ends = word_bounds(text.encode("utf-8", "surrogatepass").lower())
    if not len(starts):
        return np.empty(0, dtype=_U)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _powers(1 << max(6, (longest - 1).bit_length()))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = data[~_SPACE[data]].astype(_U) + _U(1)
    sums = np.add.reduceat(letters * powers[place], np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(_U) * _PLACE[0])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter, none if it is empty."""
    if not len(words):
        return np.empty(0, dtype=_U)
    if len(words) < k:
        k = len(words)
    rows = len(words) - k + 1
    total = np.full(rows, k, dtype=_U)
    for i in range(k):
        total = mix64(total * _PLACE[i % len(_PLACE)] + words[i : i + rows])
    return np.unique(total)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of few edges (a, b), by the rounds of components()."""
    edges = pd.concat(batches)
    nodes, at = np.unique(np.concatenate((edges["a"], edges["b"])), return_inverse=True)
    ends, root = at.reshape(2, -1), np.arange(len(nodes))
    while (ends := root[ends][:, root[ends[0]] != root[ends[1]]]).size:
        np.minimum.at(root, ends.max(axis=0), ends.min(axis=0))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root the least node of its component.

    Up to EDGES_OF_A_TASK edges, one task finds them: each round of a few rows would write several tables. Of more, each
    round hangs every node below its least smaller neighbour, flattens these trees by pointer doubling and
    contracts the edges; the roots at least halve, so rounds grow with the logarithm of the number of nodes.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with Scratch(edges.sparkSession) as scratch:
        live = scratch.keep(pair.filter("a is not null and b is not null and a < b").distinct())
        most = 2 * live.count()
        if 0 < most <= 2 * EDGES_OF_A_TASK:
            kind = dict(live.dtypes)["a"]
            return cut(live.coalesce(1).mapInPandas(_rooted, f"node {kind}, root {kind}"))
        keep = lambda df: scratch.keep(df, most)
        links = live.select(F.col("b").alias("node"), F.col("a").alias("root")).limit(0)
        while not live.isEmpty():
            up = keep(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
            moved = True
            while moved:
                higher = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
                step = keep(up.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
                moved = not step.filter("moved").isEmpty()
                up = step.select("node", "root")
            over = links.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            links = keep(over.select("node", F.coalesce("above", "root").alias("root")).unionByName(up))
            left, right = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            ends = live.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            live = keep(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        return cut(links.unionByName(links.select(F.col("root").alias("node"), "root").distinct()).coalesce(1 + most // ROWS_OF_A_FILE))
