"""Nearest neighbours by cosine: an exact scan, and an inverted file of cells at rest.

The inverted file is a folder of two Parquet tables: `cells` (cell, centroid, n, radius) and `rows`, partitioned by cell.
A search reads the partitions of the cells nearest to a query only. As the radius bounds how far a cell's vectors lie from
its centroid, cells that cannot hold a better neighbour are known, so a search can also be exact without reading them.
Distances between vectors of length one obey the triangle inequality; all of them are taken there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.sources.shared import Kept

#: Bytes of query vectors that go to the executors at once.
BLOCK_BYTES = 64 << 20
#: Similarities made at once, and digits that count: equal vectors must not differ by how they were multiplied.
TILE, DIGITS = 1 << 22, 12


def matrix(column: pa.Array, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the lists of `wide` finite numbers that are not all zero; the first list's width if it is None."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    if wide is None:
        wide = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 1
    fit = np.flatnonzero(sizes == wide)
    flat = column.take(pa.array(fit)).flatten()
    found = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), wide)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.linalg.norm(found, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return fit[good], found[good] / norms[good, None]


class Best:
    """The k most similar ids of each of n queries so far, ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.sim, self.id = np.empty(0, dtype=np.int64), np.empty(0), None

    def add(self, queries: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """sims: a row for each of queries, a column for each of ids; those of minus infinity count as none."""
        sims = np.round(sims, DIGITS)
        least = self.least[queries]
        if sims.shape[1] > self.k:
            least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
        if not len(row):
            return
        query, sim, key = queries[row], sims[row, column], ids[column]
        if self.id is not None:
            again = np.isin(self.query, query)
            rest = self.query[~again], self.sim[~again], self.id[~again]
            query, sim, key = (np.concatenate(x) for x in ((query, self.query[again]), (sim, self.sim[again]), (key, self.id[again])))
        order = np.lexsort((key, -sim, query))
        query, sim, key = query[order], sim[order], key[order]
        first = np.r_[True, query[1:] != query[:-1]]
        at = np.arange(len(query))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        self.least[query[nth == self.k - 1]] = sim[nth == self.k - 1]
        some = nth < self.k
        query, sim, key = query[some], sim[some], key[some]
        if self.id is not None:
            query, sim, key = (np.concatenate(x) for x in zip(rest, (query, sim, key), strict=True))
        self.query, self.sim, self.id = query, sim, key


@dataclass(frozen=True)
class Asked:
    """A block of queries: their ids and unit vectors."""

    ids: list
    kind: pa.DataType
    vectors: np.ndarray


def blocks(queries: DataFrame, qid: str, vector: str) -> Iterator[Asked]:
    """The stated queries in blocks of about BLOCK_BYTES, dealt by a hash of their ids; null, zero and misfit vectors are left out."""
    rows = queries.select(F.col(qid).alias("q"), F.col(vector).alias("v")).filter("v is not null")
    count, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n = max(1, -(-count * (wide or 1) * 8 // BLOCK_BYTES))
    for b in range(n):
        table = rows.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == b).toArrow().combine_chunks()
        if table.num_rows:
            lists = table.column("v").combine_chunks()
            fit, unit = matrix(lists if isinstance(lists, pa.Array) else lists.chunk(0), wide)
            ids = table.column("q").to_pylist()
            yield Asked([ids[i] for i in fit], table.column("q").type, unit)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def _scan(rows: DataFrame, asked: Asked, k: int, kinds: tuple[str, str], probes: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(q, c, sim): each task's k best of each query among rows (c, v), or (cell, c, v) where queries probe cells."""
    shared = rows.sparkSession.sparkContext.broadcast((asked.ids, asked.kind, asked.vectors, probes))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q_type, side, wanted = shared.value
        everyone = np.arange(len(names))
        best, c_type = Best(len(names), k), None
        for batch in batches:
            c_type = batch.column("c").type
            fit, unit = matrix(batch.column("v"), side.shape[1])
            ids = _ids(batch.column("c"))[fit]
            cells = batch.column("cell").to_numpy(zero_copy_only=False)[fit] if wanted is not None else np.zeros(len(fit), dtype=np.int64)
            for cell in np.unique(cells):
                who = everyone if wanted is None else wanted.get(int(cell), everyone[:0])
                members = np.flatnonzero(cells == cell)
                step = max(1, TILE // max(1, len(who)))
                for at in range(0, len(members) if len(who) else 0, step):
                    some = members[at : at + step]
                    best.add(who, side[who] @ unit[some].T, ids[some])
        if best.id is not None:
            for at in range(0, len(best.id), 1 << 16):
                part = slice(at, at + (1 << 16))
                q = pa.array([names[i] for i in best.query[part]], type=q_type)
                yield pa.RecordBatch.from_arrays([q, pa.array(best.id[part].tolist(), type=c_type), pa.array(best.sim[part])], names=["q", "c", "sim"])

    return rows.mapInArrow(nearest, f"q {kinds[0]}, c {kinds[1]}, sim double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _ranked(found: DataFrame, k: int, qid: str, cid: str) -> DataFrame:
    return _top(found, k).select(F.col("q").alias(qid), F.col("c").alias(cid), F.greatest(F.lit(0.0), "sim").alias("score"), "rank")


def _together(parts: list[DataFrame], spark, kinds: tuple[str, str]) -> DataFrame:
    out = spark.createDataFrame([], f"q {kinds[0]}, c {kinds[1]}, sim double")
    for part in parts:
        out = out.unionByName(part)
    return out


def knn(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "query_id", cid: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest corpus vectors of each query by cosine distance, ties by id: (qid, cid, score, rank), score max(0, 1 - d).

    Exact. Queries are the stated side: they go to the executors in blocks of bounded bytes, each against all rows. A task
    multiplies matrices and hands on its own k best of each query, so what is shuffled grows with tasks, not rows; of equal
    vectors those with the least ids are taken where they lie. Similarities count to 12 digits. Null, zero and misfit
    vectors rank nowhere.
    """
    kinds = dict(queries.dtypes)[qid], dict(corpus.dtypes)[cid]
    rows = corpus.select(F.col(cid).alias("c"), F.col(vector).alias("v")).filter("v is not null")
    return _ranked(_together([_scan(rows, asked, k, kinds) for asked in blocks(queries, qid, vector)], corpus.sparkSession, kinds), k, qid, cid)


def centroids(corpus: DataFrame, cells: int, vector: str = "embedding", sample: int = 200_000, seed: int = 7) -> np.ndarray:
    """Unit centroids of at most `cells` cells by distributed k-means on about `sample` vectors, chosen by a hash of the vector."""
    from pyspark.ml.clustering import KMeans  # tasks that only search don't load it
    from pyspark.ml.functions import array_to_vector

    rows = corpus.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    total, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return np.empty((0, 1))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    drawn = rows.filter(F.size("v") == wide).filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, sample / total)))
    units = drawn.withColumn("norm", norm).filter("norm > 0 and norm < double('infinity')").select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features"))
    if units.isEmpty():
        return np.empty((0, wide))
    model = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=12, seed=seed).fit(units)
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def build(corpus: DataFrame, folder: str, cells: int | None = None, cid: str = "chunk_id", vector: str = "embedding", sample: int = 200_000) -> None:
    """Writes the inverted file of all rows of corpus to folder.

    cells is the square root of the rows, 4,096 at most, where it is not given; what is sent to the executors is their
    centroids. Rows are dealt by cell with a rebalance, which splits a cell that holds more than a file should, so a vector
    that a third of all rows share is no task of its own. Null, zero and misfit vectors are in no cell. Where the corpus
    is empty, both tables are.
    """
    spark = corpus.sparkSession
    if cells is None:
        cells = min(4096, max(2, int(corpus.count() ** 0.5)))
    centers = centroids(corpus, cells, vector, sample)
    shared = spark.sparkContext.broadcast(centers)
    kinds = dict(corpus.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = shared.value
        for batch in batches:
            fit, unit = matrix(batch.column("v"), sides.shape[1])
            if not len(fit) or not len(sides):
                continue
            sims = unit @ sides.T
            cell = sims.argmax(axis=1)
            away = np.linalg.norm(unit - sides[cell], axis=1)
            kept = batch.take(pa.array(fit))
            yield pa.RecordBatch.from_arrays([kept.column("c"), kept.column("v"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["c", "v", "cell", "away"])

    rows = corpus.select(F.col(cid).alias("c"), F.col(vector).alias("v")).filter("v is not null and c is not null")
    held = rows.mapInArrow(assign, f"c {kinds[cid]}, v {kinds[vector]}, cell int, away double")
    if len(centers):
        held.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    else:
        held.limit(0).write.parquet(f"{folder}/rows")
        spark.createDataFrame([], "cell int, centroid array<double>, n long, radius double").write.parquet(f"{folder}/cells")
        return
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    sizes = spark.read.parquet(f"{folder}/rows").groupBy(F.col("cell").cast("int").alias("cell")).agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    middle.join(sizes, "cell").coalesce(1).write.parquet(f"{folder}/cells")


def search(queries: DataFrame, folder: str, k: int, probes: int = 8, exact: bool = False, qid: str = "query_id", cid: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of an inverted file for each query: (qid, cid, score, rank), as knn() gives them.

    The `probes` cells with the nearest centroids are read. With exact, so is every further cell whose centroid is closer
    than the k-th distance found plus the cell's radius; the result is then knn()'s, whatever the cells. Other cells are
    not read at all, as their number is part of their files' path. What is written meanwhile has k rows a query.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # bounded by build's `cells`
    rows = spark.read.parquet(f"{folder}/rows").select(F.col("cell").cast("int").alias("cell"), "c", "v")
    kinds = dict(queries.dtypes)[qid], dict(rows.dtypes)["c"]
    number, middle = np.array([r["cell"] for r in cells], dtype=np.int64), np.array([r["centroid"] for r in cells])
    radius = np.array([r["radius"] for r in cells])

    def read(asked: Asked, mask: np.ndarray) -> DataFrame:
        wanted = {int(number[i]): np.flatnonzero(mask[:, i]) for i in np.flatnonzero(mask.any(axis=0))}
        return _scan(rows.filter(F.col("cell").isin(list(wanted))), asked, k, kinds, wanted)

    parts = []
    with Kept(spark) as kept:
        for asked in blocks(queries, qid, vector) if len(cells) else ():
            away = np.sqrt(np.maximum(0.0, 2 - 2 * asked.vectors @ middle.T))
            mask = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(mask, np.argsort(away, axis=1, kind="stable")[:, :probes], True, axis=1)
            first = read(asked, mask)
            if not exact:
                parts.append(first)
                continue
            first = kept.keep(_top(first, k))
            bound = {r["q"]: r["sim"] for r in first.filter(F.col("rank") == k).select("q", "sim").collect()}  # a row for each query of the block
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * np.array([bound.get(q, -1.0) for q in asked.ids]))) + 1e-6
            more = (away - radius < reach[:, None]) & ~mask
            parts.append(first.drop("rank") if not more.any() else first.drop("rank").unionByName(read(asked, more)))
        return kept.settled(_ranked(_together(parts, spark, kinds), k, qid, cid))


def recall(found: DataFrame, truth: DataFrame, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """(qid, wanted, hits) of each query of truth: how many of its neighbours were found."""
    hit = found.select(qid, cid, F.lit(1).alias("hit")).dropDuplicates([qid, cid])
    return truth.join(hit, [qid, cid], "left").groupBy(qid).agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
