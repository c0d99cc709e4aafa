"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact sorted-array intersection.

Documents with equal shingle sets are one set. Two sets that reach the similarity t share at least l shingles of their
prefixes, the first n - ceil(t n) + l shingles in any one global order (l grows with the smaller set). Shingles that a
sample shows to be frequent come last in the order; the order never changes the result.

1. Prefix shingles are counted in packed blocks. A shingle counts for a set if another set of fitting size has it; sets
   with fewer such shingles than l link with nothing and are left out. The rest keep all but their l - 1 most frequent.
2. Each set is compared exactly with the set that heads most of its shingle groups; components of these links follow.
3. Sets that shared shingles connect are a group, as far as these are small; larger ones stay groups by shingle. Groups
   that still hold several components are cut into tiles by size. A tile proposes pairs of different components
   whose parity bitmaps allow the overlap, but only as many as would join them all; these are compared exactly, and
   groups with a refuted pair go round again, with twice as many proposals, until no tile proposes any.

Bitmaps have a width by size band; with x differing bits two sets share at most (|A| + |B| - x) / 2 shingles. All
pairs that these bounds let through are compared by intersecting sorted arrays. At the end each pair that can link is
compared, excluded by a bound, or connected otherwise, so the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import Scratch, components, cut, mix64, parts, shingles, signed, small_batches, word_hashes

_U = np.uint64
#: Rows of one side of a tile or members compared with one array in a task, bits of the widest bitmap, tasks of a frequent shingle.
TILE, WIDEST, SALTS = 1024, 16384, 64
#: Sets that shingles connect and that are compared as one group, so that a set travels once and not once a shingle.
CLUSTER = 4 * TILE
#: Shingles of a set per further shingle that two sets must share.
SPARE = 40
#: Postings packed into blocks at once, and the size that a frequent shingle's group counts as.
PACKED, FREQUENT = 300_000, 1 << 30
#: Positions of the filter of frequent shingles: what the sample may hold, at most (64 MB), and those of one slice.
SAMPLED, POSITIONS, SLICE = 1 << 28, 1 << 29, 1 << 16
#: Rows that may be broadcast as a list of wanted sets.
WANTED = 100_000


def _ceil_share(n, t: Fraction):
    return -(-n * t.numerator // t.denominator)


def _needed(a, b, t: Fraction):
    """Least overlap of sets of a and b shingles with Jaccard similarity t or more: ceil(t (a + b) / (1 + t))."""
    return -(-(a + b) * t.numerator // (t.numerator + t.denominator))


def _prefix_size(n: int, t: Fraction) -> int:
    return min(n, n - _ceil_share(n, t) + 1 + n // SPARE)


def _least_shared(n: Column, t: Fraction) -> Column:
    """Prefix shingles that a set of n shares with each set it links with: one, and one for each SPARE of the least partner's."""
    return F.floor(n * t.numerator / F.lit(t.denominator * SPARE)).cast("int") + 1


def signature(values: np.ndarray) -> int:
    """64 bits that identify a set of shingles, given sorted."""
    return int(signed(mix64(np.bitwise_xor.reduce(mix64(values)) + mix64(values[-1:] + values.sum(dtype=_U))))[0])


def bitmap(values: np.ndarray) -> bytes:
    """Parity bitmap of a set; its width is twice the power of two that ends the set's size band, from 64 to WIDEST bits."""
    bits = min(WIDEST, max(64, 2 << (len(values) - 1).bit_length()))
    odd = np.bincount((mix64(values) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    """Narrower parity bitmaps: bit i of the result is the parity of the bits i, i + width, ..."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"sig": batch["sig"], "bits": [bitmap(np.frombuffer(v, dtype=_U)) for v in batch["v"]]})


@dataclass(frozen=True)
class Frequent:
    """A filter of shingles, one bit each, lowest bit first; the number of bits is a power of two."""

    bits: np.ndarray

    def among(self, values: np.ndarray) -> np.ndarray:
        at = (values & _U(len(self.bits) * 8 - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def frequent_shingles(texts: DataFrame, k: int, rows: int, total: int, sample_rows: int) -> Frequent:
    """The shingles that several documents of a sample have, and some others; only the order of prefixes uses them.

    texts: id, text; rows and total: documents and shingles of all of them. The sample holds a tenth of the documents,
    sample_rows at least, and SAMPLED shingles at most. Positions travel as two bytes inside slices; a position counts
    from so many documents on that fewer than one in 50 gets there by chance.
    """
    share = min(1.0, max(0.1, sample_rows / max(1, rows)), SAMPLED / max(1, total))
    size = min(POSITIONS, max(SLICE, 1 << math.ceil(math.log2(8 * share * total + 1))))
    load = share * total / size
    least = next(c for c in range(3, 1000) if 1 - sum(math.exp(-load) * load**i / math.factorial(i) for i in range(c)) < 0.02)
    drawn = texts.filter(F.pmod(F.xxhash64("id", F.lit("order")), F.lit(1_000_000)) < F.lit(share * 1_000_000))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.concatenate([np.empty(0, dtype=_U), *[shingles(word_hashes(t), k) for t in batch["text"]]]) & _U(size - 1)
            at, n = np.unique(own, return_counts=True)
            at = np.repeat(at, np.minimum(n, least)).astype(np.int64)
            slices, first = np.unique(at // SLICE, return_index=True)
            yield pd.DataFrame({"slice": slices.astype(np.int32), "low": [p.tobytes() for p in np.split((at % SLICE).astype(np.uint16), first[1:])][: len(slices)]})

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(np.concatenate([np.frombuffer(b, dtype=np.uint16) for b in group["low"]]), minlength=SLICE)
        return pd.DataFrame({"slice": group["slice"][:1], "bits": [np.packbits(n >= least, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    for row in drawn.select("text").mapInPandas(placed, "slice int, low binary").groupBy("slice").applyInPandas(counted, "slice int, bits binary").collect():
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return Frequent(out)


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, sig) per document; sig identifies its shingle set and is null for an empty one."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(word_hashes(body), k) for body in batch["text"]]
            # a plain column of integers and None would pass through floats and lose digits
            yield pd.DataFrame({"id": batch["id"], "n": np.array([len(v) for v in own], dtype=np.int64), "sig": pd.array([signature(v) if len(v) else None for v in own], dtype="Int64")})

    return texts.mapInPandas(build, f"id {dict(texts.dtypes)['id']}, n long, sig long")


def shared_prefixes(texts: DataFrame, k: int, threshold: Fraction, frequent, tasks: int) -> DataFrame:
    """(key, sig, n, size) of the prefix shingles that another set of fitting size has as well; size counts the sets with the shingle.

    Postings travel in blocks of arrays, each set once in a block. A frequent shingle is dealt over SALTS tasks; its
    sets are all kept, and its size is FREQUENT.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def blocks() -> pd.DataFrame:
            counts = [len(v) for v, _ in held.values()]
            keys = np.concatenate([v for v, _ in held.values()])
            sigs, ns = np.repeat(np.array(list(held), dtype=np.int64), counts), np.repeat(np.array([n for _, n in held.values()], dtype=np.int32), counts)
            hot = frequent.value.among(keys)
            deal = ((keys >> _U(32)).astype(np.int64) + np.where(hot, sigs % SALTS, 0)) % tasks
            place = deal * 2 + hot
            order = np.argsort(place, kind="stable")
            found, first = np.unique(place[order], return_index=True)
            cut_up = lambda a: [p.tobytes() for p in np.split(a[order], first[1:])]
            return pd.DataFrame({"task": (found // 2).astype(np.int32), "hot": found % 2 == 1, "keys": cut_up(keys), "sigs": cut_up(sigs), "ns": cut_up(ns)})

        for batch in batches:
            for body in batch["text"]:
                values = shingles(word_hashes(body), k)
                if not len(values) or (sig := signature(values)) in held:
                    continue
                hot = frequent.value.among(values)
                held[sig] = np.concatenate((values[~hot], values[hot]))[: _prefix_size(len(values), threshold)], len(values)
                size += len(held[sig][0])
                if size > PACKED:
                    yield blocks()
                    held, size = {}, 0
        if held:
            yield blocks()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: list[tuple] = []
        for batch in batches:
            for hot, keys, sigs, ns in zip(batch["hot"], batch["keys"], batch["sigs"], batch["ns"], strict=True):
                key = np.frombuffer(keys, dtype=np.int64)
                got.append((key, np.frombuffer(sigs, dtype=np.int64), np.frombuffer(ns, dtype=np.int32), np.full(len(key), hot)))
        if not got:
            return
        key, sig, n, hot = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order = np.lexsort((sig, n, key))
        key, sig, n, hot = key[order], sig[order], n[order], hot[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])))
        key, sig, n, hot = key[once], sig[once], n[once], hot[once]
        fits = np.concatenate(([False], (key[1:] == key[:-1]) & (n[:-1].astype(np.int64) * threshold.denominator >= n[1:].astype(np.int64) * threshold.numerator), [False]))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        keep = np.flatnonzero(fits[:-1] | fits[1:] | hot)
        for at in np.array_split(keep, 1 + len(keep) // PACKED):
            yield pd.DataFrame({"key": key[at], "sig": sig[at], "n": n[at], "size": np.where(hot[at], FREQUENT, size[at]).astype(np.int32)})

    dealt = texts.select("text").mapInPandas(packed, "task int, hot boolean, keys binary, sigs binary, ns binary").repartition(tasks, "task")
    return dealt.mapInPandas(counted, "key long, sig long, n int, size int")


#: Bits of a membership filter; it takes 8 MB whatever the table's size.
FILTER_BITS = 1 << 26


def _filter(values: DataFrame, column: str) -> np.ndarray:
    """Bits, one hash each, of the values of a long column: those not in it are surely not among the values."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    buckets = values.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(FILTER_BITS // 8 + 8192, dtype=np.uint8)
    for row in buckets.toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out[row["b"] * 4096 : row["b"] * 4096 + len(part)] = part
    return out


def _place(column: str) -> Column:
    """Where to look a value up in a filter: byte and bit as one number."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    return F.bitmap_bucket_number(place) * 32768 + F.bitmap_bit_position(place)


def _maybe(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _arrays(texts: DataFrame, sets: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(sig, v) of the chosen signatures and a few others: the sorted shingles as bytes; some sets repeatedly.

    Only representatives of chosen sets are turned into arrays: a filter of their keys passes over the rest.
    """
    held = texts.sparkSession.sparkContext.broadcast(_filter(sets.join(chosen, "sig", "left_semi"), "rep"))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(word_hashes(t), k) for t in batch["text"][_maybe(held.value, batch["place"].to_numpy())]]
            own = {signature(v): v.tobytes() for v in found if len(v)}
            yield pd.DataFrame({"sig": np.array(list(own), dtype=np.int64), "v": list(own.values())})

    return texts.select(_place("id").alias("place"), "text").mapInPandas(values, "sig long, v binary")


def _exact(pairs: DataFrame, arrays: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of signatures whose sets reach the threshold.

    The array of a meets those of its partners in blocks of about TILE, so a set with many partners is dealt over tasks.
    """
    spark = pairs.sparkSession
    rows = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    held = arrays.join(F.broadcast(wanted) if 2 * rows <= WANTED else wanted, "sig", "left_semi")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    sided = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(3)), F.col("blocks")).cast("int").alias("block"))
    members = sided.join(held.withColumnRenamed("sig", "b"), "b").select("a", "block", F.lit(1).alias("part"), "b", "v")
    owners = sided.select("a", "block").distinct().join(held.withColumnRenamed("sig", "a"), "a").select("a", "block", F.lit(0).alias("part"), F.col("a").alias("b"), "v")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.empty(0, dtype=_U)
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (part, v) in enumerate(zip(batch["part"], batch["v"], strict=True)):
                values = np.frombuffer(v, dtype=_U)
                if part == 0:
                    own = values
                    continue
                both = len(np.intersect1d(own, values, assume_unique=True))
                keep[i] = both * threshold.denominator >= threshold.numerator * (len(own) + len(values) - both)
            yield batch.loc[keep, ["a", "b"]]

    met = owners.unionByName(members).repartition(parts(spark), "a", "block").sortWithinPartitions("a", "block", "part")
    return met.mapInPandas(linked, "a long, b long")


def _allows(na, nb, differ, threshold: Fraction):
    """Whether sets of these sizes, with so many differing bits, can reach the threshold."""
    return (na + nb - differ) // 2 >= _needed(na, nb, threshold)


def _spanning(rows: list[tuple], threshold: Fraction, forests: int = 1) -> Iterator[tuple[int, int]]:
    """Pairs of a tile, rows (side, sig, comp, n, bits, refuted), that may link different components.

    Rows are taken by size. A pair is left out if the pairs before it join its ends in each of so many forests, so a
    tile yields at most `forests` pairs for each row; refuted lists signatures that are known not to link with the row.
    """
    rows = sorted(rows, key=lambda r: r[3])
    side, sig, comp, n = (np.array([r[f] for r in rows], dtype=np.int64) for f in range(4))
    refuted = [frozenset(r[5]) if r[5] is not None else frozenset() for r in rows]
    joined = np.tile(comp, (forests, 1))
    widths = np.array([len(r[4]) for r in rows])
    bands = {w: (np.flatnonzero(widths == w), np.frombuffer(b"".join(r[4] for r in rows if len(r[4]) == w), dtype=np.uint8).reshape(-1, w)) for w in np.unique(widths)}
    last = np.searchsorted(n * threshold.numerator, n * threshold.denominator, side="right")
    for i in range(len(rows)):
        if last[i] <= i + 1 or (joined[:, i + 1 : last[i]] == joined[:, i : i + 1]).all():
            continue
        own = np.frombuffer(rows[i][4], dtype=np.uint8)[None]
        for w, (at, bits) in bands.items():
            inside = (at > i) & (at < last[i]) & (comp[at] != comp[i])
            if side[i] >= 0:
                inside &= side[at] != side[i]
            fit = np.flatnonzero(inside)
            fit = fit[(joined[:, at[fit]] != joined[:, i : i + 1]).any(axis=0)]
            if not len(fit):
                continue
            width = min(w, own.shape[1])
            differ = np.bitwise_count(_fold(bits[fit], width) ^ _fold(own, width)).sum(axis=1, dtype=np.int64)
            for j in at[fit[_allows(n[i], n[at[fit]], differ, threshold)]].tolist():
                free = np.flatnonzero(joined[:, j] != joined[:, i])
                if not len(free) or int(sig[j]) in refuted[i]:
                    continue
                yield min(int(sig[i]), int(sig[j])), max(int(sig[i]), int(sig[j]))
                line = joined[free[0]]
                line[line == line[j]] = line[i]


def _tile_pairs(threshold: Fraction, forests: int):
    """Reads rows sorted by (key, tile); yields (key, a, b) for the pairs of each tile."""

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, rows = (None, None), []
        table = lambda found: pd.DataFrame(found, columns=["key", "a", "b"], dtype="int64")
        for batch in batches:
            found: list[tuple] = []
            for key, tile, *row in batch.itertuples(index=False, name=None):
                if (key, tile) != mark:
                    found += [(mark[0], *pair) for pair in _spanning(rows, threshold, forests)] if len(rows) > 1 else []
                    mark, rows = (key, tile), []
                rows.append(row)
            yield table(found)
        if len(rows) > 1:
            yield table([(mark[0], *pair) for pair in _spanning(rows, threshold, forests)])

    return tiles


def _banded(kept: DataFrame, threshold: Fraction) -> DataFrame:
    """(key, sig, n) of the groups with several sets; a group of more than TILE is cut into bands of sizes that fit, each with the next."""
    sizes = kept.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    band = F.floor(F.log(F.col("n")) / (-math.log(threshold) * (1 + 1e-9)))
    both = F.when(F.col("size") > TILE, F.array(band, band - 1)).otherwise(F.array(F.lit(None).cast("long")))
    dealt = kept.join(sizes, "key").select("key", "sig", "n", F.explode(both).alias("band"))
    return dealt.select(F.when(F.col("band").isNull(), F.col("key")).otherwise(F.xxhash64("key", "band")).alias("key"), "sig", "n")


def _clustered(live: DataFrame, stars: DataFrame) -> DataFrame:
    """live with each set once where it can: sets that shingles connect are one group if they are CLUSTER at most, else groups stay."""
    found = components(stars.select(F.col("head").alias("a"), F.col("sig").alias("b")))
    small = found.join(found.groupBy("root").count().filter(F.col("count") <= CLUSTER), "root").select(F.col("node").alias("sig"), F.col("root").alias("cluster"))
    return live.join(small, "sig", "left").select(F.coalesce("cluster", "key").alias("key"), "sig", "n").distinct()


def _tiles(live: DataFrame, roots: DataFrame, bits: DataFrame, refuted: DataFrame) -> DataFrame:
    """(key, tile, side, sig, comp, n, bits, refuted) of the groups that still hold several components, sorted by tile.

    A group of more than TILE rows is cut into blocks, and each pair of blocks is a tile of its own.
    """
    labelled = live.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "n", F.coalesce("root", "sig").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    members = labelled.join(mixed.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("sig", F.lit(7)), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    tiled = spread.select("key", (i * 100_000 + j).cast("long").alias("tile"), F.when(i == j, -1).when(F.col("block") == i, 0).otherwise(1).alias("side"), "sig", "comp", "n")
    both = refuted.select(F.col("a").alias("sig"), "b").union(refuted.select("b", "a")).groupBy("sig").agg(F.collect_set("b").alias("refuted"))
    known = bits.join(both, "sig", "left")
    return tiled.join(known, "sig").select("key", "tile", "side", "sig", "comp", "n", "bits", "refuted").repartition(parts(live.sparkSession), "key", "tile").sortWithinPartitions("key", "tile")


def _extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links (a, b) between signatures."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    fresh = components(between)
    moved = roots.join(fresh.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return moved.unionByName(fresh.join(roots, "node", "left_anti"))


def _joined(texts: DataFrame, k: int, limit: Fraction, sample_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts (id, text): (id, n, sig) of each, the least id of each set, and the components (node, root) of linked sets."""
    spark = texts.sparkSession
    rows = cut(shingle_sets(texts, k))
    sets = cut(rows.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("rep")))
    counted = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, k, counted["rows"], counted["total"], sample_rows))
    entries = shared_prefixes(texts, k, limit, frequent, parts(spark))
    own = Window.partitionBy("sig")
    least, met = _least_shared(F.col("n"), limit), F.col("met")
    ranked = entries.withColumn("met", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy("size", "key")))
    kept = cut(ranked.filter((met >= least) & (F.col("nth") <= met - least + 1)).select("key", "sig", "n"))
    frequent.destroy()
    with Scratch(spark) as scratch:
        live = scratch.keep(_banded(kept, limit))
        arrays = scratch.keep(_arrays(texts, sets, live.select("sig").distinct(), k))
        bits = scratch.keep(arrays.mapInPandas(_bitmaps, "sig long, bits binary").dropDuplicates(["sig"]))
        heads = live.groupBy("key").agg(F.min("sig").alias("head"))
        stars = scratch.keep(live.join(heads, "key").filter("sig <> head").groupBy("head", "sig").agg(F.count("*").alias("met")))
        live = scratch.keep(_clustered(live, stars))
        asked = scratch.keep(stars.groupBy(F.col("sig").alias("b")).agg(F.max_by("head", F.struct("met", "head")).alias("a")).select("a", "b"))
        links = scratch.keep(_exact(asked, arrays, limit))
        roots = scratch.keep(components(links))
        refuted = scratch.keep(asked.join(links, ["a", "b"], "left_anti"))
        forests = 1
        while True:
            proposed = scratch.keep(_tiles(live, roots, bits, refuted).mapInPandas(_tile_pairs(limit, forests), "key long, a long, b long"))
            asked = scratch.keep(proposed.select("a", "b").distinct())
            if asked.isEmpty():
                break
            links = scratch.keep(_exact(asked, arrays, limit))
            wrong = scratch.keep(asked.join(links, ["a", "b"], "left_anti"))
            roots = scratch.keep(_extended(roots, links))
            # a group whose pairs all hold is joined as far as it can be; only groups with a refuted pair go round again
            live = scratch.keep(live.join(proposed.join(wrong, ["a", "b"], "left_semi").select("key").distinct(), "key", "left_semi"))
            refuted = scratch.keep(refuted.union(wrong))
            forests *= 2
        return rows, sets, cut(roots)


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, threshold: str = "0.85", sample_rows: int = 20000) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key reachable by links, its own included).

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when the Jaccard similarity of their
    sets of k-word shingles is at least threshold (decimal text, kept exact). A text with fewer words is one shingle;
    a null, empty or blank text has an empty set, n_shingles 0, links with nothing and is its own component. Repeated
    rows stay repeated rows. A null key is passed over by the minimum; such a row links through the keyed rows that
    share its set. An empty table gives an empty result; other columns are not used. Very long texts are taken whole.
    Only the order of prefixes depends on a sample; the result does not.
    """
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        rows, sets, roots = _joined(texts, k, Fraction(threshold), sample_rows)
    owner = sets.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    named = owner.join(owner.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("sig", "component_id")
    return rows.join(named, "sig", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
