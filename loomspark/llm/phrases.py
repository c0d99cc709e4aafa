"""Phrases of words that occur together, counted with position bitmaps.

Texts are laid out in shards: every word of a shard has a place, and pieces are kept apart by a place without a word. A
word's places are a bitmap of 16-bit blocks of which only those with a bit are stored. Shifted by one place and ANDed with
a word's bitmap, a phrase's bitmap is that of the phrase longer by the word; its bits are counted and summed over shards.
Words, then pairs, that are too rare in all shards together never extend a phrase, nor do triples at whose hashed position
all triples together are too rare; what is left is extended depth-first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import Scratch, bound_batches, cut, mix64
from loomspark.llm.running import running

#: Places of a shard, but for what its last document has beyond them.
SHARD = 1 << 20
#: Entries of bitmaps that are extended together: a group of first words is taken to its longest phrases before the next.
GROUP = 1 << 16
#: Phrases that a task sums over its shards before it hands them on, and shards that such a task has, about.
HELD, SUMMED = 1 << 21, 12
#: Positions that triples are hashed to: at most (32 MB of bits), and those of one slice.
POSITIONS, SLICE = 1 << 28, 1 << 16
#: Rows, and bytes of words, that are broadcast at most.
SMALL, SMALL_BYTES = 1 << 21, 64 << 20
#: Marks that end a piece, and capitals: what becomes a line feed, a space or a small letter.
_LETTERS = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b in (9, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def to_varint(values: np.ndarray) -> bytes:
    """Seven bits a byte, lowest first; the last byte of a value has no high bit."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >> np.uint64(7 * i)) > 0 for i in range(1, 5)).astype(np.int64)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for i in range(5):
        has = size > i
        more = np.where(size[has] > i + 1, 128, 0)
        out[ends[has] - size[has] + i] = ((v[has] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out.tobytes()


def from_varint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    if not len(ends):
        return np.empty(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    out, more = (raw[starts] & 127).astype(np.int64), ends - starts
    for i in range(1, int(more.max())):
        has = more > i
        out[has] |= (raw[starts[has] + i] & 127).astype(np.int64) << (7 * i)
    return out


class _Ids(dict):
    """Numbers of a group's words in a shard; a mark is 0, nothing is -1."""

    def __init__(self, group: str, names: list) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.group, self.names = group, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.group, word))
        self[word] = len(self.names)
        return len(self.names)


def bitmaps(places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's word at each place (0: none, 1 to words): occurrences and entries of each word, and its blocks and their bits."""
    at = np.flatnonzero(places)
    word = places[at] - 1
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    block = at >> 4
    new = np.ones(len(at), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    bits = np.bitwise_or.reduceat(np.uint16(1) << (at & 15).astype(np.uint16), first) if len(first) else np.empty(0, dtype=np.uint16)
    return np.bincount(word, minlength=words), np.bincount(word[first], minlength=words), block[first], bits


def _gaps(block: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks of each word as differences; the first stands as it is."""
    out = np.diff(block, prepend=0)
    starts = np.cumsum(entries) - entries
    starts = starts[entries > 0]
    out[starts] = block[starts]
    return out


def _blocks(gaps: np.ndarray, entries: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps)
    starts = np.cumsum(entries) - entries
    base = np.zeros(len(entries), dtype=np.int64)
    some = entries > 0
    base[some] = total[starts[some]] - gaps[starts[some]]
    return total - np.repeat(base, entries)


def _position(ahead: np.ndarray, third: np.ndarray, size: int) -> np.ndarray:
    """Position of triples, given the hash of the first two words."""
    return (mix64(ahead + third.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _ahead(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))


def _added(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position once with its sum."""
    found, which = np.unique(at, return_inverse=True)
    return found, np.bincount(which, n, minlength=len(found)).astype(np.int64)


class Shard:
    """The bitmaps of a shard's frequent words, found by block."""

    def __init__(self, words: np.ndarray, entries: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
        self.names, self.entries = words, entries
        self.word, self.block, self.bits = np.repeat(np.arange(len(words), dtype=np.int32), entries), block, bits
        order = np.argsort(block, kind="stable")
        self.by_word, self.by_bits = self.word[order], bits[order]
        last = int(block.max()) if len(block) else 0
        self.count = np.bincount(block, minlength=last + 2).astype(np.int32)
        self.start = np.cumsum(self.count, dtype=np.int32) - self.count

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, word, block, bits): the bitmaps shifted by one place and ANDed with those of all words."""
        moved = bits.astype(np.uint32) << 1
        out = []
        for value, ahead in ((moved & 0xFFFF, 0), (moved >> 16, 1)):
            has = value > 0
            p, b, v = phrase[has], block[has] + ahead, value[has].astype(np.uint16)
            n = self.count[b]
            at = np.arange(n.sum(), dtype=np.int32) + np.repeat(self.start[b] - (np.cumsum(n, dtype=np.int32) - n), n)
            both = np.repeat(v, n) & self.by_bits[at]
            met = both > 0
            out.append((np.repeat(p, n)[met], self.by_word[at[met]], np.repeat(b, n)[met], both[met]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def groups(self) -> Iterator[slice]:
        """Ranges of entries of whole words, of about GROUP entries."""
        ends = np.cumsum(self.entries)
        at = 0
        while at < len(self.block):
            to = int(ends[np.searchsorted(ends, min(at + GROUP, len(self.block)))])
            yield slice(at, to)
            at = to

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, second words and counts of all pairs."""
        keys, counts = [], []
        for part in self.groups():
            first, second, _, both = self.extended(self.word[part], self.block[part], self.bits[part])
            key, which = np.unique(first.astype(np.int64) * len(self.names) + second, return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(which, np.bitwise_count(both)).astype(np.int64))
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        return self.names[key // max(1, len(self.names))], self.names[key % max(1, len(self.names))], np.concatenate(counts) if counts else key

    def _allowed(self, pairs: tuple) -> np.ndarray:
        """Those of the pairs whose words are here, as sorted numbers."""
        first, second = pairs
        order = np.argsort(self.names)
        local = lambda x: order[np.minimum(np.searchsorted(self.names, x, sorter=order), len(order) - 1)]
        one, two = local(first), local(second)
        here = (self.names[one] == first) & (self.names[two] == second)
        return np.sort(one[here].astype(np.int64) * len(self.names) + two[here])

    def _met(self, keys: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        return allowed[np.minimum(np.searchsorted(allowed, keys), len(allowed) - 1)] == keys

    def triples(self, pairs: tuple, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and counts of the phrases of three words whose pairs are among those."""
        if not len(self.names) or not len(allowed := self._allowed(pairs)):
            return
        for part in self.groups():
            before, word, block, bits = self.extended(self.word[part], self.block[part], self.bits[part])
            keep = self._met(before.astype(np.int64) * len(self.names) + word, allowed)
            key, phrase = np.unique(before[keep].astype(np.int64) * len(self.names) + word[keep], return_inverse=True)
            before, word, _, bits = self.extended(phrase, block[keep], bits[keep])
            last = key % len(self.names)
            keep = self._met(last[before] * len(self.names) + word, allowed)
            ahead = _ahead(self.names[key // len(self.names)], self.names[last])
            yield _added(_position(ahead[before[keep]], self.names[word[keep]], size), np.bitwise_count(bits[keep]))

    def longer(self, pairs: tuple, often: np.ndarray | None, sizes: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of sizes[0] to sizes[1] words, all of whose pairs are among those, and triples at positions that are set, if given, and their counts."""
        if not len(self.names) or not len(allowed := self._allowed(pairs)):
            return
        for part in self.groups():
            phrase, block, bits = self.word[part], self.block[part], self.bits[part]
            path = np.arange(len(self.names))[:, None]
            for size in range(2, sizes[1] + 1):
                before, word, block, bits = self.extended(phrase, block, bits)
                keep = np.flatnonzero(self._met(path[before, -1].astype(np.int64) * len(self.names) + word, allowed))
                if often is not None and size > 2:
                    ahead = _ahead(self.names[path[:, -2]], self.names[path[:, -1]])
                    at = _position(ahead[before[keep]], self.names[word[keep]], 8 * len(often))
                    keep = keep[(often[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                before, word, block, bits = before[keep], word[keep], block[keep], bits[keep]
                key, phrase = np.unique(before.astype(np.int64) * len(self.names) + word, return_inverse=True)
                if not len(key):
                    break
                path = np.column_stack([path[key // len(self.names)], key % len(self.names)])
                if size >= sizes[0]:
                    yield self.names[path], np.bincount(phrase, np.bitwise_count(bits)).astype(np.int64)


_SHARDS = "shard long, words array<struct<lang:string, word:string, n:long>>, entries binary, gaps binary, bits binary"


def shards(docs: DataFrame, text: Column | str = "text", lang: Column | str = "lang") -> DataFrame:
    """Bitmaps of all words, one row for each shard; null texts are empty, a null lang is und.

    Shards are numbered by task: the rows are written as they come, before anything else is done with them.
    """
    body = (F.col(text) if isinstance(text, str) else text).cast("binary")
    named = F.coalesce(F.col(lang) if isinstance(lang, str) else lang, F.lit("und"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        names, ids, laid, size = [], {}, [], 0

        def shard() -> pa.RecordBatch:
            counts, entries, block, bits = bitmaps(np.concatenate(laid), len(names))
            words = pa.StructArray.from_arrays([pa.array([g for g, _ in names]), pa.array([w for _, w in names], type=pa.binary()).cast(pa.string()), pa.array(counts, type=pa.int64())], names=["lang", "word", "n"])
            row = [pa.array([(part << 24) + made]), pa.ListArray.from_arrays(pa.array([0, len(names)], type=pa.int32()), words)]
            row += [pa.array([x], type=pa.binary()) for x in (to_varint(entries), to_varint(_gaps(block, entries)), zlib.compress(bits, 1))]
            return pa.RecordBatch.from_arrays(row, names=["shard", "words", "entries", "gaps", "bits"])

        for batch in batches:
            for raw, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group not in ids:
                    ids[group] = _Ids(group, names)
                own = ids[group]
                found = (raw.translate(_LETTERS) + b"\n").replace(b"\n", b" \n ").split(b" ")
                places = np.fromiter(map(own.__getitem__, found), dtype=np.int64, count=len(found))
                laid.append(places[places >= 0])
                size += len(laid[-1])
                if size >= SHARD:
                    yield shard()
                    made, names, ids, laid, size = made + 1, [], {}, [], 0
        if names:
            yield shard()

    return docs.select(F.coalesce(body, F.lit("").cast("binary")).alias("text"), named.alias("lang")).mapInArrow(lay_out, _SHARDS)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Shard]]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        entries = from_varint(row["entries"].as_py())
        block, bits = _blocks(from_varint(row["gaps"].as_py()), entries).astype(np.int32), np.frombuffer(zlib.decompress(row["bits"].as_py()), dtype=np.uint16)
        yield i, Shard(row["ids"].values.to_numpy(zero_copy_only=False), entries, block, bits)


def _frequent_only(shared=None):
    """The bitmaps of shards' frequent words alone: of those shared (names, ids), or of each row's own (place, id)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("shard", "ids", "entries", "gaps", "bits")}
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if shared:
                    names, numbers = shared.value
                    words = row["words"].values
                    at = pc.index_in(_named(words.field("lang"), words.field("word")), names)
                    place = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    ids = numbers[at.drop_null().to_numpy()]
                else:
                    place, ids = (row["kept"].values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "id"))
                    order = np.argsort(place)
                    place, ids = place[order], ids[order]
                entries, gaps, bits = from_varint(row["entries"].as_py()), from_varint(row["gaps"].as_py()), np.frombuffer(zlib.decompress(row["bits"].as_py()), dtype=np.uint16)
                keep = np.zeros(len(entries), dtype=bool)
                keep[place] = True
                which = np.repeat(keep, entries)
                for c, v in zip(out, (row["shard"].as_py(), ids, to_varint(entries[keep]), to_varint(gaps[which]), zlib.compress(bits[which], 1)), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return kept


def _named(lang: pa.Array, word: pa.Array) -> pa.Array:
    """A word with its lang before it; a word has no tab."""
    return pc.binary_join_element_wise(lang, word, "\t")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, shard in _opened(batch):
            first, second, n = shard.pairs()
            for at in range(0, len(n), 1 << 16):
                part = slice(at, at + (1 << 16))
                number = np.full(len(n[part]), batch.column("shard")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, first[part], second[part], n[part])], names=["shard", "first", "second", "n"])


def _hashed(shared, size: int, most: int):
    """Counts of triples by position, up to `most` a task, in slices of positions."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _added(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            for _, shard in _opened(batch):
                for found in shard.triples(shared.value, size):
                    held.append(found)
                    waiting += len(found[0])
                    if waiting > HELD:
                        held, waiting = [merged()], 0
        at, n = merged()
        slices, first = np.unique(at // SLICE, return_index=True)
        cut_up = lambda a: pa.array([p.tobytes() for p in np.split(a, first[1:])][: len(slices)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(slices), cut_up((at % SLICE).astype(np.uint16)), cut_up(np.minimum(n, most).astype(np.uint8))], names=["slice", "low", "n"])

    return triples


def often_met(held: DataFrame, shared, words: int, least: int) -> np.ndarray:
    """Bits of the positions whose triples occur `least` times together; of a triple that does, the bit is set. shared: the frequent pairs."""
    size, most = min(POSITIONS, max(SLICE, 1 << max(0, words // 4).bit_length())), min(least, 255)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        at, n = (np.concatenate([np.frombuffer(b, dtype=kind) for b in group[c]]) for c, kind in (("low", np.uint16), ("n", np.uint8)))
        return pd.DataFrame({"slice": group["slice"][:1], "bits": [np.packbits(np.bincount(at, n, minlength=SLICE) >= most, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    hashed = held.mapInArrow(_hashed(shared, size, most), "slice long, low binary, n binary")
    for row in hashed.groupBy("slice").applyInPandas(summed, "slice long, bits binary").toLocalIterator():
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def _extend(sizes: tuple[int, int], shared=None):
    """Phrases of shards with so many words whose pairs and triples are among those shared, or whose pairs are the row's own."""

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for i, shard in _opened(batch):
                own = None if shared else batch.column("pairs")[i].values
                pairs, often = shared.value if shared else (tuple(own.field(c).to_numpy(zero_copy_only=False) for c in ("first", "second")), None)
                for phrases, n in shard.longer(pairs, often, sizes):
                    held.setdefault(phrases.shape[1], []).append((phrases, n))
                    size += len(n)
                if size > HELD:
                    yield from map(_listed, held.values())
                    held, size = {}, 0
        yield from map(_listed, held.values())

    return longer


def _listed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Phrases of one length, those of several shards once with the sum of their counts."""
    phrases, n = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.lexsort(phrases.T[::-1])
    phrases = phrases[order]
    first = np.flatnonzero(np.r_[True, (phrases[1:] != phrases[:-1]).any(axis=1)])
    phrases, n = np.ascontiguousarray(phrases[first]), np.add.reduceat(n[order], first)
    offsets = np.arange(len(n) + 1, dtype=np.int32) * phrases.shape[1]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(phrases.ravel())), pa.array(n)], names=["phrase", "n"])


def counted(docs: DataFrame, scratch: Scratch, least: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, sizes) of docs (text, lang), written to scratch.

    Up to SMALL frequent words and pairs go to all shards as they are; of more, each shard gets those that it has, by a join.

    words (lang, word, f, id) and phrases (phrase as an array of ids, f) of 1 to `most` words occur at least `least` times
    in their lang; sizes (lang, n) counts all occurrences of words.
    """
    bound_batches(docs.sparkSession)
    laid = scratch.written(shards(docs))
    laid_at = scratch.n
    each = laid.select("shard", F.posexplode("words").alias("place", "w")).select("shard", "place", "w.*")
    totals = scratch.keep(each.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    sizes = scratch.keep(totals.groupBy("lang").agg(F.sum("f").alias("n")))
    words = scratch.keep(running(totals.filter(F.col("f") >= least), ["lang", "word"], {"id": F.lit(1)}, scratch).withColumn("id", F.col("id").cast("int")))
    rows = "shard long, ids array<int>, entries binary, gaps binary, bits binary"
    count, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("word")), F.lit(0))).first()
    if count <= SMALL and size <= SMALL_BYTES:
        found = words.select("lang", "word", "id").toArrow().combine_chunks()
        names = _named(*(pa.concat_arrays(found.column(c).chunks) if found.column(c).num_chunks else pa.array([], type=pa.string()) for c in ("lang", "word")))
        shared = docs.sparkSession.sparkContext.broadcast((names, found.column("id").to_numpy()))
        held = scratch.written(laid.mapInArrow(_frequent_only(shared), rows))
    else:
        kept = each.join(words, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("kept"))
        held = scratch.written(laid.drop("words").join(kept, "shard").mapInArrow(_frequent_only(), rows))
    scratch.drop(laid_at)

    pairs = held.mapInArrow(_pairs, "shard long, first int, second int, n long")
    often = scratch.keep(pairs.groupBy("first", "second").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    summed = lambda found: scratch.keep(found.groupBy("phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    columns = lambda df, n: tuple(df.select(*[F.get("phrase", F.lit(i)).alias(str(i)) for i in range(n)]).toArrow().column(i).to_numpy() for i in range(n))
    kind, spark = "phrase array<int>, n long", docs.sparkSession
    if often.count() <= SMALL:
        known = columns(often.select(F.array("first", "second").alias("phrase")), 2)
        context, laid_out = spark.sparkContext, held.agg(F.count("*")).first()[0]
        marks = often_met(held, context.broadcast(known), sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least)
        # with more shards in a task a phrase is handed on fewer times
        longer = summed(held.coalesce(1 + laid_out // SUMMED).mapInArrow(_extend((3, most), context.broadcast((known, marks))), kind))
    else:
        there = pairs.join(often.select("first", "second"), ["first", "second"], "left_semi")
        there = there.groupBy("shard").agg(F.collect_list(F.struct("first", "second")).alias("pairs"))
        longer = summed(held.join(there, "shard").mapInArrow(_extend((3, most)), kind))
    phrases = words.select(F.array("id").alias("phrase"), "f").unionByName(often.select(F.array("first", "second").alias("phrase"), "f")).unionByName(longer)
    return words, phrases, sizes


def collocations(docs: DataFrame, least: int = 100, most: int = 5, k: int = 2000) -> DataFrame:
    """The k phrases of each lang whose words occur together most: (lang, rank, phrase, a, l, r, n, score).

    docs (text, lang; other columns are not read). a counts the phrase, at least `least` times, in all texts of the lang,
    within pieces. Of its cuts into two parts that occur l and r times the one with the lowest floor(1000 a n / (l r))
    counts, the first of several; n counts the lang's words. A phrase that always stands inside a longer one is left out.
    Ties of score are broken by a, descending, then by the phrase. An empty table gives no row.
    """
    with Scratch(docs.sparkSession) as scratch:
        words, phrases, sizes = counted(docs, scratch, least, most)
        phrases = scratch.keep(phrases)
        found = phrases.filter(F.size("phrase") > 1)
        # a longer phrase with as many occurrences has one longer by a word between, which has as many too
        inner = lambda at: F.slice("phrase", at, F.size("phrase") - 1).alias("phrase")
        inside = found.select(inner(1), "f").unionByName(found.select(inner(2), "f")).distinct()
        alone = found.join(inside, ["phrase", "f"], "left_anti")
        cuts = alone.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
        parts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase")).alias("right"))
        parts = parts.join(phrases.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
        first = words.select(F.col("id").alias("head"), "lang").join(F.broadcast(sizes), "lang")
        rated = parts.withColumn("head", F.col("phrase")[0]).join(first, "head")
        score = F.expr("(1000BD * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))").cast("long")
        rated = rated.select("phrase", "a", "lang", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        best = rated.groupBy("phrase", "a", "lang", "n").agg(F.min("cut").alias("cut"))
        spelt = best.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
        spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("said"))
        named = best.join(spelt, "phrase").select("lang", F.col("said").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return cut(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
