"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

Benchmark items are cut into short passages, documents into overlapping windows. A randomised SVD of the passages'
TF-IDF matrix, with power iterations summed over Spark partitions, gives a latent space; windows whose projection is
close to a passage's are candidates, and so is every place that shares a run of GRAM words, or the whole of a shorter
item. A candidate counts as a leak if the document around it has most of the item's words in order, and its answer.
Of an item's rarest words such a place has several, so only windows around these are projected and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import signed, word_hashes

_U = np.uint64
#: Words of a benchmark passage, of a document window, and between window starts.
PASSAGE, WINDOW, STRIDE = 16, 32, 16
#: Words of a run that makes a candidate by itself.
GRAM = 5
#: Words with a row of their own in the latent space, rows that all further words share, the rank, rows of one summed
#: slice, passages compared in one pass, blocks of STRIDE words projected at once.
OWN_ROWS, SHARED_ROWS, MAX_RANK, SLICE, BLOCK, BLOCKS = 32768, 32768, 128, 1024, 65536, 2048
#: Rare words of an item that a leak has at least, but for one; places of rare words that are looked at together.
SPARE, HITS = 3, 1 << 20


def passages(words: np.ndarray) -> list[np.ndarray]:
    """Passages of at most PASSAGE words, half overlapping; the last ends with the item."""
    if len(words) <= PASSAGE:
        return [words] if len(words) else []
    starts = [*range(0, len(words) - PASSAGE, PASSAGE // 2), len(words) - PASSAGE]
    return [words[s : s + PASSAGE] for s in starts]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order."""
    out = np.zeros(max(0, len(words) - n + 1), dtype=_U)
    for i in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return out


def _sieve(values: np.ndarray) -> np.ndarray:
    """A table of the low bits of hashes: what it hasn't is surely not among the values."""
    out = np.zeros(1 << max(10, (8 * len(values)).bit_length()), dtype=bool)
    out[values & _U(len(out) - 1)] = True
    return out


def _sifted(sieve: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the words that may be among the values of a sieve."""
    return np.flatnonzero(sieve[words & _U(len(sieve) - 1)])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of so many members: the range of each member, and its place in the range."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def lcs_length(mask_of: dict[int, int], length: int, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel; mask_of has the positions of each word of the pattern."""
    full = (1 << length) - 1
    state = full
    for word in words.tolist():
        hit = state & mask_of.get(word, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return length - state.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


@dataclass
class LatentSpace:
    """Sorted benchmark words, the row of each, the rows' weights and their part of the latent basis; the last row is for unknown words."""

    words: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    basis: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = _sieve(self.words)

    @property
    def unknown(self) -> int:
        return len(self.weight) - 1

    def columns(self, words: np.ndarray) -> np.ndarray:
        """Row of each word."""
        out = np.full(len(words), self.unknown, dtype=np.int64)
        if len(self.words):
            some = _sifted(self.sieve, words)
            at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
            met = self.words[at] == words[some]
            out[some[met]] = self.row[at[met]]
        return out

    def project(self, columns: np.ndarray) -> np.ndarray:
        """The sum of the weighted rows."""
        return (self.basis[columns] * self.weight[columns, None]).sum(axis=0)

    def windows(self, columns: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Unit vectors of the chosen windows of WINDOW words, of those that begin every STRIDE words; each row is read once."""
        halves, of = np.unique(np.concatenate((chosen, chosen + 1)), return_inverse=True)
        at = halves[:, None] * STRIDE + np.arange(STRIDE)
        rows = np.where(at < len(columns), columns[np.minimum(at, len(columns) - 1)], self.unknown)
        sums = np.einsum("ijk,ij->ik", self.basis[rows], self.weight[rows].astype(np.float32))[of]
        out = sums[: len(chosen)] + sums[len(chosen) :]
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def document_frequency(docs: DataFrame, words: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """Number of documents with each of the sorted words, over all documents, and of documents."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sieve = np.zeros(len(words) + 1, dtype=np.int64), _sieve(words)
        for batch in batches:
            for body in batch["text"]:
                own = word_hashes(body)
                own = own[_sifted(sieve, own)]
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                total[np.unique(at[words[at] == own])] += 1
                total[-1] += 1
        found = np.flatnonzero(total)
        yield pd.DataFrame({"w": found, "n": total[found]})

    sums = docs.select(F.col(text).alias("text")).mapInPandas(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(words) + 1, dtype=np.int64)
    out[sums["w"].to_numpy(dtype=np.int64)] = sums["n"]
    return out[:-1], int(out[-1])


def fit(benchmark: DataFrame, docs: DataFrame, item_text: str = "text", text: str = "text", iterations: int = 2) -> LatentSpace:
    """The latent space of all benchmark passages, weighted by document frequencies over all docs.

    The OWN_ROWS words with the most occurrences have a row each, all others share SHARED_ROWS by their hash; the basis
    has at most MAX_RANK columns. So what is summed has at most 65536 x 128 numbers whatever the size of the tables,
    and what is broadcast 12 bytes more for each distinct word of the benchmark.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_text).alias("text")).filter("text is not null")

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, counts = np.unique(np.concatenate([np.empty(0, dtype=_U), *map(word_hashes, batch["text"])]), return_counts=True)
            yield pd.DataFrame({"w": signed(values), "n": counts})

    met = items.mapInPandas(used, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    words, times = met["w"].to_numpy(dtype=np.int64).view(_U), met["n"].to_numpy(dtype=np.int64)
    words, times = words[np.argsort(words)], times[np.argsort(words)]
    if not len(words):
        return LatentSpace(words, np.empty(0, dtype=np.int32), np.ones(1), np.zeros((1, 1), dtype=np.float32))
    row = (OWN_ROWS + words % _U(SHARED_ROWS)).astype(np.int32)
    often = np.lexsort((words, -times))[:OWN_ROWS]
    row[often] = np.arange(len(often))
    size = int(row.max()) + 1
    counts, total = document_frequency(docs, words, text)
    weight = np.log((total + 1) / (np.append(np.minimum(total, np.bincount(row, counts, minlength=size)), 0) + 1)) + 1
    space = LatentSpace(words, row, weight, np.zeros((size + 1, 1)))
    rank = min(MAX_RANK, size, 8 + items.count())
    shared = spark.sparkContext.broadcast(space)

    def sums(right: np.ndarray) -> np.ndarray:
        """A'(A right), A the passages' TF-IDF rows, summed over partitions in slices of rows."""
        given = spark.sparkContext.broadcast(right)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, x = shared.value, given.value
            out = np.zeros_like(x)
            for batch in batches:
                for body in batch["text"]:
                    for passage in passages(word_hashes(body)):
                        at, tf = np.unique(known.columns(passage), return_counts=True)
                        row = known.weight[at] * tf
                        row /= max(1e-12, np.linalg.norm(row))
                        out[at] += row[:, None] * (row @ x[at])
            yield pd.DataFrame([(s, out[s : s + SLICE].tobytes()) for s in range(0, len(out), SLICE)], columns=["s", "v"])

        def added(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": group["s"][:1], "v": [np.sum([np.frombuffer(v) for v in group["v"]], axis=0).tobytes()]})

        done = items.mapInPandas(partial, "s int, v binary").groupBy("s").applyInPandas(added, "s int, v binary").collect()
        return np.concatenate([np.frombuffer(r["v"]) for r in sorted(done, key=lambda r: r["s"])]).reshape(right.shape)

    basis = np.random.default_rng(20).standard_normal((size, rank))
    for _ in range(iterations):
        basis = np.linalg.qr(sums(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ sums(basis))
    basis = basis @ turn[:, values > 1e-9]
    shared.destroy()
    return LatentSpace(words, row, weight, np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32))


@dataclass
class _Items:
    """One block of the benchmark: passages in the latent space, the item of each, and what the checks need."""

    ids: list
    latent: np.ndarray
    owner: np.ndarray
    masks: list
    lengths: list
    answers: list
    #: Of each item: the rows of its words, sorted, and how often it has each; by row, one bit for each item that has it.
    held: list
    bits: np.ndarray
    #: By number of words: sorted hashes of runs, the item and place of each, and the sieve of the hashes.
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Of each item: how many of its rare words a leak has at least; items by row of a rare word, where each row's begin.
    least: np.ndarray
    rare: np.ndarray
    begin: np.ndarray


def _prepare(rows: list, space: LatentSpace, answer_words: int, overlap: float) -> _Items:
    """A leak has `needed` of an item's n words, so of any n - needed + m of them it has m: the rarest are taken, m is SPARE + 1 or fewer."""
    ids, vectors, owner, masks, lengths, answers, held, found = [], [], [], [], [], [], [], {}
    least, rare = [], []
    for row in rows:
        words = word_hashes(row["text"])
        if not len(words):
            continue
        for passage in passages(words):
            at = space.columns(passage)
            vector = space.project(at)
            norm = np.linalg.norm(vector)
            if norm > 0:
                vectors.append(vector / norm)
                owner.append(len(ids))
        answer = word_hashes(row["answer"]) if row["answer"] else words[-answer_words:]
        size = min(GRAM, len(words))
        hashes = grams(words, size)
        found.setdefault(size, []).append((hashes, np.full(len(hashes), len(ids)), np.arange(len(hashes))))
        ids.append(row["item"])
        masks.append(_masks(words))
        lengths.append(len(words))
        columns = space.columns(words)
        held.append(np.unique(columns, return_counts=True))
        needed = max(1, math.ceil(overlap * len(words) - 1e-6))
        size = min(len(words), len(words) - needed + 1 + SPARE)
        least.append(size - (len(words) - needed))
        rare.append(np.unique(columns[np.argsort(-space.weight[columns], kind="stable")[:size]]))
        answers.append((_masks(answer), len(answer)))
    runs = {}
    for size, own in found.items():
        hashes, item, place = (np.concatenate(c) for c in zip(*own, strict=True))
        order = np.argsort(hashes, kind="stable")
        runs[size] = hashes[order], item[order].astype(np.int32), place[order].astype(np.int32), _sieve(hashes)
    row, by = np.concatenate([np.empty(0, dtype=np.int64), *rare]), np.repeat(np.arange(len(ids)), [len(r) for r in rare])
    bits = np.zeros((space.unknown + 1, -(-len(ids) // 8)), dtype=np.uint8)
    for i, (columns, _) in enumerate(held):
        bits[columns, i >> 3] |= np.uint8(1 << (i & 7))
    return _Items(ids, np.array(vectors, dtype=np.float32).reshape(-1, space.basis.shape[1]), np.array(owner, dtype=int), masks, lengths, answers, held, bits, runs,
                  np.array(least, dtype=np.int64), by[np.argsort(row, kind="stable")], np.append(0, np.cumsum(np.bincount(row, minlength=space.unknown + 1))))


def _near(at: np.ndarray, items: _Items, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows from the first on, before the last, and items that have enough of the item's rare words around the window; by window and item."""
    around = np.maximum(0, np.array(items.lengths) - PASSAGE) + 4
    reach = int(around.max())
    lo = max(0, first * STRIDE - reach)
    here = at[lo : (last - 1) * STRIDE + WINDOW + reach]
    which, nth = _spread(items.begin[here + 1] - items.begin[here])
    item, place = items.rare[items.begin[here[which]] + nth], which + lo
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    end = np.arange(len(item)) + items.least[item] - 1
    met = np.flatnonzero(item[np.minimum(end, len(item) - 1)] == item) if len(item) else np.empty(0, dtype=np.int64)
    met = met[end[met] < len(item)]
    own = item[met]
    low = np.maximum(first, (place[end[met]] - WINDOW - around[own]) // STRIDE + 1)
    high = np.minimum(last - 1, (place[met] + around[own]) // STRIDE)
    which, nth = _spread(np.maximum(0, high - low + 1))
    pairs = np.unique((low[which] + nth) * len(items.ids) + own[which])
    return pairs // len(items.ids), pairs % len(items.ids)


def _aligned(words: np.ndarray, items: _Items) -> list[tuple[int, int]]:
    """(item, where it would start in the words) of each run of words that both have; the start can be negative."""
    out: set[tuple[int, int]] = set()
    for size, (hashes, item, place, sieve) in items.runs.items():
        own = grams(words, size)
        some = _sifted(sieve, own)
        at = np.searchsorted(hashes, own[some])
        hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == own[some])
        upto = np.searchsorted(hashes, own[some[hit]], side="right")
        for where, lo, hi in zip(some[hit].tolist(), at[hit].tolist(), upto.tolist(), strict=True):
            out.update(zip(item[lo:hi].tolist(), (where - place[lo:hi]).tolist(), strict=True))
    return sorted(out)


def _nearness(words: np.ndarray, space: LatentSpace, items: _Items, item: int) -> float:
    """Cosine of some words to the nearest passage of an item, 0 where the latent space has none of either."""
    at = space.columns(words)
    vector = space.project(at)
    near = items.latent[items.owner == item] @ (vector / max(1e-12, np.linalg.norm(vector)))
    return float(near.max()) if len(near) else 0.0


def _leaks(words: np.ndarray, space: LatentSpace, items: _Items, cosine: float, overlap: float, sure: float, answer: float) -> dict[int, tuple[float, float, float]]:
    """(cosine, LCS share, answer share) of each item that leaks into the words of one document."""
    n = len(words)
    if not n or not items.ids:
        return {}
    at = space.columns(words)
    found: dict[int, tuple[float, float, float]] = {}

    def check(item: int, region: np.ndarray) -> tuple[float, float] | None:
        """(LCS share, answer share) if the item leaks into the region with a larger share than so far."""
        length = items.lengths[item]
        share = lcs_length(items.masks[item], length, region) / length
        if share < overlap or share <= found.get(item, (0, 0, 0))[1]:
            return None
        masks, size = items.answers[item]
        hit = lcs_length(masks, size, region) / size if size else 1.0
        return (share, hit) if share >= sure or hit >= answer else None

    lengths = np.array(items.lengths)
    hits, count, end = np.append(0, np.cumsum(items.begin[at + 1] - items.begin[at])), max(1, -(-n // STRIDE) - 1), 0
    reach = max(0, int(lengths.max()) - PASSAGE) + 4
    passage = np.searchsorted(items.owner, np.arange(len(items.ids) + 1))
    while end < count:
        begin, size = end, BLOCKS
        while size > 1 and hits[min(n, (begin + size - 1) * STRIDE + WINDOW + reach)] - hits[max(0, begin * STRIDE - reach)] > HITS:
            size //= 2
        end = min(count, begin + size)
        w, owner = _near(at, items, begin, end)
        if not len(w):
            continue
        chosen, place = np.unique(w, return_inverse=True)
        vectors = space.windows(at, chosen)
        which, nth = _spread(passage[owner + 1] - passage[owner])
        p = passage[owner[which]] + nth
        near = np.concatenate([np.einsum("ij,ij->i", vectors[place[which[i : i + BLOCK]]], items.latent[p[i : i + BLOCK]]) for i in range(0, len(p), BLOCK)] or [np.empty(0)])
        # of several passages of an item that meet a window the first stands for all
        met = np.flatnonzero(near >= cosine)
        met = met[np.unique(which[met], return_index=True)[1]]
        if not len(met):
            continue
        w, owner, near = w[which[met]], owner[which[met]], near[met]
        starts = w * STRIDE
        around = np.maximum(0, lengths[owner] - PASSAGE) + 4
        first, last = np.maximum(0, starts - around), np.minimum(n, starts + WINDOW + around)
        # a region with too few of the item's words can't have them in order
        lo, some = int(first.min()), np.unique(owner)
        own = (items.bits[at[lo : int(last.max())][:, None], some >> 3] >> (some & 7).astype(np.uint8)) & 1
        met = np.concatenate((np.zeros((1, len(some)), dtype=np.int32), np.cumsum(own, axis=0, dtype=np.int32)))
        place = np.searchsorted(some, owner)
        enough = met[last - lo, place] - met[first - lo, place] >= overlap * lengths[owner] - 1e-6
        for i in np.flatnonzero(enough).tolist():
            item = int(owner[i])
            columns, counts = items.held[item]
            here = at[first[i] : last[i]]
            spot = np.minimum(np.searchsorted(columns, here), len(columns) - 1)
            room = np.minimum(np.bincount(spot[columns[spot] == here], minlength=len(columns)), counts).sum()
            scores = check(item, words[first[i] : last[i]]) if room >= overlap * lengths[item] - 1e-6 else None
            if scores:
                found[item] = (float(near[i]), *scores)
    near_by = set(found)
    for item, start in _aligned(words, items):
        if item in near_by:
            continue
        length = items.lengths[item]
        around = length // 4 + 4
        scores = check(item, words[max(0, start - around) : start + length + around])
        if scores:
            found[item] = (_nearness(words[max(0, start) : start + min(length, PASSAGE)], space, items, item), *scores)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
          item_answer: str | None = None, cosine: float = 0.5, overlap: float = 0.6, sure: float = 0.8, answer: float = 0.6, answer_words: int = 8) -> DataFrame:
    """One row per document and item that leaks into it: key, item_key, cosine, lcs_share, answer_share.

    A window is compared with the passages of all items of which it has enough rare words around it; from `cosine` on, or where a run of GRAM words or a
    whole shorter item occurs in the document, the surrounding words must have at least `overlap` of the item's words
    in order, and either `sure` of them or `answer` of the answer's words. So no verbatim copy is lost, whatever its
    length, its words and its surroundings; cosine is then that of the copy's first passage. The answer is the item_answer column or the item's last answer_words
    words. Null, empty and blank texts leak nothing and hold no leaks; repeated documents give repeated rows, items
    of equal text each their own rows; an empty table gives an empty result. Columns named as the result's are not
    used otherwise. Benchmarks of more than BLOCK / 4 items or 96 x BLOCK characters are compared block by block.
    """
    spark = docs.sparkSession
    space = fit(benchmark, docs, item_text, text)
    shared = spark.sparkContext.broadcast(space)
    kept = F.col(item_answer) if item_answer else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text"), kept.alias("answer")).filter("text is not null")
    count, characters = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count * 4 // BLOCK), -(-characters // (96 * BLOCK)))
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    schema = f"id {kinds[0]}, item {kinds[1]}, cosine double, lcs_share double, answer_share double"
    out = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        prepared = spark.sparkContext.broadcast(_prepare(rows, space, answer_words, overlap))

        def search(batches: Iterator[pd.DataFrame], prepared=prepared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = []
                for doc, body in zip(batch["id"], batch["text"], strict=True):
                    found = _leaks(word_hashes(body), shared.value, prepared.value, cosine, overlap, sure, answer)
                    hits += [(doc, prepared.value.ids[i], *score) for i, score in sorted(found.items())]
                yield pd.DataFrame(hits, columns=["id", "item", "cosine", "lcs_share", "answer_share"])

        part = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(key), F.col("item").alias(item_key), "cosine", "lcs_share", "answer_share")
