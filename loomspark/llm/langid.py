"""Language identification: cosine against several clustered TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
_WIDTH_BITS = 12
#: Length bands by numbers of trigrams, and the characters of excerpts that calibrate the shorter bands.
BANDS = (8, 16, 64, 256, 1024)
EXCERPTS = (8, 20, 60, 200, 800)
#: Held-out texts from which on a limit is read from them alone.
ENOUGH = 50


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for what is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the letter trigrams of a whole text, words padded by blanks; None without a letter."""
    if not text:
        return None
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    padded = np.concatenate(([32], points, [32])).astype(np.uint32)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    padded = padded[keep]
    if len(padded) < 3:
        return None
    hashed = padded[:-2] * np.uint32(2654435761) + padded[1:-1] * np.uint32(2246822519) + padded[2:] * np.uint32(3266489917)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(2246822519)
    return np.bincount(hashed >> np.uint32(32 - _WIDTH_BITS), minlength=1 << _WIDTH_BITS)


@dataclass
class CentroidModel:
    """Unit centroids (one row each), the language and least accepted cosine of each by length band, and the term weights."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether that is nearer than the centroid's rejection distance."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        vector = np.log1p(counts) * self.idf
        cosines = self.centroids @ (vector / np.linalg.norm(vector))
        best = int(cosines.argmax())
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] >= self.floors[best, np.searchsorted(BANDS, counts.sum())])


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart seeds; a cluster that loses all its rows is left out."""
    seeds = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int((rows @ rows[seeds].T).max(axis=1).argmin()))
    centres = rows[seeds]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[nearest == i].sum(axis=0) for i in range(len(centres)) if (nearest == i).any()])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _floors(languages: list[str], near: np.ndarray, band: np.ndarray, cosine: np.ndarray, quantile: float) -> np.ndarray:
    """Least accepted cosine of each centroid and band, the quantile of the held-out texts nearest to it.

    With fewer than ENOUGH of them those of its language are taken, then those of all languages in the band; bands
    without any take the next shorter band's, and 0 without a shorter one.
    """
    spoken = np.array(languages)
    out = np.zeros((len(languages), len(BANDS) + 1))
    for j in range(out.shape[1]):
        for i, name in enumerate(languages):
            own = [cosine[(band == j) & (near == i)], cosine[(band == j) & (spoken[near] == name)], cosine[band == j]]
            some = next((c for c in own if len(c) >= ENOUGH), own[-1])
            out[i, j] = np.quantile(some, quantile, method="lower") if len(some) else out[i, j - 1] if j else 0.0
    return out


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", clusters: int = 3, max_rows: int = 2000, quantile: float = 0.01) -> CentroidModel:
    """Fits the centroids on a bounded sample of labelled rows and their rejection distances on rows held out of it.

    At most about max_rows rows in all, shared evenly by the languages and chosen by a hash of the key, are learned
    from, so at most max_rows / 8 languages, the most frequent ones. Rows without language or letters are left out. A third of the texts, whole and cut to EXCERPTS characters,
    are held out of centroids and term weights; those nearest to a centroid of their own language give each centroid's
    limit in each length band, the quantile of their cosines. A language with fewer than 8 other rows learns from all
    of its rows. No labelled row gives a model that answers `und`.
    """
    labelled = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_rows // 8).collect()}
    each = max(8, max_rows // max(1, len(sizes)))
    draw = F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for name, n in sizes.items():
        wanted = wanted | ((F.col("l") == name) & (draw < min(1.0, each / n)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, body in zip(batch["l"], batch["t"], strict=True):
                held = zlib.crc32(body.encode("utf-8", "surrogatepass")) % 3 == 0
                for size in (None, *(n for n in EXCERPTS if held and n < len(body))):
                    counts = ngram_counts(body[:size])
                    if counts is not None:
                        at = np.flatnonzero(counts)
                        found.append((name, held, size is None, int(counts.sum()), at.astype(np.uint16).tobytes(), np.log1p(counts[at]).astype(np.float32).tobytes()))
            yield pd.DataFrame(found, columns=["l", "held", "whole", "n", "at", "v"])

    schema = "l string, held boolean, whole boolean, n long, at binary, v binary"
    sample = labelled.filter(wanted).select("l", "t").mapInPandas(vectors, schema).collect() if sizes else []
    if not sample:
        return CentroidModel([], np.empty((0, 1 << _WIDTH_BITS)), np.empty((0, len(BANDS) + 1)), np.ones(1 << _WIDTH_BITS))
    sample.sort(key=lambda r: (r["l"], bytes(r["at"]), bytes(r["v"])))
    kept = Counter(r["l"] for r in sample if not r["held"])
    learned = [r for r in sample if r["whole"] and (not r["held"] or kept[r["l"]] < 8)]
    weight = np.zeros((len(learned), 1 << _WIDTH_BITS))
    for row, r in zip(weight, learned, strict=True):
        row[np.frombuffer(r["at"], dtype=np.uint16)] = np.frombuffer(r["v"], dtype=np.float32)
    idf = np.log((1 + len(weight)) / (1 + (weight > 0).sum(axis=0))) + 1
    weight *= idf
    weight /= np.linalg.norm(weight, axis=1, keepdims=True)
    languages, centres = [], []
    names = np.array([r["l"] for r in learned])
    for name in sorted(set(names)):
        for centre in _cluster(weight[names == name], clusters):
            languages.append(str(name))
            centres.append(centre)
    centroids = np.array(centres)
    measured = []
    for r in sample:
        if r["held"] and kept[r["l"]] >= 8:
            at = np.frombuffer(r["at"], dtype=np.uint16)
            vector = np.frombuffer(r["v"], dtype=np.float32) * idf[at]
            cosines = centroids[:, at] @ (vector / np.linalg.norm(vector))
            best = int(cosines.argmax())
            if languages[best] == r["l"]:
                measured.append((best, int(np.searchsorted(BANDS, r["n"])), float(cosines[best])))
    near, band, cosine = (np.array(c) for c in zip(*measured, strict=True)) if measured else (np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0))
    return CentroidModel(languages, centroids, _floors(languages, near, band, cosine, quantile), idf)


def classify(text: Column | str, model: CentroidModel) -> Column:
    """struct(lang_pred string, score double, accepted boolean) of a text column; null, empty or letterless: und, 0, false."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.classify(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return nearest(text)


def identify(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted; columns of these names are replaced, all others stay.

    Of equal cosines the first centroid by language counts. Null, empty and letterless texts get und, 0 and false; very
    long texts are counted whole; repeated rows are classified alike; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return docs.select(F.struct(*kept).alias("row"), classify(text, model).alias("found")).select("row.*", "found.*")
