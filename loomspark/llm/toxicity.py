"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that documents labelled toxic have far more often than others, by
log-likelihood ratio. The trees see densities of lexicon hits, their proximity to second-person words, and rates of
capitals, punctuation and obfuscation; they and the calibration are Spark ML models.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut

#: Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta vous votre vos tú ti tuyo usted ustedes vosotros su".split())
FEATURES = (
    "word_hits", "word_density", "stem_hits", "stem_density", "strongest", "distinct_hits", "second_person", "proximity",
    "capitals", "shouted_words", "exclamations", "questions", "mark_runs", "obfuscated", "obfuscated_hits", "log_words",
)
#: Lengths of word beginnings, and the characters that stand for letters in obfuscated words.
STEMS = (4, 5, 6, 7, 8)
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[!?]{2,}")
_SIGN = re.compile(r"[0-9@$*]")


def terms(text: str | None) -> set[str]:
    """The words ('=' before) and word beginnings ('^' before) of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) >= n}


@dataclass
class Lexicon:
    """Log odds of toxic against other documents for words and word beginnings."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self) -> None:
        self._seen: dict[str, tuple[float, float]] = {}

    def weigh(self, word: str) -> tuple[float, float]:
        """Weight of the word itself and of its best beginning, 0 where it has none."""
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) > 400_000:
                self._seen.clear()
            known = self.words.get(word, 0.0), max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)
            self._seen[word] = known
        return known

    def features(self, text: str | None) -> list[float]:
        """Values of FEATURES for a whole text; all 0 for null and empty.

        Shouted words count in texts with more than a fifth of capitals; an obfuscated word is read up to 24 characters to
        either side of its sign. Texts are read whole, whatever their length.
        """
        text = text or ""
        words = _WORD.findall(text.lower())
        if not words:
            return [0.0] * len(FEATURES)
        n = len(words)
        weights = [self.weigh(w) for w in words]
        hits = [i for i, (a, b) in enumerate(weights) if a or b]
        others = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
        proximity, j = 0.0, 0
        for i in hits:
            while j + 1 < len(others) and abs(others[j + 1] - i) <= abs(others[j] - i):
                j += 1
            if others:
                proximity += 1 / (1 + abs(others[j] - i))
        by_word, by_stem = sum(a > 0 for a, _ in weights), sum(b > 0 for _, b in weights)
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        shouted = sum(1 for w in _WORD.findall(text) if len(w) > 2 and w.isupper()) if upper > 0.2 * len(text) else 0
        hidden, hidden_hits = 0, 0
        for sign in _SIGN.finditer(text):
            at = sign.start()
            if 0 < at < len(text) - 1 and text[at - 1].isalpha() and text[at + 1].isalpha():
                hidden += 1
                left, right = at, at + 1
                while left > 0 and not text[left - 1].isspace() and at - left < 24:
                    left -= 1
                while right < len(text) and not text[right].isspace() and right - at < 24:
                    right += 1
                hidden_hits += any(map(any, map(self.weigh, _WORD.findall(text[left:right].lower().translate(_LEET)))))
        return [
            float(by_word), by_word / n, float(by_stem), by_stem / n, max((max(p) for p in weights), default=0.0), float(len({words[i] for i in hits})),
            len(others) / n, proximity, upper / len(text), shouted / n, text.count("!") / n, text.count("?") / n,
            len(_MARKS.findall(text)) / n, hidden / n, float(hidden_hits), math.log1p(n),
        ]


def learn_lexicon(rows: DataFrame, least: float = 20.0, size: int = 4000) -> Lexicon:
    """The `size` terms of (text, toxic) rows with the highest log-likelihood ratio, from `least` on, toxic ones only."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for body, label in zip(batch["text"], batch["toxic"], strict=True):
                found[int(label)].update(terms(body))
                found[int(label)][""] += 1
        both = set(found[0]) | set(found[1])
        yield pd.DataFrame([(t, found[1][t], found[0][t]) for t in both], columns=["term", "pos", "neg"])

    sums = cut(rows.select("text", "toxic").mapInPandas(counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    total = sums.filter("term = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        return Lexicon({}, {})
    np_, nn = total["pos"], total["neg"]
    rate = (F.col("pos") + F.col("neg")) / (np_ + nn)

    def part(seen: Column, of: int) -> Column:
        share = seen / of
        return F.when(seen > 0, seen * F.log(share / rate)).otherwise(0) + F.when(seen < of, (of - seen) * F.log((1 - share) / F.greatest(1 - rate, F.lit(1e-12)))).otherwise(0)

    ratio = 2 * (part(F.col("pos"), np_) + part(F.col("neg"), nn))
    odds = F.log((F.col("pos") + 0.5) / (np_ + 1)) - F.log((F.col("neg") + 0.5) / (nn + 1))
    best = sums.filter("term <> ''").select("term", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("ratio") >= least) & (F.col("odds") > 1.5))
    chosen = best.orderBy(F.desc("ratio"), "term").limit(size).collect()
    return Lexicon({r["term"][1:]: r["odds"] for r in chosen if r["term"][0] == "="}, {r["term"][1:]: r["odds"] for r in chosen if r["term"][0] == "^"})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None


def _vector(text: str, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.features(t) for t in texts], dtype=object)

    return array_to_vector(dense(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = 6000, rounds: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from the rows of docs that labels names, at most about per_class of each class, chosen by a hash of the key.

    Rows stand for as many as were not drawn of their class, so scores keep the class rates. Of several labels of a
    key the largest counts; null labels and keys are left out. A fifth calibrates (all rows if that has fewer than 20
    toxic ones). Without rows of both classes the model scores 0.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).filter("k is not null and toxic in (0, 1)").groupBy("k").agg(F.max("toxic").alias("toxic"))
    named = marked.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    sizes = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    nothing = ToxicityModel(Lexicon({}, {}), None, None)
    if set(sizes) != {0, 1}:
        return nothing
    share = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    draw = F.pmod(F.xxhash64("k", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    drawn = named.filter(draw < limit).withColumn("weight", 1 / limit).withColumn("check", F.pmod(F.xxhash64("k", F.lit("check")), F.lit(5)) == 0)
    sample = cut(docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(drawn), "k").select("text", "toxic", "weight", "check"))
    lexicon = learn_lexicon(sample)
    vectors = cut(sample.select(_vector("text", lexicon).alias("features"), F.col("toxic").cast("double").alias("label"), "weight", "check"))
    apart = vectors.filter("check and label = 1").count() >= 20
    learned = vectors.filter("not check") if apart else vectors
    if learned.select("label").distinct().count() < 2:
        return nothing
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=7).fit(learned)
    held = vectors.filter("check") if apart else vectors
    raw = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), "label", "weight")
    binned = raw.groupBy(F.round("raw", 4).alias("raw")).agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
    return ToxicityModel(lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(binned))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column `into`: 0 to 1, higher for likelier toxic.

    Null and empty texts are scored like texts without any hit; equal features score alike; an empty table gives an empty
    result. Repeated rows score alike; all other columns stay, one
    named `into` is replaced.
    """
    if model.trees is None or model.calibration is None:
        return docs.withColumn(into, F.lit(0.0))
    kept = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*kept).alias("row"), _vector(text, model.lexicon).alias("features"))
    raw = model.trees.transform(rows).select("row", vector_to_array("probability")[1].alias("raw"))
    done = model.calibration.transform(raw)
    return done.select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias(into))
