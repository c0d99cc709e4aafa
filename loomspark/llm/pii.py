"""Personal data: fixed formats, and identifiers that bootstrapped contextual patterns discover.

Seed entities are the spans of the fixed formats, values named as passwords, secrets or access keys (found whatever they
look like), and strings that mix letters and digits as generated keys do (not found by that alone). Seeds induce patterns: the word and the marks on the left of an instance (`pass-code: "`), or an instance's own beginning and
shape. Over the graph of patterns and instances Spark scores patterns by the share of known instances among all their
distinct instances, and instances by their best pattern, for a few rounds. Whatever stands in a pattern that stays
confident is found, whether it looks like a seed or not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut

#: Kinds in the order of results; the last is what only patterns find.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed formats, as given. Possessive where that can't change a match, so that long runs are read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may stand between a word and the value it names: quotes and blanks around one of these signs.
_NAMED = re.compile(r"[:=]")
_BEFORE = re.compile(r"([^\W\d_](?:[\w.-]{0,39}[^\W_])?)[\"']?\Z")
_AFTER = re.compile(r"[:=>]{1,2}[^\S\n]{0,3}([\"'`]?)")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9])*+")
_PLAIN = re.compile(r"[^\s\"'`<>|,;&]++")
_ADDRESS = re.compile(r"[A-Za-z]{2,12}://")
#: Strings that may be generated keys: letters and digits, 16 or more, that change over often.
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
#: Names whose values are secrets by themselves.
CUE = re.compile(r"(?i)(?:.*[_.-])?(?:password|passwd|passphrase|pwd|secret|(?:api|access|private|secret)[_-]?key)")
#: Names of values that look like keys and are none.
DIGESTS = frozenset("sha sha1 sha256 sha512 md5 commit checksum digest hash etag uuid guid revision rev crc integrity isbn doi".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        n = int(char) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ in turn: the characters before it that the format allows, as far as the last match ended, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind, then start; leftmost and non-overlapping within a kind."""
    out = [(0, *span) for span in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def like_key(value: str) -> bool:
    """Whether a string changes between letters and digits as often as generated keys do: once in six characters at least."""
    return 6 * sum(1 for _ in _CHANGE.finditer(value)) >= len(value)


def _identity(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def instances(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, list[str], int, int, int, bool]]:
    """(identity, patterns, start, end, seed kind or -1, whether it is found without a pattern) of what patterns may find.

    These are the values that a word names with : or = (in quotes as a whole, else up to a blank), as
    number or as other value, and strings like keys wherever they stand. The patterns of numbers and of other values
    differ, so a number is never taken for a secret, nor a word for a number.
    """
    out, taken = [], set()
    numbers = {(a, b): k for k, a, b in known if k in (1, 2, 3)}
    starts = {a: (a, b) for a, b in sorted(numbers)}

    def own(value: str) -> list[str]:
        letters = re.match(r"[A-Za-z]{3,4}", value)
        shape = "".join(sorted({"9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value}))
        return [f"own {letters[0]} {shape}{len(value)}"] if letters and like_key(value) else []

    done = 0
    for sign in _NAMED.finditer(text):
        at = sign.start()
        if at < done:
            continue
        back = at
        while back > 0 and at - back < 3 and text[back - 1] in " \t":
            back -= 1
        name = _BEFORE.search(text, max(0, back - 48), back)
        opened = _AFTER.match(text, at)
        if not name or (start := opened.end()) >= len(text):
            continue
        pattern = f"{name[1].lower()} {''.join(text[at:start].split())}"
        cue = CUE.fullmatch(name[1]) is not None
        number = None if cue else _NUMBER.match(text, start)
        if not cue and start in starts or number and sum(c.isdigit() for c in number[0]) >= 7 and (number.end() == len(text) or not text[number.end()].isalnum()):
            start, done = starts.get(start) or number.span()
            out.append((_identity(text[start:done]), [f"number {pattern}"], start, done, numbers.get((start, done), -1), False))
            continue
        if opened[1]:
            end = text.find(opened[1], start)
            end = -1 if text.find("\n", start, max(start, end)) >= 0 else end
        else:
            plain = _PLAIN.match(text, start)
            whole = plain[0].split("?", 1)[0] if plain and _ADDRESS.match(plain[0]) else plain[0] if plain else ""
            end = start + len(whole.rstrip(".:!?)]}"))
        if end > start:
            value, done = text[start:end], end
            key = _KEY.fullmatch(value) and like_key(value) and name[1].lower() not in DIGESTS
            seed = len(KINDS) - 1 if cue or key else -1
            taken.add(start)
            out.append((_identity(value), [f"value {pattern}", *own(value)], start, end, seed, cue))
    for m in _KEY.finditer(text):
        if m.start() not in taken and (patterns := own(m[0])):
            out.append((_identity(m[0]), patterns, m.start(), m.end(), -1, False))
    return out


_SPAN = "struct<kind:int,start:int,end:int>"
_CAND = "struct<value:long,patterns:array<string>,start:int,end:int,seed:int,sure:boolean>"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, body, base, candidates) per row of docs; body is a hash that tells texts with the same id apart."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            base = [base_spans(t) for t in texts]
            names, fields = ("kind", "start", "end"), ("value", "patterns", "start", "end", "seed", "sure")
            found = [[dict(zip(fields, c, strict=True)) for c in instances(t, b)] for t, b in zip(texts, base, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "body": batch["body"], "base": [[dict(zip(names, s, strict=True)) for s in b] for b in base], "candidates": found})

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    return rows.mapInPandas(each, f"id {dict(docs.dtypes)[key]}, body long, base array<{_SPAN}>, candidates array<{_CAND}>")


def score_patterns(occurrences: DataFrame, rounds: int = 3, confidence: float = 0.75, support: int = 3) -> DataFrame:
    """(pattern, kind, score) of the confident patterns.

    A pattern's score for a kind is the summed score of its instances of that kind over its number of distinct instances
    plus one. Patterns with fewer than `support` distinct instances, or a lower score than `confidence`, don't count.
    Seeds speak for names only: an instance's own shape counts once other patterns have confirmed instances of it.
    """
    edges = cut(occurrences.select(F.explode("patterns").alias("pattern"), "value").distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    seeds = occurrences.filter("seed >= 0").groupBy("value", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    shaped = F.startswith("pattern", F.lit("own "))
    confirmed, scored = None, None
    for _ in range(rounds):
        mass = edges.filter(~shaped).join(seeds if confirmed is None else confirmed.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")), "value")
        if confirmed is not None:
            mass = mass.unionByName(edges.filter(shaped).join(confirmed, "value"))
        sums = mass.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        scored = sums.join(size, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("score"))
        scored = cut(scored.filter(F.col("score") >= confidence))
        confirmed = edges.join(scored, "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
    return scored


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = 3, confidence: float = 0.75, support: int = 3) -> DataFrame:
    """One row per document: id, body, base and spans, arrays of (kind, start, end) with kind an index into KINDS.

    Positions are code points, ends exclusive; spans holds base and, where nothing of base overlaps them, the instances
    in confident patterns and the named secrets, of the best pattern's kind (of equal scores the later kind), sorted by kind, then start. Null
    and empty texts have no spans; very long texts are read whole, in time that grows with their length. Repeated rows
    stay repeated rows with the same spans; a null id is an id like others. An empty table gives an empty result; other
    columns aren't used.
    """
    rows = cut(scan(docs, text, key))
    occurrences = rows.select("id", "body", "base", F.explode("candidates").alias("c")).select("id", "body", "base", "c.*")
    patterns = score_patterns(occurrences, rounds, confidence, support)
    free = occurrences.filter(~F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    keyed = free.select("id", "body", "start", "end", F.explode("patterns").alias("pattern"))
    sure = free.filter("sure").select("id", "body", "start", "end", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    best = keyed.join(patterns, "pattern").select(*sure.columns).unionByName(sure).groupBy("id", "body", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    added = best.groupBy("id", "body").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added"))
    added = added.select(F.col("id").alias("id2"), F.col("body").alias("body2"), "added")
    joined = rows.join(added, F.col("id").eqNullSafe(F.col("id2")) & (F.col("body") == F.col("body2")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return joined.select("id", "body", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def written(spans: str) -> F.Column:
    """The spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def mask(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; of overlapping spans the first is written."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for body, own in zip(texts, spans, strict=True):
            if own is None or body is None or not len(own):
                out.append(body)
                continue
            pieces, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    pieces += [body[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                at = max(at, s["end"])
            out.append("".join([*pieces, body[at:]]))
        return pd.Series(out, dtype=object)

    marks = found.filter(F.size("spans") > 0).select("id", "body", "spans").dropDuplicates(["id", "body"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("of"), F.xxhash64(text).alias("hash"))
    both = rows.join(marks, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("body")), "left")
    covered = F.when(F.col("spans").isNotNull(), cover(F.col("row")[text], F.col("spans"))).otherwise(F.col("row")[text])
    return both.select(*[covered.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
