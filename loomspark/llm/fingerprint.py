"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are numbered by occurrence and hashed once; the hash deals them over 2 x `sketches` strata and the
least of each stratum is selected. The two selected of a sketch are put in their order in the text and hashed as a
tuple, so that moved text changes sketches as edited text does. The likeness of two fingerprints is the share of equal
sketches among those that either has.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import parts

_SIGN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_LETTER = rf"[^\s{_SIGN}]"
#: A piece: one sign of a script that is written without blanks, or up to 12 other characters; longer words are cut
#: after certain characters, so that an edit moves few cuts. K-mers are runs of K pieces.
PIECE, K = rf"[{_SIGN}]|{_LETTER}{{1,12}}(?!{_LETTER})|{_LETTER}{{1,12}}?(?<=[aeiouAEIOU048])|{_LETTER}{{1,12}}", 3
#: Texts of fewer characters have each character as a piece.
SHORT = 64
_POSITION_BITS = 32


def _kmers(text: Column) -> Column:
    """Hashes of the k-mers of a text in order; one of the whole text if it has fewer pieces, none if it has none."""
    pieces = F.when(F.length(text) < SHORT, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))

    def hashed(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(p) - K), lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(K)]))
        return F.when(F.size(p) >= K, runs).when(F.size(p) > 0, F.array(F.xxhash64(F.concat_ws(" ", p)))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(pieces), hashed), 1)


def sketch(rows: DataFrame, keys: list[str], text: str, sketches: int = 64) -> DataFrame:
    """(*keys, sketch array<int>) of every row of (*keys, text); keys name a row, and rows should lie together by some of them.

    Each number holds the index of a sketch and 16 bits of its tuple; a text without pieces has an empty array.
    """
    mers = rows.select(*keys, F.posexplode_outer(_kmers(F.col(text))).alias("pos", "mer"))
    nth = F.row_number().over(Window.partitionBy(*keys, "mer").orderBy("pos"))
    hashed = mers.withColumn("x", F.when(F.col("mer").isNotNull(), F.xxhash64("mer", nth)))
    stratum = F.pmod(F.col("x"), F.lit(2 * sketches))
    low = (1 << _POSITION_BITS) - 1
    marked = hashed.select(
        *keys, F.shiftright(stratum, 1).cast("int").alias("i"), F.pmod(stratum, F.lit(2)).alias("side"),
        F.xxhash64("x").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("pos").cast("long").bitwiseAND(F.lit(low))).alias("value"),
    )
    least = marked.groupBy(*keys, "i").agg(F.min(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    a, b = (F.shiftright(F.col(c), _POSITION_BITS) for c in "ab")
    ahead = F.col("a").bitwiseAND(F.lit(low)) < F.col("b").bitwiseAND(F.lit(low))
    pair = F.when(ahead, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
    entry = F.when(F.col("i").isNotNull(), F.col("i") * 65536 + F.pmod(pair, F.lit(65536)).cast("int"))
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("sketch"))


def written(sketch: str) -> Column:
    """A fingerprint as text: six hexadecimal digits for each sketch."""
    return F.concat_ws("", F.transform(sketch, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))))


def likeness(one: str, other: str) -> Column:
    """Share of equal sketches among the sketches of either, 1 for two empty fingerprints."""
    index = lambda c: F.transform(c, lambda e: F.shiftright(e, 16))
    either = F.size(F.array_union(index(one), index(other)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / either)


def _ranges(rows: DataFrame, kind: str, ranges: int) -> tuple[Column, Column, int]:
    """The range of each row by (some, kv, h), from 1, whether it is the first of its range, and the number of ranges.

    The least row of each range is all that reaches the driver; it is found over keys and hashes only.
    """
    order = F.struct("some", "kv", "h")
    dealt = rows.select("some", "kv", "h").repartitionByRange(ranges, "some", "kv", "h")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(order).alias("low")).select(F.to_json("low").alias("low")).collect()
    low = sorted((json.loads(r["low"]) for r in least), key=lambda r: (r["some"], r["kv"], r["h"]))
    table = F.from_json(F.lit(json.dumps(low)), f"array<struct<some:boolean,kv:{kind},h:bigint>>")
    width = max(1, math.isqrt(len(low)))
    coarse = F.from_json(F.lit(json.dumps(low[::width])), f"array<struct<some:boolean,kv:{kind},h:bigint>>")
    upto = lambda a: F.size(F.filter(a, lambda b: b <= order))
    before = (F.greatest(upto(coarse), F.lit(1)) - 1) * width
    number = before + upto(F.slice(table, before + 1, F.lit(width)))
    return number, F.get(table, F.col("range") - 1) == order, len(low)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", sketches: int = 64, share: int = 4) -> DataFrame:
    """Fingerprints of every document, of an edited copy and of the next document.

    Returns key, n_chars, edited_sha256, sketch, edited_sketch, next_sketch. The edit puts the first n_chars // share code
    points of the next document by key (or all it has) in the place of the last ones; rows of one key follow in the
    order of a hash of their text, a null key comes first, after the last row comes the first. Null texts count as
    empty; equal texts have equal fingerprints; repeated rows stay repeated rows. A single document follows itself; an
    empty table gives an empty result; very long texts are taken whole; other columns are not used.

    Texts move once, dealt by ranges of the key; each range has the first row of the next as a guest.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).isNotNull().alias("some"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("kv"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("some", "kv", F.xxhash64("text").alias("h"), "text")
    number, first, ranges = _ranges(rows, kind, 4 * parts(docs.sparkSession))
    placed = rows.withColumn("range", number).withColumn("first", first)
    before = F.when(F.col("range") == 1, ranges).otherwise(F.col("range") - 1)
    seat = lambda at, guest: F.struct(at.alias("range"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("first"), F.array(seat(F.col("range"), False), seat(before, True))).otherwise(F.array(seat(F.col("range"), False)))
    both = placed.select("some", "kv", "h", "text", F.explode(seats).alias("seat")).select("some", "kv", "h", "text", "seat.range", "seat.guest")
    order = Window.partitionBy("range").orderBy("guest", "some", "kv", "h")
    dealt = both.repartition(max(1, ranges), "range")
    linked = dealt.select("*", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("after"))
    n = F.length("text")
    taken = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - taken), F.substring(F.col("after"), F.lit(1), taken))
    versions = linked.select("range", "nth", F.posexplode(F.when(F.col("guest"), F.array("text")).otherwise(F.array(F.col("text"), edited))).alias("v", "t"))
    marks = sketch(versions, ["range", "nth", "v"], "t", sketches).groupBy("range", "nth").agg(*[F.max(F.when(F.col("v") == v, F.col("sketch"))).alias(name) for v, name in ((0, "sketch"), (1, "edited_sketch"))])
    marks = marks.withColumn("next_sketch", F.lead("sketch").over(Window.partitionBy("range").orderBy("nth")))
    facts = linked.filter(~F.col("guest")).select("range", "nth", F.when(F.col("some"), F.col("kv")).alias("key"), n.cast("long").alias("n"), F.sha2(edited, 256).alias("edited_sha256"))
    out = facts.join(marks, ["range", "nth"])
    return out.select(F.col("key").alias(key), F.col("n").alias("n_chars"), "edited_sha256", "sketch", "edited_sketch", "next_sketch")
