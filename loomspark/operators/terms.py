"""Many terms in many texts: one pass over each text, whatever the number of terms.

The terms are the stated side: an Aho-Corasick automaton of them goes to the executors, in blocks of bounded size if they
are many. It names each occurrence of each term at once, so no text is compared with terms one by one; what is found
joins further columns by the term.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the terms of one automaton; it takes about forty times as much in a worker.
BLOCK_BYTES = 4 << 20


def _blocks(terms: DataFrame, term: str) -> list[tuple]:
    """The distinct terms as broadcast lists of about BLOCK_BYTES, dealt by hash, each with a name; null terms are in no text."""
    own = terms.select(F.col(term).alias("term")).filter("term is not null").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES) or 1
    lists = ([r["term"] for r in own.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == b).collect()] for b in range(n))
    return [(uuid.uuid4().hex, terms.sparkSession.sparkContext.broadcast(found)) for found in lists]


#: A worker's last automata by the names of their blocks.
_BUILT: OrderedDict = OrderedDict()


def _open(block: tuple) -> tuple[ahocorasick.Automaton | None, bool]:
    """A block's automaton, None without terms of any length, and whether the empty term, which is everywhere, is among them."""
    name, shared = block
    if name not in _BUILT:
        out = ahocorasick.Automaton()
        for term in shared.value:
            if term:
                out.add_word(term, term)
        out.make_automaton()
        _BUILT[name] = (out if len(out) else None), "" in shared.value
        if len(_BUILT) > 4:
            _BUILT.popitem(last=False)
    return _BUILT[name]


def _distinct(shared):
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, empty = _open(shared)
        always = {""} if empty else set()
        for texts in batches:
            yield pd.Series([None if t is None else sorted(always.union(w for _, w in automaton.iter(t)) if automaton else always) for t in texts], dtype=object)

    return found


def contained(texts: DataFrame, bodies: dict[str, Column], terms: DataFrame, term: str = "term") -> DataFrame:
    """texts with a column for each of bodies: the distinct terms that stand anywhere in it, null for null."""
    shared = _blocks(terms, term)
    out = {}
    for name, body in bodies.items():
        parts = [_distinct(block)(body) for block in shared]
        out[name] = parts[0] if len(parts) == 1 else F.concat(*parts)
    return texts.withColumns(out)


def _spots(shared):
    @F.pandas_udf("array<struct<term:string,start:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, _ = _open(shared)
        for texts in batches:
            yield pd.Series([[] if t is None or automaton is None else [(w, end - len(w) + 1) for end, w in automaton.iter(t)] for t in texts], dtype=object)

    return found


def located(texts: DataFrame, body: Column, terms: DataFrame, term: str = "term", name: str = "spots") -> DataFrame:
    """texts with the column `name`: each occurrence (term, start) of each term in body, overlapping ones too, from 0; the empty term has none."""
    parts = [_spots(block)(body) for block in _blocks(terms, term)]
    return texts.withColumn(name, parts[0] if len(parts) == 1 else F.concat(*parts))


def _owned(block: tuple, kind: str):
    @F.pandas_udf(f"array<{kind}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, _ = _open(block)
        who = block[1].value
        for texts in batches:
            yield pd.Series([[] if t is None or automaton is None else list({o for w in {w for _, w in automaton.iter(t)} for o in who[w]}) for t in texts], dtype=object)

    return found


def owners(texts: DataFrame, body: Column, owned: DataFrame, owner: str, term: str = "term", name: str = "owners") -> DataFrame:
    """texts with the column `name`: the distinct owners of whose terms (owner, term) body has any; null and empty terms are no one's.

    What a common term would multiply, a row for each of its owners in each text, never becomes rows.
    """
    kind = dict(owned.dtypes)[owner]
    lists = owned.filter(F.length(term) > 0).groupBy(F.col(term).alias("term")).agg(F.collect_set(owner).alias("who"))
    size = lists.agg(F.coalesce(F.sum(F.octet_length("term") + 8 * F.size("who")), F.lit(0))).first()[0]
    n, parts = -(-size // BLOCK_BYTES) or 1, []
    for b in range(n):
        held = {r["term"]: tuple(r["who"]) for r in lists.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == b).collect()}
        block = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(held)
        parts.append(_owned(block, kind)(body))
    return texts.withColumn(name, parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts)))
