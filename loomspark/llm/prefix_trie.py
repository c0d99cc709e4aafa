"""The prefix trie of conversations as preorder intervals.

Sequences of turns are ranked in lexicographic order; equal sequences share a rank. A node is the set of conversations
that start with one sequence, so its members' ranks are an interval. Sorted by (least rank, depth) the nodes stand in
preorder, and a subtree ends with the last node whose least rank is at most the node's greatest. Whatever is summed over a
subtree is then the difference of two running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, cut, parts
from loomspark.llm.running import running

#: Turns of a block: longer sequences are ranked by the ranks of their blocks.
BLOCK = 64
#: Characters of a piece of joined ids.
PIECE = 1 << 16


def digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of the SHA-256 of a turn's role and text, nulls as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def turns(conversations: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, n, symbol, chars): each conversation's turns numbered from 1, by turn (null first), ties by digest.

    Rows without conv_id belong to no conversation. Other columns of the input are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest().alias("symbol"), F.length(text).cast("long").alias("chars"))
    return running(rows, ["conv_id", "turn", "symbol"], {"n": F.lit(1)}, scratch, group="conv_id").select("conv_id", "n", "symbol", "chars")


def _ranked(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, rank) of sequences (conv_id, depth, symbol): ranks from 1 in lexicographic order, equal for equal ones.

    Each round ranks blocks of BLOCK symbols and puts their ranks in their places, until every sequence is one block.
    """
    level = sequences.select("conv_id", (F.col("depth") - 1).alias("i"), "symbol")
    while True:
        place = F.struct((F.col("i") % BLOCK).alias("i"), "symbol")
        blocks = level.groupBy("conv_id", F.floor(F.col("i") / BLOCK).alias("i")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["symbol"]).alias("key"))
        blocks = scratch.keep(blocks)
        index = running(blocks.select("key").distinct(), ["key"], {"rank": F.lit(1)}, scratch)
        level = blocks.join(index, "key").select("conv_id", "i", F.col("rank").alias("symbol"))
        if blocks.filter("i > 0").isEmpty():
            return level.select("conv_id", F.col("symbol").alias("rank"))


def _ends(classes: DataFrame) -> DataFrame:
    """(rank, ends_sha256) of (rank, conv_id): the digest of each class's ids, ascending and joined by commas.

    Ids are joined to pieces where ranges of them lie; a class's digest then runs over its pieces, one after the other.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rank, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
                ids = [c for _, c in rows]
                for at in range(0, len(ids), PIECE // 16):
                    out.append((rank, ids[at], ",".join(map(str, ids[at : at + PIECE // 16]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["rank", "at", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], type=pa.int64()), pa.array([h for _, h in rows], type=pa.string())], names=["rank", "ends_sha256"])

        last, state = None, None
        for batch in batches:
            done = []
            for rank, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rank != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = rank, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield made(done)
        if last is not None:
            yield made([(last, state.hexdigest())])

    n = parts(classes.sparkSession)
    pieces = classes.select("rank", "conv_id").repartitionByRange(n, "rank", "conv_id").sortWithinPartitions("rank", "conv_id").mapInArrow(join, "rank long, at long, piece string")
    return pieces.repartition(n, "rank").sortWithinPartitions("rank", "at").mapInArrow(hashed, "rank long, ends_sha256 string")


def trie(sequences: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, depth from 1 without gaps, symbol binary, chars).

    conversations (conv_id, unique) names all members; one without a row in sequences ends at the root. A node has
    conv_id (its least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes
    in its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) x chars of the last turn) and
    ends_sha256 (of the ids of conversations that end there). No conversation gives no node. Two different prefixes are
    told apart by the sums of 128-bit hashes of their turns in their places.

    A prefix that many share is counted where its rows lie before it is dealt; ids of many copies are hashed in pieces.
    """
    low = F.lit(0xFFFFFFFF)
    lanes = {}
    for i in range(2):
        h = F.xxhash64("symbol", "depth", F.lit(i))
        lanes |= {f"s{2 * i}": F.shiftrightunsigned(h, 32), f"s{2 * i + 1}": h.bitwiseAND(low)}
    own = sequences.select("conv_id", F.col("depth").cast("long").alias("depth"), "symbol", "chars")
    summed = running(own, ["conv_id", "depth"], lanes, scratch, group="conv_id")
    pack = lambda a, b: F.shiftleft(a.bitwiseAND(low), 32).bitwiseOR(b.bitwiseAND(low))
    before = {n: F.col(n) - e for n, e in lanes.items()}
    prefixes = scratch.keep(summed.select(
        "conv_id", "depth", "symbol", "chars", pack(F.col("s0"), F.col("s1")).alias("p0"), pack(F.col("s2"), F.col("s3")).alias("p1"),
        pack(before["s0"], before["s1"]).alias("q0"), pack(before["s2"], before["s3"]).alias("q1"),
    ))
    sizes = prefixes.groupBy("conv_id").agg(F.max("depth").alias("size"))
    ranks = _ranked(prefixes, scratch).join(sizes, "conv_id")
    none = F.lit(0).cast("long")
    classes = scratch.keep(conversations.select("conv_id").join(ranks, "conv_id", "left").select("conv_id", F.coalesce("rank", none).alias("rank"), F.coalesce("size", none).alias("size")))

    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last")]
    found = prefixes.select("conv_id", "depth", "p0", "p1", "q0", "q1", "chars").join(classes.select("conv_id", "rank"), "conv_id")
    nodes = found.groupBy("depth", "p0", "p1").agg(*members, F.max("q0").alias("q0"), F.max("q1").alias("q1"), F.max("chars").alias("chars"))
    root = classes.agg(*members).filter("n_convs > 0").select(none.alias("depth"), none.alias("p0"), none.alias("p1"), "conv_id", "n_convs", "first", "last", *[F.lit(None).cast("long").alias(q) for q in ("q0", "q1")], none.alias("chars"))
    nodes = scratch.keep(nodes.unionByName(root))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q0").alias("p0"), F.col("q1").alias("p1")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, ["depth", "p0", "p1"], "left").fillna(0, ["n_children"]).join(parents, ["depth", "q0", "q1"], "left")

    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    preorder = running(nodes.drop("p0", "p1", "q0", "q1"), ["first", "depth"], {"leaves": leaf, "saves": saved}, scratch)
    upto = preorder.groupBy(F.col("first").alias("last")).agg(F.max("leaves").alias("all_leaves"), F.max("saves").alias("all_saves"))
    ends = classes.groupBy("rank").agg(F.max("size").alias("depth")).join(_ends(classes), "rank").withColumnRenamed("rank", "first")
    full = preorder.join(upto, "last").join(ends, ["first", "depth"], "left")
    return cut(full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("all_leaves") - F.col("leaves") + leaf).alias("n_leaves"),
        (F.col("all_saves") - F.col("saves") + saved).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ))


def branched(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Sequences of numbered turns, each opened by the first turns of the conversation at the start of its hundred.

    own: (conv_id, n, symbol, chars). Conversation c gets the first h turns of c - c % group, as many as there are, and its
    own turns after its first h; h = crc32(c as text) % most. Returns (conv_id, depth, symbol, chars).
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    ids = own.groupBy("conv_id").agg(F.max("n").alias("size")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", base)
    there = ids.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    ids = ids.join(there, "base", "left").withColumn("opening", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    first = own.filter((F.col("conv_id") % group == 0) & (F.col("n") < most)).select(F.col("conv_id").alias("base"), "n", "symbol", "chars")
    opened = ids.select("conv_id", "base", "h").join(first, "base").filter("n <= h").select("conv_id", F.col("n").alias("depth"), "symbol", "chars")
    rest = own.join(ids.select("conv_id", "h", "opening"), "conv_id").filter("n > h").select("conv_id", (F.col("n") - F.col("h") + F.col("opening")).alias("depth"), "symbol", "chars")
    return opened.unionByName(rest)
