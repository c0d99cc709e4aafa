"""Reply threads: projection of comments to a graph, cycles, bounded ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.sources.shared import Kept

VISIBLE = ("sanitized", "indexed")


def on_cycle(nodes: DataFrame, depth: int = 20, by: str = "article_id", node: str = "comment_id", parent: str = "parent_id") -> DataFrame:
    """(by, node) of the nodes on a cycle or with ancestors that enter one.

    Pointer doubling: after `depth` rounds a chain of fewer than 2^depth ancestors has ended, so whoever still has an
    ancestor leads into a cycle. Rounds stop early once no node has one; each is a table of the shared folder.
    """
    jump = nodes.filter(F.col(parent).isNotNull()).select(by, node, F.col(parent).alias("up"))
    known = nodes.select(by, F.col(node).alias("up")).distinct()
    with Kept(nodes.sparkSession) as kept:
        jump = kept.keep(jump.join(known, [by, "up"], "left_semi").select(by, node, "up"))
        for _ in range(depth):
            if jump.isEmpty():
                break
            higher = jump.select(by, F.col(node).alias("up"), F.col("up").alias("far"))
            jump = kept.keep(jump.join(higher, [by, "up"]).select(by, node, F.col("far").alias("up")))
        return kept.settled(jump.select(by, node).distinct())


def project(comments: DataFrame, depth: int = 20) -> DataFrame:
    """Edges of each article's thread: (article_id, kind, source, target, complete).

    Visible comments hang on their article (has_comment); a reply hangs on its parent (reply_to) if the parent is visible
    and no ancestor lies on a cycle, else it only makes the thread incomplete. A missing grandparent changes nothing.
    """
    shown = comments.filter(F.col("status").isin(*VISIBLE))
    loops = on_cycle(shown, depth).withColumn("loop", F.lit(True))
    parents = shown.select("article_id", F.col("comment_id").alias("parent_id"), F.lit(True).alias("there"))
    checked = shown.join(parents, ["article_id", "parent_id"], "left").join(loops, ["article_id", "comment_id"], "left")
    ok = F.col("there").isNotNull() & F.col("loop").isNull()
    replies = checked.filter("parent_id is not null").withColumn("ok", ok)
    broken = replies.groupBy("article_id").agg(F.min("ok").alias("complete"))
    edges = shown.select("article_id", F.lit("has_comment").alias("kind"), F.col("article_id").alias("source"), F.col("comment_id").alias("target"))
    edges = edges.unionByName(replies.filter("ok").select("article_id", F.lit("reply_to").alias("kind"), F.col("comment_id").alias("source"), F.col("parent_id").alias("target")))
    return edges.join(broken, "article_id", "left").withColumn("complete", F.coalesce("complete", F.lit(True)))


def bounded(comments: DataFrame, most: int) -> DataFrame:
    """The first `most` comments of each article by id, and whether there were more."""
    w = Window.partitionBy("article_id")
    numbered = comments.withColumn("n", F.row_number().over(w.orderBy("comment_id"))).withColumn("truncated", F.count("*").over(w) > most)
    return numbered.filter(F.col("n") <= most).drop("n")


def ancestors(comments: DataFrame, start: DataFrame, hops: int = 8) -> DataFrame:
    """(article_id, comment_id, ancestor_id, hop): the start comments and up to `hops` ancestors of each."""
    links = comments.select("article_id", F.col("comment_id").alias("ancestor_id"), F.col("parent_id").alias("next"))
    level = start.select("article_id", "comment_id").withColumn("ancestor_id", F.col("comment_id")).withColumn("hop", F.lit(0))
    out = level
    for hop in range(1, hops + 1):
        level = level.join(links, ["article_id", "ancestor_id"]).filter("next is not null").select("article_id", "comment_id", F.col("next").alias("ancestor_id"), F.lit(hop).alias("hop"))
        out = out.unionByName(level)
    return out


def context(evidence: DataFrame, comments: DataFrame, most: int = 3, length: int = 400) -> DataFrame:
    """evidence with up to `most` indexed comments of its article, cut to `length`; order and scores stay."""
    key = F.regexp_extract("source_key", r"^(?:comment:)?article:\d+:(\d+)", 1)
    shown = comments.filter(F.col("status") == "indexed").withColumn("n", F.row_number().over(Window.partitionBy("article_id").orderBy("comment_id"))).filter(F.col("n") <= most)
    lists = shown.groupBy(F.col("article_id").cast("string").alias("_a")).agg(F.array_sort(F.collect_list(F.struct("comment_id", F.substring("text", 1, length).alias("text")))).alias("thread"))
    return evidence.withColumn("_a", F.nullif(key, F.lit(""))).join(lists, "_a", "left").drop("_a")
