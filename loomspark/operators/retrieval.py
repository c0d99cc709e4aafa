"""Batched retrieval: every function takes all queries at once, keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import scalars, text
from loomspark.operators import trigram
from loomspark.operators.terms import owners
from loomspark.sources.shared import Kept


def active(df: DataFrame, *flags: str) -> DataFrame:
    """Rows of which all flags are true."""
    for flag in flags:
        df = df.filter(F.col(flag))
    return df


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark cuts the groups before they are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; Spark chooses the join otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(corpus: DataFrame, cid: str = "chunk_id", body: str = "text") -> DataFrame:
    """Distinct (token, cid) of the lower-cased runs of letters and digits; written once, it serves all queries."""
    words = F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return corpus.select(F.col(cid), F.explode(F.array_distinct(words)).alias("token"))


def write_index(corpus: DataFrame, folder: str, buckets: int = 64, cid: str = "chunk_id", body: str = "text") -> None:
    """The index at rest: postings (token, cid) and the dictionary of tokens, in partitions by the token's first sign, sorted inside files."""
    bucket = F.pmod(F.xxhash64(F.substring("token", 1, 1)), F.lit(buckets)).cast("int").alias("bucket")
    found = postings(corpus, cid, body).select(F.col(cid).alias("cid"), "token", bucket)
    found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "cid").write.partitionBy("bucket").parquet(f"{folder}/postings")
    tokens = corpus.sparkSession.read.parquet(f"{folder}/postings").groupBy("bucket", "token").agg(F.count("*").alias("n"))
    tokens.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").option("parquet.block.size", 1 << 20).parquet(f"{folder}/tokens")
    spark = corpus.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/layout")


def keyword_hits(queries: DataFrame, folder: str, spark: SparkSession, most: int = 600, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """(qid, cid) of chunks of an index at rest with a token that starts with a keyword of the query, the first `most` by id of each keyword at least.

    Only partitions of the keywords' first signs are read. Words and tokens of the dictionary meet by an equi-join on up
    to three first signs that is checked in full; the tokens found then join their postings. The first `most` chunks of a
    query are among those of its keywords, and those of a keyword among those of its tokens, so a common token or keyword
    hands on no more, however many chunks have it and queries ask for it.
    """
    asked = queries.select(qid, F.explode(text.keywords("query")).alias("word")).select(qid, F.lower("word").alias("word")).distinct()
    buckets = spark.read.parquet(f"{folder}/layout").first()[0]
    words = asked.select("word").distinct().withColumn("head", F.substring("word", 1, 3))
    wanted = [r[0] for r in words.select(F.pmod(F.xxhash64(F.substring("word", 1, 1)), F.lit(buckets)).cast("int")).distinct().collect()]
    held = lambda name: spark.read.parquet(f"{folder}/{name}").filter(F.col("bucket").isin(wanted)).withColumn("h", F.xxhash64("token"))
    heads = held("tokens").select("h", "token", F.explode(F.array_distinct(F.array(*[F.substring("token", 1, n) for n in (1, 2, 3)]))).alias("head"))
    forms = heads.join(small(words), "head").filter(F.startswith("token", F.col("word"))).select("h", "token", "word")
    spots = top(held("postings").select("h", "token", "cid"), ["h", "token"], [F.col("cid")], most).join(forms, ["h", "token"])  # numbers sort faster
    place = F.dense_rank().over(Window.partitionBy("word").orderBy("cid"))  # a chunk with several tokens of a keyword counts once
    first = spots.select("word", "cid", place.alias("place")).filter(F.col("place") <= most).select("word", "cid").distinct()
    return first.join(small(asked), "word").select(qid, F.col("cid").alias(cid)).distinct()


def lexical(queries: DataFrame, corpus: DataFrame, index: str | None = None, stage1: int = 600, k: int = 200, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """Two-stage lexical search: (qid, cid, score, rank).

    Stage 1 takes the first stage1 chunks by id with a token that starts with a keyword of the query; stage 2 ranks
    those of positive trigram similarity, ties by id. Queries without keywords or stage-2 rows are compared with every
    chunk. index is the folder of an index at rest, of which only what the keywords need is read; without one, a pass
    over the texts finds all keywords at once. What stage 2 scores has at most stage1 rows a query and is written to the
    shared folder, as it is read twice.
    """
    spark = corpus.sparkSession
    asked = queries.select(qid, F.explode(text.keywords("query")).alias("word")).select(qid, F.concat(F.lit(" "), F.lower("word")).alias("word")).distinct()
    if index is None:
        tokens = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
        held = owners(corpus.select(cid, "text"), F.concat(F.lit(" "), tokens), asked, qid, "word")
        met = held.select(cid, F.explode("owners").alias(qid))
    else:
        met = keyword_hits(queries, index, spark, stage1, qid, cid)
    first = top(met, [qid], [F.col(cid)], stage1).select(qid, cid)
    with Kept(spark) as kept:
        found = kept.keep(trigram.scored(first, queries, corpus, qid, cid).filter("score > 0"))
        ranked = top(found, [qid], [F.desc("score"), F.col(cid)], k)
        rest = queries.join(found.select(qid).distinct(), qid, "left_anti")
        return kept.settled(ranked if rest.isEmpty() else ranked.unionByName(trigram.similar(rest, corpus, k, qid, cid)))


def fuse(ranked: list[DataFrame], k: int = 60, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, cid, rank): (qid, cid, rrf). One shuffle, whatever the number of lists."""
    both = None
    for one in ranked:
        part = one.select(qid, cid, (1.0 / (k + F.col("rank"))).alias("share"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(qid, cid).agg(F.sum("share").alias("rrf"))


def cap_groups(fused: DataFrame, score: str = "score", group: str = "group_key", per_group: int = 3, k: int = 30, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """At most per_group rows of a group in score order, then the first k of the query."""
    order = [F.desc(score), F.col(cid)]
    kept = top(fused, [qid, group], order, per_group, "in_group")
    return top(kept, [qid], order, k)


def best_of_groups(reranked: DataFrame, score: str = "rerank", least: float = 0.15, group: str = "group_key", k: int = 8, qid: str = "query_id", cid: str = "chunk_id") -> DataFrame:
    """The best row of each group with at least this score, then the first k of the query."""
    order = [F.desc(score), F.desc("score"), F.col(cid)]
    best = top(reranked.filter(F.col(score) >= least), [qid, group], order, 1, "in_group")
    return top(best, [qid], order, k)


def by_authority(evidence: DataFrame, official: bool, k: int, qid: str = "query_id", authority: str = "source_authority") -> DataFrame:
    """The first k passages of each query that are, or are not, of an official source, by rank."""
    own = F.coalesce(F.col(authority) == "official", F.lit(False))
    return top(evidence.filter(own if official else ~own), [qid], [F.col("rank")], k, "place")


def calibrated(model: Column, query: Column | str, title: Column | str, source_key: Column | str) -> Column:
    """The model's score; for articles at least 0.6 of the title's coverage of the query."""
    floor = F.least(F.lit(1.0), 0.6 * text.coverage(query, title))
    return F.when(F.startswith(F.col(source_key) if isinstance(source_key, str) else source_key, F.lit("article:")), F.greatest(model, floor)).otherwise(model)


def hybrid(queries: DataFrame, corpus: DataFrame, dense: DataFrame, lexical_hits: DataFrame, boost: Column | None = None, per_group: int = 3, fused_k: int = 30, least: float = 0.15, k: int = 8) -> DataFrame:
    """Fusion, boosts, group caps, rerank by trigram similarity with title calibration, and group diversity.

    corpus: chunk_id, source_key, group_key, title, text and what boost uses. Where queries have a column groups (array
    of arrays of terms), a chunk must have a term of every group; where they have anchors (array of terms), chunks that
    name them get a bonus. Texts join the rows that are left after the caps, or before them where groups or anchors
    read them. A query without result is left out.
    """
    reads = [c for c in ("groups", "anchors") if c in queries.columns]
    fused = fuse([dense, lexical_hits]).join(corpus if reads else corpus.drop("text"), "chunk_id")
    score = F.col("rrf") + (boost if boost is not None else F.lit(0.0))
    if reads:
        fused = fused.join(queries.select("query_id", *reads), "query_id")
        title, body = text.normalized("title"), text.normalized("text")
        if "groups" in reads:
            fused = fused.filter(scalars.in_scope("groups", F.concat_ws(" ", title, body)))
        if "anchors" in reads:
            score = score + scalars.anchor_boost("anchors", title, body, "source_key")
    kept = cap_groups(fused.withColumn("score", score).drop("text", *reads), per_group=per_group, k=fused_k).drop("rank", "in_group")
    model = trigram.similarity("query", "text")
    rated = kept.join(corpus.select("chunk_id", "text"), "chunk_id").join(queries.drop(*reads), "query_id").withColumn("rerank", calibrated(model, "query", "title", "source_key"))
    return best_of_groups(rated, least=least, k=k)
