"""The write path of the index: chunk what is sanitised, replace versions, ask for missing embeddings; and media checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import chunking, merge


def index_sources(documents: DataFrame, chunks: DataFrame, rebuild: bool = False, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """The chunks after indexing, and the documents with their next status.

    documents: what chunking.chunk reads and status; sanitised ones are chunked, with rebuild those that are indexed
    already as well. chunks: the columns of chunking.chunk and active. Chunks of re-indexed sources that are not made
    again are switched off, equal ones are active again.
    """
    wanted = F.col("status").isin("sanitized", "indexed") if rebuild else F.col("status") == "sanitized"
    made = chunking.chunk(documents.filter(wanted), **bounds)
    done = documents.withColumn("status", F.when(wanted, "indexed").otherwise(F.col("status")))
    return merge.replace_versions(chunks, made), done


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, revision: str) -> DataFrame:
    """(chunk_id, text) of active chunks without an embedding of the revision: what an embedder is asked for."""
    held = embeddings.filter(F.col("revision") == revision).select("chunk_id")
    return chunks.filter("active").select("chunk_id", "text").join(held, "chunk_id", "left_anti")


def checked_vectors(asked: DataFrame, answered: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, embedding) of a provider's answer; refused unless it has each asked chunk once, with a finite vector of the dimension."""
    v = F.col("embedding")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    both = asked.select("chunk_id", F.lit(1).alias("asked")).join(answered.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min(F.coalesce(fine, F.lit(False))).alias("fine")), "chunk_id", "full_outer")
    if not both.filter("asked is null or n is null or n <> 1 or not fine").isEmpty():
        raise ValueError("the answer does not match what was asked")
    return answered


def synced(old: DataFrame, new: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Entities, aliases or relations of a catalog merged into those held: new values win and are active, rows of the
    same source that the catalog no longer has are switched off, other sources stay."""
    held = merge.upsert(old, new.withColumn("active", F.lit(True)).select(*old.columns), keys)
    return merge.deactivate_missing(held, new, keys, scope=F.col("source_id") == source)


def excluded(articles: DataFrame, comments: DataFrame, chunks: DataFrame, tombstones: DataFrame, gone: DataFrame, at: Column) -> dict[str, DataFrame]:
    """All tables after articles are excluded: gone (source_key, reason, actor), actor null where the source itself deleted them.

    Bodies, authors and hashes are blanked, status becomes denied or deleted, chunks of the article, its comments and
    images are switched off, tombstones are written over. A person's exclusion also gives a denylist entry.
    """
    mark = gone.select("source_key", F.when(F.col("actor").isNotNull(), "denied").otherwise("deleted").alias("_next"))
    blank = lambda df, key: df.join(mark.withColumnRenamed("source_key", key), key, "left")
    hit = F.col("_next").isNotNull()
    article = blank(articles, "source_key").select(*[
        {"status": F.coalesce("_next", "status"), "body": F.when(hit, "").otherwise(F.col("body")), "author": F.when(~hit, F.col("author")), "content_hash": F.when(hit, "0" * 64).otherwise(F.col("content_hash"))}.get(c, F.col(c)).alias(c)
        for c in articles.columns
    ])
    comment = blank(comments, "article_key").select(*[
        {"status": F.coalesce("_next", "status"), "body": F.when(hit, "").otherwise(F.col("body")), "author": F.when(~hit, F.col("author"))}.get(c, F.col(c)).alias(c) for c in comments.columns
    ])
    stones = gone.select("source_key", at.alias("deleted_at"), "reason")
    denied = gone.filter("actor is not null").select("source_key", "reason", "actor", F.lit(True).alias("active"))
    return {"articles": article, "comments": comment, "chunks": merge.exclusion_cascade(chunks, gone), "tombstones": merge.upsert(tombstones, stones, ["source_key"]), "denylist": denied}


def allowed_image(mime: Column | str, size: Column | str, width: Column | str, height: Column | str, kinds: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp", "image/gif"), most_bytes: int = 5 << 20, most_pixels: int = 20_000_000) -> Column:
    """Whether an image may be read: its type, at most so many bytes and pixels."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.lower(c(mime)).isin(*kinds) & (c(size) > 0) & (c(size) <= most_bytes) & (c(width).cast("long") * c(height) <= most_pixels), F.lit(False))


def recognised(words: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, text, confidence) of recognised words (by, pos, word, confidence): the mean of those not negative, as a share."""
    good = words.filter((F.trim("word") != "") & (F.col("confidence") >= 0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("word").alias("w")))), lambda x: x["w"]), " ")
    found = good.groupBy(by).agg(said.alias("text"), F.least(F.lit(1.0), F.avg("confidence") / 100).alias("confidence"))
    return words.select(by).distinct().join(found, by, "left").fillna({"text": "", "confidence": 0.0})


def bounded_listing(articles: DataFrame, most: int, full: bool, by: str = "board_id", order: str = "pos") -> DataFrame:
    """The first articles of each board; a full crawl refuses to leave any out."""
    from loomspark.operators.retrieval import top

    if full and not articles.groupBy(by).count().filter(F.col("count") > most).isEmpty():
        raise ValueError("a listing has more articles than the bound of a full crawl")
    return top(articles, [by], [F.col(order)], most, "_rank").drop("_rank")
