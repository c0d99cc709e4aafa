"""Upserts and soft deletes as functions from the old and the new rows to the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Insert or update: new values win, but columns in keep stay as first written. Keys are unique on either side."""
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_old"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns], F.lit(True).alias("_new"))
    on = [F.col(f"_o_{c}") == F.col(f"_n_{c}") for c in keys]
    joined = o.join(n, on, "full_outer")
    pick = lambda c: F.when(F.col("_new") & ~(F.col("_old").isNotNull() & F.lit(c in keep)), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
    return joined.select(*[F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in keys], *[pick(c) for c in fields])


def changed_upsert(old: DataFrame, new: DataFrame, key: str, always: tuple[str, ...], digest: str = "content_hash", status: str = "status", reset: str = "sanitized") -> DataFrame:
    """Old and new rows merged with an action: inserted, updated (the digest differs), unchanged or kept (not in new).

    Columns in always take the new value whenever there is one; the others and the status only change with the digest.
    """
    fields = [c for c in old.columns if c not in (key, status)]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in [*fields, status]], F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_new"))
    j = o.join(n, key, "full_outer")
    fresh = F.col("_old").isNull() | (F.col("_new").isNotNull() & ~F.col(f"_o_{digest}").eqNullSafe(F.col(f"_n_{digest}")))
    value = lambda c: F.when(fresh | (F.col("_new").isNotNull() & F.lit(c in always)), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(fresh, "updated").otherwise("unchanged")
    return j.select(key, *[value(c) for c in fields], F.when(fresh, F.lit(reset)).otherwise(F.col(f"_o_{status}")).alias(status), action.alias("action"))


def outbox(merged: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    """Change events of a merge: one per inserted or updated row, with a key that makes replays harmless."""
    return merged.filter(F.col("action").isin("inserted", "updated")).select(F.col(key).alias("source_key"), "action", F.concat_ws(":", F.col(key).cast("string"), F.col(digest)).alias("dedupe_key"))


def upsert_comments(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments after a crawl, and the change events (source_key, topic, dedupe_key).

    Both have (article_key, comment_id, parent_id, author_hash, text, score, status, content_hash, first_observed_at,
    last_observed_at), new has deleted besides and each comment once. What is seen again takes all new values but the time
    of its first sight; a deleted comment has no text. A comment that is new, or has another digest, is an event, under a
    key that makes replays harmless; one that isn't seen stays as it is.
    """
    keys = ["article_key", "comment_id"]
    made = new.withColumn("text", F.when(F.col("deleted"), "").otherwise(F.col("text"))).withColumn("status", F.when(F.col("deleted"), "deleted").otherwise("sanitized"))
    before = old.select(*keys, F.col("content_hash").alias("_hash"), F.lit(True).alias("_old"))
    fresh = made.join(before, keys, "left").filter(F.col("_old").isNull() | ~F.col("_hash").eqNullSafe(F.col("content_hash")))
    source = F.concat_ws(":", F.lit("comment"), "article_key", F.col("comment_id").cast("string"))
    events = fresh.select(source.alias("source_key"), F.when(F.col("deleted"), "comment.deleted").otherwise("comment.sanitized").alias("topic"), F.concat_ws(":", source, "content_hash").alias("dedupe_key"))
    return upsert(old, made.select(*old.columns), keys, keep=("first_observed_at",)), events


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't have, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def deactivate_missing(old: DataFrame, new: DataFrame, keys: list[str], flag: str = "active", scope: Column | None = None) -> DataFrame:
    """old with the flag off where the key isn't in new; only rows in scope are touched."""
    seen = new.select(*keys).distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & (scope if scope is not None else F.lit(True))
    return old.join(seen, keys, "left").withColumn(flag, F.col(flag) & ~gone).select(*old.columns)


def replace_versions(old: DataFrame, new: DataFrame, source: str = "source_key", key: str = "chunk_id", flag: str = "active") -> DataFrame:
    """Chunks after re-indexing: new ones are active, others of a re-indexed source are switched off, the rest stays."""
    touched = new.select(source).distinct().withColumn("_touched", F.lit(True))
    kept = old.join(new.select(key), key, "left_anti").join(touched, source, "left")
    kept = kept.withColumn(flag, F.col(flag) & F.col("_touched").isNull()).select(*old.columns)
    return kept.unionByName(new.withColumn(flag, F.lit(True)).select(*old.columns))


def exclusion_cascade(chunks: DataFrame, excluded: DataFrame, source: str = "source_key", flag: str = "active") -> DataFrame:
    """Chunks of excluded articles, their comments and images switched off; keys are article:…, comment:article:… and ocr:article:…."""
    parent = F.regexp_extract(source, r"^(?:comment:|ocr:)?(article:\d+:\d+)", 1)
    marks = excluded.select(F.col(source).alias("_parent")).distinct().withColumn("_gone", F.lit(True))
    return chunks.withColumn("_parent", parent).join(marks, "_parent", "left").withColumn(flag, F.col(flag) & F.col("_gone").isNull()).select(*chunks.columns)


def activate(revisions: DataFrame, name: str, dim: int = 1024) -> DataFrame:
    """Revisions with this one active and all others not; refused unless it has the dimension and cosine distance."""
    ok = (F.col("dimension") == dim) & (F.col("distance") == "cosine")
    if revisions.filter((F.col("name") == name) & ok).isEmpty():
        raise ValueError(f"revision {name!r} is missing, or not of dimension {dim} and cosine distance")
    return revisions.withColumn("active", F.col("name") == name)


def expire(rows: DataFrame, at: str, cutoff: Column, flag: str = "active") -> DataFrame:
    """Rows with the flag off from before the cutoff on."""
    return rows.withColumn(flag, F.col(flag) & ~F.coalesce(F.col(at) < cutoff, F.lit(False)))


def write_version(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """A new version of a table, written under a path of its own; readers switch once it is complete."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
