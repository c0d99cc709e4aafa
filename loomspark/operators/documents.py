"""JSON documents of any depth as VARIANT: taken apart level by level, changed, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.sources.shared import Kept


def quoted(value: Column) -> Column:
    """A string as JSON text."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def redacted(documents: DataFrame, key: str = "id", document: str = "document", keys: tuple = text.SENSITIVE_KEYS) -> DataFrame:
    """documents (key, document) with the values of sensitive fields replaced at any depth, inside lists too.

    A sensitive field goes with all that is in it; its name counts in capitals or not. Other strings lose credentials in
    addresses and are masked; numbers, booleans and nulls stay. Fields stand in the order of their names, without blanks.
    What is no JSON becomes null. key is unique; null keys and other columns stay as they are, through the join by key.

    Each level of all documents is one step, down to the deepest and up again, so the steps grow with depth only.
    """
    spark = documents.sparkSession
    with Kept(spark) as kept:
        root = F.try_parse_json(document)
        level = documents.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("field"), F.lit(0).alias("pos"), root.alias("v")).filter("v is not null")
        levels = []
        while True:
            named = F.coalesce(F.lower("field").isin(*keys), F.lit(False))
            said = text.masked(F.regexp_replace(F.variant_get("v", "$", "string"), text._CREDENTIAL_URL, "<redacted-url>"))
            kind = F.when(named, "leaf").when(_is(F.col("v"), "OBJECT"), "object").when(_is(F.col("v"), "ARRAY"), "array").otherwise("leaf")
            own = F.when(named, F.lit('"<redacted>"')).when(_is(F.col("v"), "STRING"), quoted(said)).otherwise(F.to_json("v"))
            seen = kept.keep(level.select("id", "path", "field", "pos", kind.alias("kind"), own.alias("text"), F.when(kind != "leaf", F.col("v")).alias("v")))
            levels.append(seen.drop("v"))
            inner = seen.filter("kind <> 'leaf'").select("id", F.concat_ws("/", "path", F.col("pos").cast("string")).alias("path"), F.col("v").alias("outer"))
            if inner.isEmpty():
                break
            level = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer").outer())).select("id", "path", F.col("key").alias("field"), "pos", F.col("value").alias("v"))
        below = None
        for seen in reversed(levels):
            if below is not None:
                at = F.concat_ws("/", "path", F.col("pos").cast("string"))
                whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("inside", F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce("inside", F.lit("")), F.lit("]"))).otherwise(F.col("text"))
                seen = seen.withColumn("at", at).join(below, ["id", "at"], "left").select("id", "path", "field", "pos", "kind", whole.alias("text"))
            else:
                seen = seen.withColumn("text", F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(F.col("text")))
            part = F.concat(F.when(F.col("field").isNotNull(), F.concat(quoted(F.col("field")), F.lit(":"))).otherwise(""), "text")
            lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda p: p["part"])
            top, below = seen, seen.groupBy("id", F.col("path").alias("at")).agg(F.array_join(lists, ",").alias("inside"))
        done = top.select(F.col("id").alias(key), F.col("text").alias("_text"))
        return kept.settled(documents.join(done, key, "left").withColumn(document, F.col("_text")).drop("_text"))
