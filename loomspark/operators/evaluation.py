"""Retrieval and answer quality over tables of cases and predictions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.sources.shared import Kept

#: Release thresholds: (metric, comparison, value).
GATE = (("recall", ">=", 0.85), ("mrr", ">=", 0.70), ("min_family_recall", ">=", 0.75), ("term_rate", ">=", 0.85), ("unsupported_rate", "<", 0.02), ("source_match", "=", 1.0), ("security_violations", "=", 0.0))


def ranked_cases(cases: DataFrame, predictions: DataFrame, k: int = 10) -> DataFrame:
    """Per case: recall and reciprocal rank within the first k, all terms said, unsupported, exact sources, security.

    cases (id, family, expected_sources, expected_terms, no_evidence, security, banned); predictions (id, sources, answer).
    Every case needs exactly one prediction.
    """
    uncovered = cases.select("id").join(predictions.select("id"), "id", "left_anti").union(predictions.select("id").join(cases.select("id"), "id", "left_anti"))
    if not uncovered.isEmpty() or cases.count() != predictions.count():
        raise ValueError("predictions must cover the cases exactly")
    first = F.slice("sources", 1, k)
    hits = F.size(F.array_intersect("expected_sources", first))
    places = F.filter(F.transform("expected_sources", lambda s: F.array_position(first, s)), lambda p: p > 0)
    said = F.lower(F.coalesce("answer", F.lit("")))
    return cases.join(predictions, "id").select(
        "id", "family", "no_evidence", "security",
        F.when(F.size("expected_sources") > 0, hits / F.size("expected_sources")).alias("recall"),
        F.when(F.size("expected_sources") > 0, F.coalesce(1.0 / F.array_min(places), F.lit(0.0))).alias("rr"),
        F.forall("expected_terms", lambda t: F.contains(said, F.lower(t))).alias("all_terms"),
        (F.col("no_evidence") & (F.size("sources") > 0)).alias("unsupported"),
        (F.array_sort(F.array_distinct("sources")) == F.array_sort(F.array_distinct("expected_sources"))).alias("exact_sources"),
        (F.col("security") & F.exists("banned", lambda t: F.contains(said, F.lower(t)))).alias("violation"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """One row of the suite's figures; the least family recall is the minimum of the families' means."""
    families = scored.groupBy("family").agg(F.avg("recall").alias("r")).agg(F.min("r").alias("min_family_recall"))
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    whole = scored.agg(
        F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), rate("all_terms").alias("term_rate"), rate("unsupported").alias("unsupported_rate"),
        F.avg(F.when(~F.col("no_evidence"), F.when(F.col("exact_sources"), 1.0).otherwise(0.0))).alias("source_match"), F.sum(F.when(F.col("violation"), 1.0).otherwise(0.0)).alias("security_violations"),
    )
    return whole.join(F.broadcast(families))


def passed(figures: DataFrame, gate: tuple = GATE) -> DataFrame:
    """The figures with `passed`: whether all thresholds hold."""
    return figures.withColumn("passed", F.expr(" and ".join(f"coalesce({m} {op} {v}, false)" for m, op, v in gate)))


#: Figures of the post-level protocol; each needs a threshold.
POST_FIGURES = ("answer_source_recall_at_k", "mrr_at_k", "source_containment_rate", "claim_recall", "complete_answer_rate", "attribution_rate", "abstention_accuracy")


def claims(cases: DataFrame, predictions: DataFrame, target: str = "", k: int = 8, attribution: tuple[str, ...] = (), abstention: tuple[str, ...] = ()) -> DataFrame:
    """Per case of a post-level protocol: hit, reciprocal rank, contained (all its sources are of the target post), claims met and wanted, complete, attributed, abstained.

    cases (id, expected_sources, required_claims array of arrays, answerable); predictions (id, sources, answer). A claim
    needs one of its alternatives; only letters and digits count.
    """
    flat = lambda t: F.regexp_replace(F.lower(t), r"(?U)[\W_]+", "")
    said = flat(F.coalesce("answer", F.lit("")))
    first = F.slice("sources", 1, k)
    met = F.filter("required_claims", lambda c: F.exists(c, lambda t: F.contains(said, flat(t))))
    places = F.filter(F.transform("expected_sources", lambda s: F.array_position(first, s)), lambda p: p > 0)
    any_of = lambda terms: F.greatest(*[F.contains(said, flat(F.lit(t))) for t in terms], F.lit(False)) if terms else F.lit(False)
    return cases.join(predictions, "id").select(
        "id", "answerable", (F.size(places) > 0).alias("hit"), F.coalesce(1.0 / F.array_min(places), F.lit(0.0)).alias("rr"),
        ((F.size(first) > 0) & F.forall(first, lambda s: F.contains(s, F.lit(target)))).alias("contained"),
        F.size(met).alias("met"), F.size("required_claims").alias("wanted"), (F.size(met) == F.size("required_claims")).alias("complete"),
        any_of(attribution).alias("attributed"), ((F.size("sources") == 0) & any_of(abstention)).alias("abstained"),
    )


def post_summary(scored: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row: POST_FIGURES of claims(), and with thresholds whether all are reached. All but the last are of answerable cases."""
    share = lambda c, of: F.avg(F.when(of, F.col(c).cast("double")))
    yes = F.col("answerable")
    figures = scored.agg(
        share("hit", yes).alias(POST_FIGURES[0]), share("rr", yes).alias(POST_FIGURES[1]), share("contained", yes).alias(POST_FIGURES[2]),
        (F.sum(F.when(yes, F.col("met"))) / F.sum(F.when(yes, F.col("wanted")))).alias(POST_FIGURES[3]), share("complete", yes).alias(POST_FIGURES[4]),
        share("attributed", yes).alias(POST_FIGURES[5]), share("abstained", ~yes).alias(POST_FIGURES[6]),
    )
    return passed(figures, tuple((m, ">=", v) for m, v in thresholds.items())) if thresholds else figures


def protocol_problems(cases: DataFrame, thresholds: dict[str, float], target: str) -> DataFrame:
    """(problem, id): what is wrong with a protocol, id null for what concerns all of it.

    Ids are unique; there are answerable and control cases; queries are not blank; answerable cases have sources, all of
    the target post, and claims, controls neither; thresholds name POST_FIGURES exactly and lie between 0 and 1.
    """
    spark = cases.sparkSession
    s = cases.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(F.col("answerable"), 1)).alias("yes"), F.count(F.when(~F.col("answerable"), 1)).alias("no"))
    whole = s.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != F.col("ids"), "id twice"), F.when(F.col("yes") == 0, "no answerable case"), F.when(F.col("no") == 0, "no control case")))).alias("problem"), F.lit(None).cast("string").alias("id"))
    sources, wanted = F.size("expected_sources"), F.size("required_claims")
    each = F.array_compact(F.array(
        F.when(F.trim("query") == "", "blank query"), F.when(F.col("answerable") & ((sources == 0) | (wanted == 0)), "answerable without gold"),
        F.when(F.col("answerable") & F.exists("expected_sources", lambda x: ~F.contains(x, F.lit(target))), "source of another post"), F.when(~F.col("answerable") & ((sources > 0) | (wanted > 0)), "control with gold"),
    ))
    own = cases.select(F.explode(each).alias("problem"), F.col("id").cast("string").alias("id"))
    bad = set(thresholds) != set(POST_FIGURES) or any(not 0 <= v <= 1 for v in thresholds.values())
    limits = spark.createDataFrame([("thresholds", None)] if bad else [], "problem string, id string")
    return whole.unionByName(own).unionByName(limits)


def percentile(values: DataFrame, by: list[str], value: str, share: float = 0.95, most: int = 100_000, bins: int = 1024) -> DataFrame:
    """(*by, value) at a share of each group's sorted values: the one at position ceil(share * n), exact; null without values.

    Selection by histograms, without lists: each round counts the values that may still be the one in `bins` equal bins
    between their least and greatest and goes on with one bin, until it has at most `most` values or a single one. So a
    group of any size is counted where its rows lie, and at most `most` of its values are ordered. Values are numbers.
    """
    keys = [F.col(c) for c in by]
    rows = values.select(*by, F.col(value).alias("v")).filter("v is not null")
    with Kept(values.sparkSession) as kept:
        sought = kept.keep(rows.groupBy(*keys).agg(F.ceil(F.count("*") * F.lit(share)).alias("at"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.lit(0).cast("long").alias("below")))
        while not sought.filter((F.col("n") > most) & (F.col("low") < F.col("high"))).isEmpty():
            width = (F.col("v") - F.col("low")).cast("double") / F.nullif((F.col("high") - F.col("low")).cast("double"), F.lit(0.0))
            number = F.coalesce(F.least(F.lit(bins - 1), F.floor(width * bins)), F.lit(0)).cast("int")
            counted = _inside(rows, sought, by).groupBy(*keys, "at", "below", number.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            upto = F.col("below") + F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
            chosen = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("n") < F.col("at")))
            sought = kept.keep(chosen.select(*by, "at", "n", "low", "high", (F.col("upto") - F.col("n")).alias("below")))
        counted = _inside(rows, sought, by).groupBy(*keys, "at", "below", "v").agg(F.count("*").alias("n"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*by).orderBy("v"))
        found = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("n") < F.col("at"))).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("v").alias(value))
        return kept.settled(values.select(*by).distinct().join(found, _equal(by), "left").select(*by, value))


def _equal(by: list[str]) -> Column:
    """Equal keys, null with null."""
    return functools.reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))


def _inside(rows: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the least and greatest value that their group still has to do with, and what is sought there."""
    held = sought.select(*[F.col(c).alias(f"_{c}") for c in by], "at", "below", "low", "high")
    return rows.join(held, _equal(by)).filter(F.col("v").between(F.col("low"), F.col("high"))).select(*by, "v", "at", "below", "low", "high")
