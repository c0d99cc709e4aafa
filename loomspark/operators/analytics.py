"""Ranked search by day, popularity scores, terminology audit, guide lookups."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import scalars, text
from loomspark.operators.terms import contained


def day_search(targets: DataFrame, articles: DataFrame, comments: DataFrame, boards: tuple[int, ...], day: str, limit: int = 20, most_comments: int = 10) -> DataFrame:
    """Articles of one day that mention each target, ranked, with their best comments; all targets in one plan.

    targets (target, terms array); articles (article_id, board_id, status, category, title, body, recommended, views,
    published_at, collected_at); comments (article_id, comment_id, body, score, published_at, status). An article counts
    if its text, category or one of its comments has a term; those with a match in the title come first.
    """
    start, end = scalars.day_window(F.lit(day))
    at = F.coalesce("published_at", "collected_at")
    day_rows = articles.filter(F.col("board_id").isin(*boards) & F.col("status").isin("discovered", "sanitized", "indexed") & (at >= start) & (at < end))
    terms = targets.select("target", F.explode("terms").alias("term")).select("target", F.lower("term").alias("term"))
    own = comments.filter(F.col("status").isin("sanitized", "indexed")).join(day_rows.select("article_id"), "article_id", "left_semi")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    direct = contained(day_rows.select("article_id", "title", "body", "category"), {"in_title": low("title"), "in_text": F.concat_ws("\x00", low("body"), low("category"))}, terms)
    titled = lambda df, c, flag: df.select("article_id", F.explode(c).alias("term"), F.lit(flag).alias("titled"))
    by_text = titled(direct, "in_title", True).unionByName(titled(direct, "in_text", False))
    by_comment = titled(contained(own.select("article_id", "body"), {"in_text": low("body")}, terms), "in_text", False)
    said = by_text.unionByName(by_comment).groupBy("article_id", "term").agg(F.max("titled").alias("titled"))
    met = said.join(terms, "term").groupBy("target", "article_id").agg(F.max("titled").alias("titled"))
    counts = own.groupBy("article_id").agg(F.count("*").alias("n_comments"))
    ranked = met.join(day_rows, "article_id").join(counts, "article_id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))
    order = [F.desc("titled"), F.desc("recommended"), F.desc("n_comments"), F.desc("views"), F.desc_nulls_last("at"), F.desc("article_id")]
    ranked = ranked.withColumn("at", at).withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order))).filter(F.col("rank") <= limit)
    w = Window.partitionBy("article_id").orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "comment_id")
    best = own.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_comments)
    lists = best.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("n", "comment_id", text.truncated("body", 500).alias("body")))).alias("comments"))
    return ranked.join(lists, "article_id", "left").select("target", "rank", "article_id", "titled", text.truncated("body", 2400).alias("body"), "comments")


def guide_candidates(articles: DataFrame, comments: DataFrame, topic: Column, titled: Column, now: Column, half_life: float = 45.0, limit: int = 30, most_comments: int = 10) -> DataFrame:
    """Articles on a topic, matches in the title first, then by decayed popularity, with their first comments by id."""
    score = scalars.decay_score("recommended", "views", "n_comments", scalars.age_days("published_at", now), half_life)
    rows = articles.filter(topic).withColumn("titled", titled).withColumn("score", score)
    top = rows.orderBy(F.desc("titled"), F.desc("score"), "article_id").limit(limit)
    n = F.row_number().over(Window.partitionBy("article_id").orderBy("comment_id"))
    first = comments.join(top.select("article_id"), "article_id", "left_semi").withColumn("n", n).filter(F.col("n") <= most_comments)
    lists = first.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("comments"))
    return top.join(lists, "article_id", "left")


def audit_terms(chunks: DataFrame, pairs: DataFrame, letters: str = "가-힣", top: int = 20, ratio: float = 0.55) -> DataFrame:
    """Use of abbreviations and official names: (abbreviation, official, abbreviation_chunks, official_chunks, matching, different, compounds).

    pairs (abbreviation, official) is the catalog's side; each chunk is read once for all its terms, and only chunks with
    an abbreviation are read again, for what is said about it. Nulls are in no chunk.
    matching counts explicit expansions that hold the official name; different lists up to `top` others that
    look like names of the abbreviation (text.resembles); compounds lists the most frequent longer forms, ties by name.
    """
    named = pairs.select(F.explode(F.array("abbreviation", "official")).alias("term")).distinct()
    held = contained(chunks.select("chunk_id", "text"), {"terms": F.col("text")}, named).filter(F.size("terms") > 0)
    flat = lambda c: F.replace(text.normalized(c), F.lit(" "), F.lit(""))
    numbers = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = pairs
    for c in ("abbreviation", "official"):
        counts = counts.join(numbers.select(F.col("term").alias(c), F.col("n").alias(f"{c}_chunks")), c, "left")
    met = held.select("chunk_id", "text", F.explode("terms").alias("abbreviation")).join(pairs, "abbreviation")
    said = met.select("abbreviation", "official", "chunk_id", F.explode(text.expansions("text", "abbreviation")).alias("said"))
    said = said.withColumn("same", F.contains(flat("said"), flat("official")))
    near = said.filter("not same").filter(text.resembles("said", "abbreviation", "official", ratio))
    different = near.groupBy("abbreviation", "official").agg(F.slice(F.array_sort(F.collect_set("said")), 1, top).alias("different"))
    matching = said.filter("same").groupBy("abbreviation", "official").agg(F.count("*").alias("matching"))
    forms = met.select("abbreviation", "official", "chunk_id", F.explode(F.array_distinct(text.compounds("text", "abbreviation", letters))).alias("form"))
    forms = forms.groupBy("abbreviation", "official", "form").agg(F.countDistinct("chunk_id").alias("n"))
    forms = forms.withColumn("rank", F.row_number().over(Window.partitionBy("abbreviation", "official").orderBy(F.desc("n"), "form"))).filter(F.col("rank") <= top)
    compounds = forms.groupBy("abbreviation", "official").agg(F.array_sort(F.collect_list(F.struct("rank", "form", "n"))).alias("compounds"))
    keys = ["abbreviation", "official"]
    out = counts.join(matching, keys, "left").join(different, keys, "left").join(compounds, keys, "left")
    return out.fillna(0, ["abbreviation_chunks", "official_chunks", "matching"])


def family_targets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Each job with its families, from is_a edges, in catalog order: (job, name, families)."""
    jobs = entities.filter("entity_type = 'job'").select(F.col("entity_id").alias("subject"), F.col("name").alias("job_name"))
    families = entities.filter("entity_type = 'job_family'").select(F.col("entity_id").alias("object"), F.col("name").alias("family"))
    edges = relations.filter("predicate = 'is_a'").join(jobs, "subject").join(families, "object")
    return edges.groupBy(F.col("subject").alias("job"), F.col("job_name").alias("name")).agg(F.array_sort(F.collect_set("family")).alias("families"))


def find_guides(asked: DataFrame, guides: DataFrame) -> DataFrame:
    """For each asked name the guide of that name, else the first by name that contains it or is contained in it."""
    flat = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    a, g = asked.withColumn("a", flat("asked")), guides.withColumn("g", flat("job_name"))
    longer = contained(g.select("g").distinct(), {"a": F.col("g")}, a, "a").select("g", F.explode("a").alias("a"))
    shorter = contained(a.select("a").distinct(), {"g": F.col("a")}, g, "g").select(F.explode("g").alias("g"), "a")
    met = longer.unionByName(shorter).distinct().join(a, "a").join(g, "g")
    order = Window.partitionBy("asked").orderBy(F.desc(F.col("a") == F.col("g")), "job_name")
    return met.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "a", "g")


#: The sections of a guide, and the words of a topic that ask for some of them, the first that fits.
SECTIONS = ("buff_sequence", "deal_cycle", "burst_rotation", "sub_burst_and_normal", "stolen_skills", "core_v_matrix")
TOPICS = (
    (("전체",), SECTIONS),
    (("딜", "사이클", "극딜", "준극", "평딜", "오리진", "순서"), SECTIONS[:4]),
    (("버프", "시퀀스"), SECTIONS[:1]),
    (("스틸", "훔치"), ("stolen_skills",)),
    (("코강", "코어", "v매트릭스"), ("core_v_matrix",)),
)


def sections_of(topic: Column | str) -> Column:
    """Names of the guide sections that a topic asks for; all for none and for unknown ones."""
    said = F.lower(F.trim(F.coalesce(F.col(topic) if isinstance(topic, str) else topic, F.lit(""))))
    out = F.array(*[F.lit(x) for x in SECTIONS])
    for words, names in reversed(TOPICS):
        hit = functools.reduce(lambda a, w: a | F.contains(said, F.lit(w)), words, F.lit(False))
        out = F.when(hit, F.array(*[F.lit(x) for x in names])).otherwise(out)
    return out


def allowed_skills(jobs: DataFrame, commons: DataFrame, families: DataFrame, members: DataFrame) -> DataFrame:
    """(job_name, skill): the whitelist of each job.

    jobs (job_name, official_skills, own_skills): a job with official skills has these, another the commons (skill), its
    own, and those that families (family, skill) give to the families it is a member of (members: job_name, family).
    """
    official = F.size(F.coalesce("official_skills", F.array().cast("array<string>"))) > 0
    named = jobs.filter(official).select("job_name", F.explode("official_skills").alias("skill"))
    rest = jobs.filter(~official)
    every = commons.agg(F.collect_set("skill").alias("skills"))  # one short list of the catalog
    shared = rest.select("job_name").withColumn("_one", F.lit(1)).join(every.withColumn("_one", F.lit(1)), "_one").select("job_name", F.explode("skills").alias("skill"))
    own = rest.select("job_name", F.explode("own_skills").alias("skill"))
    of_family = members.join(rest.select("job_name"), "job_name", "left_semi").join(families, "family").select("job_name", "skill")
    return named.unionByName(shared).unionByName(own).unionByName(of_family).distinct()


def validate_skills(used: DataFrame, allowed: DataFrame) -> DataFrame:
    """Share of a guide's skills on the whitelist of its job: (job_name, matched, unknown, ratio, status)."""
    lists = allowed.groupBy("job_name").agg(F.collect_set("skill").alias("known"))
    named = used.groupBy("job_name").agg(F.collect_set("skill").alias("said")).join(lists, "job_name", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    hit = F.array_intersect("said", known)
    return named.select(
        "job_name", F.array_sort(hit).alias("matched"), F.array_sort(F.array_except("said", known)).alias("unknown"),
        F.round(F.size(hit) / F.size("said"), 2).alias("ratio"), F.when(F.size(known) == 0, "unverified").when(F.size(hit) == F.size("said"), "valid").otherwise("unknown_skills").alias("status"),
    )


def sectioned(headings: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", title: str = "title") -> DataFrame:
    """Items with the section and subsection carried forward over a document's ordered headings."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = headings.withColumn("section", F.last(F.when(F.col(level) == 1, F.col(title)), ignorenulls=True).over(w))
    at = F.last(F.when(F.col(level) == 1, F.col(pos)), ignorenulls=True).over(w)
    sub = F.last(F.when(F.col(level) == 2, F.struct(F.col(pos).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(w)
    out = out.withColumn("_at", at).withColumn("_sub", sub)
    return out.withColumn("subsection", F.when(F.col("_sub.at") > F.coalesce("_at", F.lit(-1)), F.col("_sub.title"))).filter(F.col(level) > 2).drop("_at", "_sub")


def transfers(rows: DataFrame, item: str, metrics: list[str], digits: int = 6) -> DataFrame:
    """Sums of metric columns, and the first over the second, null where that is not positive."""
    total = rows.groupBy(item).agg(*[F.sum(m).alias(m) for m in metrics])
    return total.withColumn("rate", F.round(F.when(F.col(metrics[1]) > 0, F.col(metrics[0]) / F.col(metrics[1])), digits))
