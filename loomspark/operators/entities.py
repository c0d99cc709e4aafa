"""Typed knowledge graph: catalog checks, entity linking, traversal, fact merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text
from loomspark.functions.answers import terms
from loomspark.functions.text import normalized
from loomspark.operators.retrieval import top
from loomspark.operators.terms import located

#: Queries and rows of a piece in which handed_out joins them.
QUERIES, ROWS = 4096, 512
#: Specificity inside the job ontology.
SPECIFICITY = {"taxonomy": 1, "job_family": 2, "job": 3}
ROOT = "taxonomy:jobs"


def catalog_problems(entities: DataFrame, aliases: DataFrame, relations: DataFrame, ambiguous: tuple[str, ...] = (), external: tuple[str, ...] = ()) -> DataFrame:
    """(problem, what): repeated ids and edges, ambiguous aliases that aren't allowed, edges with unknown ends."""
    kind = lambda name, df, c: df.select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("what"))
    twice = entities.groupBy("entity_id").count().filter("count > 1")
    shared = aliases.groupBy(normalized("alias").alias("alias")).agg(F.countDistinct("entity_id").alias("n")).filter("n > 1")
    shared = shared.filter(~F.col("alias").isin(*ambiguous)) if ambiguous else shared
    known = entities.select("entity_id")
    ends = relations.select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct().join(known, "entity_id", "left_anti")
    ends = ends.filter(~F.col("entity_id").isin(*external)) if external else ends
    edge = F.concat_ws(" ", "subject", "predicate", "object")
    repeated = relations.groupBy(edge.alias("edge")).count().filter("count > 1")
    return kind("entity twice", twice, "entity_id").union(kind("ambiguous alias", shared, "alias")).union(kind("unknown end", ends, "entity_id")).union(kind("edge twice", repeated, "edge"))


def occurrences(texts: DataFrame, aliases: DataFrame, tid: str = "query_id", body: str = "query") -> DataFrame:
    """Every occurrence of every normalised alias: (tid, entity_id, entity_type, alias, start, end), start from 0.

    Each text is read once for all aliases; occurrences that overlap an earlier one of the same alias count as well. An
    occurrence joins the entities that have its alias, and no text travels with it.
    """
    a = aliases.select("entity_id", "entity_type", "alias", normalized("alias").alias("na")).filter("na <> ''")
    spots = located(texts.select(tid, normalized(body).alias("nt")), F.col("nt"), a, "na").select(tid, F.explode("spots").alias("s"))
    met = spots.select(tid, F.col("s.term").alias("na"), F.col("s.start").alias("start")).join(a, "na")
    return met.select(tid, "entity_id", "entity_type", "alias", "start", (F.col("start") + F.length("na")).cast("int").alias("end")).distinct()


def greedy(matches: Column) -> Column:
    """Longest first: a match stays if it overlaps none that stayed, or only such as have its very span and other entities."""
    order = lambda m: F.struct((m["start"] - m["end"]).alias("neg"), m["start"].alias("start"), m["entity_id"].alias("entity_id"), m["end"].alias("end"), m["entity_type"].alias("entity_type"), m["alias"].alias("alias"))
    ranked = F.array_sort(F.transform(matches, order))

    def step(kept: Column, m: Column) -> Column:
        over = lambda e: (m["start"] < e["end"]) & (e["start"] < m["end"])
        bad = F.exists(kept, lambda e: over(e) & ~((e["start"] == m["start"]) & (e["end"] == m["end"]) & (e["entity_id"] != m["entity_id"])))
        return F.when(bad, kept).otherwise(F.concat(kept, F.array(m)))

    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)


def link(texts: DataFrame, aliases: DataFrame, tid: str = "query_id", body: str = "query", root: str = ROOT) -> DataFrame:
    """Linked entities of each text: (tid, entity_id, entity_type, alias, start, end).

    Of overlapping matches the longest stay. If any match belongs to the job ontology, only its most specific level stays
    of taxonomies, families and jobs; taxonomies go if anything else matched.
    """
    found = occurrences(texts, aliases, tid, body).groupBy(tid).agg(F.collect_list(F.struct("entity_id", "entity_type", "alias", "start", "end")).alias("m"))
    kept = found.select(tid, F.explode(greedy(F.col("m"))).alias("m")).select(tid, "m.entity_id", "m.entity_type", "m.alias", "m.start", "m.end")
    level = F.lit(None).cast("int")
    for name, n in SPECIFICITY.items():
        level = F.when(F.col("entity_type") == name, n).otherwise(level)
    w = Window.partitionBy(tid)
    job = F.col("entity_type").isin("job", "job_family") | (F.col("entity_id") == root)
    kept = kept.withColumn("level", level).withColumn("highest", F.max(F.when(job, F.col("level"))).over(w))
    kept = kept.filter("highest is null or level is null or level = highest")
    kept = kept.withColumn("other", F.max(F.col("entity_type") != "taxonomy").over(w)).filter("not (other and entity_type = 'taxonomy')")
    return kept.select(tid, "entity_id", "entity_type", "alias", "start", "end")


def _dealt(df: DataFrame, key: str, by: str, most: int, piece: str, packed: str) -> DataFrame:
    """(key, piece, packed): each key's rows dealt by the hash of `by` into arrays of about `most`."""
    pieces = df.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_n"))
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.join(pieces, key).groupBy(key, F.pmod(F.xxhash64(by), F.col("_n")).alias(piece)).agg(F.collect_list(rest).alias(packed))


def handed_out(asked: DataFrame, found: DataFrame, key: str, tid: str = "query_id", fid: str = "relation_id") -> DataFrame:
    """Every query of asked (tid, key) with every row of found (key, fid and more) of its key: tid and found without key.

    Pieces of queries meet pieces of rows, are dealt out by pairs of pieces, and are unfolded last: what is shuffled grows
    with the two sides, however many rows come of them, and a common key is the work of many tasks.
    """
    queries, answers = _dealt(asked.select(key, tid), key, tid, QUERIES, "_q", "_queries"), _dealt(found, key, fid, ROWS, "_f", "_rows")
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = queries.join(answers, key).repartition(n, key, "_q", "_f").select("_queries", "_rows")
    return pairs.select(F.explode("_queries").alias("_query"), "_rows").select(f"_query.{tid}", F.explode("_rows").alias("_row")).select(tid, "_row.*")


def _sets(rows: DataFrame, tid: str) -> tuple[DataFrame, DataFrame]:
    """The queries (tid, _set) of rows (tid and more) by the digest of a query's distinct rows, and the rows (_set and more) of each such set."""
    row = F.struct(*[c for c in rows.columns if c != tid])
    asked = rows.groupBy(tid).agg(F.sort_array(F.collect_set(row)).alias("_rows")).withColumn("_set", F.sha2(F.to_json("_rows", {"ignoreNullFields": "false"}), 256))
    return asked.select(tid, "_set"), asked.groupBy("_set").agg(F.any_value("_rows").alias("_rows")).select("_set", F.inline("_rows"))


def typed_relations(linked: DataFrame, relations: DataFrame, tid: str = "query_id") -> DataFrame:
    """(tid, relation_id): the relations that answer for each linked entity, by its type.

    job: its own is_a; job_family: incoming is_a and own part_of; taxonomy: incoming part_of, and of its members the
    incoming is_a, abbreviation_of and variant_of; abbreviation: all of its own and its targets' has_effect; boss: all of
    its own and its variants' has_difficulty; other types: all of their own. Queries with the same entities share one answer.
    """
    asked, e = _sets(linked.select(tid, "entity_id", "entity_type"), tid)
    r = relations.select("relation_id", "subject", "predicate", "object")
    of = lambda *types: e.filter(F.col("entity_type").isin(*types))
    out = lambda df: df.join(r, F.col("entity_id") == F.col("subject"))
    into = lambda df: df.join(r, F.col("entity_id") == F.col("object"))
    pick = lambda df, *p: (df.filter(F.col("predicate").isin(*p)) if p else df).select("_set", "relation_id")
    members = lambda df, end: df.select("_set", F.col(end).alias("entity_id"), F.lit("").alias("entity_type")).distinct()
    rest = e.filter(~F.col("entity_type").isin("job", "job_family", "taxonomy"))
    found = [
        pick(out(of("job")), "is_a"), pick(into(of("job_family")), "is_a"), pick(out(of("job_family")), "part_of"), pick(into(of("taxonomy")), "part_of"),
        pick(into(members(into(of("taxonomy")).filter("predicate = 'part_of'"), "subject")), "is_a", "abbreviation_of", "variant_of"),
        pick(out(rest)), pick(into(rest)),
        pick(out(members(out(of("abbreviation")).filter("predicate = 'abbreviation_of'"), "object")), "has_effect"),
        pick(out(members(into(of("boss")).filter("predicate = 'variant_of'"), "subject")), "has_difficulty"),
    ]
    both = found[0]
    for one in found[1:]:
        both = both.union(one)
    return handed_out(asked, both.distinct(), "_set", tid)


def neighbourhood(seeds: DataFrame, relations: DataFrame, hops: int = 2, most: int = 128, tid: str = "query_id") -> DataFrame:
    """(tid, relation_id, hop) within one or two hops of the seeds, either direction; the first `most` by hop, then id.

    Queries with the same seeds share one answer. Of an entity only the first relations by id are read: `most` around a
    seed; around others twice as many, as fewer than `most` of them can be a first hop of a query that needs a second.
    """
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    asked, own = _sets(seeds.select(tid, "entity_id"), tid)
    ends = relations.select("relation_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity_id")).filter("entity_id is not null").distinct()
    first = lambda n: top(ends, ["entity_id"], [F.col("relation_id")], n).drop("rank")
    nearest = top(own.join(first(most), "entity_id").select("_set", "relation_id").distinct(), ["_set"], [F.col("relation_id")], most)
    met = nearest.select("_set", "relation_id", F.lit(1).alias("hop"))
    if hops == 2:
        full = nearest.filter(F.col("rank") == most).select("_set")
        reached = met.join(full, "_set", "left_anti").join(ends, "relation_id").select("_set", "entity_id").distinct().join(own, ["_set", "entity_id"], "left_anti")
        met = met.unionByName(reached.join(first(2 * most), "entity_id").select("_set", "relation_id", F.lit(2).alias("hop")))
    found = top(met.groupBy("_set", "relation_id").agg(F.min("hop").alias("hop")), ["_set"], [F.col("hop"), F.col("relation_id")], most)
    return handed_out(asked, found.drop("rank"), "_set", tid)


def anchors(queries: DataFrame, facts: DataFrame, tid: str = "query_id", body: str = "query", kinds: tuple[str, ...] = ("job", "boss")) -> DataFrame:
    """(tid, anchors, groups): names of a query's facts that it mentions, in the facts' order, and those of each kind as a group.

    facts: tid, pos, subject_name, subject_type, object_name, object_type. Kinds without a mentioned name give no group.
    """
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("subject_name").alias("name"), F.col("subject_type").alias("type")), F.struct(F.lit(1).alias("side"), F.col("object_name").alias("name"), F.col("object_type").alias("type")))
    named = facts.select(tid, "pos", F.explode(ends).alias("e")).select(tid, "pos", "e.*")
    said = named.join(queries.select(tid, normalized(body).alias("_q")), tid).filter(F.contains("_q", normalized("name")))
    once = said.groupBy(tid, "name", "type").agg(F.min(F.struct("pos", "side")).alias("at"))
    names = lambda kept: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("at", "name")))), lambda x: x["name"]))
    lists = once.groupBy(tid).agg(names(F.lit(True)).alias("anchors"), *[names(F.col("type") == k).alias(f"_{k}") for k in kinds])
    return lists.select(tid, "anchors", F.filter(F.array(*[F.col(f"_{k}") for k in kinds]), lambda g: F.size(g) > 0).alias("groups"))


def unsupported_expansions(answers: DataFrame, facts: DataFrame, tid: str = "answer_id", body: str = "answer") -> DataFrame:
    """(tid, term, observed, expected): what an answer explains in brackets other than the facts do, each once.

    facts: tid, subject_name, predicate, object_name. A registered abbreviation must be explained by its object's name
    (expected); another term by names of facts: the whole as a name, or every part as what the term is, belongs to, or
    comes in. Names are compared in lower case, without blanks.
    """
    flat = lambda c: F.replace(normalized(c), F.lit(" "), F.lit(""))
    short = facts.filter("predicate = 'abbreviation_of'").select(tid, F.col("subject_name").alias("term"), F.col("object_name").alias("expected"))
    said = answers.select(tid, F.col(body).alias("_t")).join(short, tid).select(tid, "term", F.explode(text.expansions("_t", "term")).alias("observed"), "expected")
    wrong = said.filter(~F.contains(flat("observed"), flat("expected"))).select(tid, "term", "observed", "expected")
    found = answers.select(tid, F.explode(terms(body)).alias("t")).select(tid, F.col("t.term").alias("term"), F.col("t.expansion").alias("observed"))
    found = found.withColumn("_k", flat("term")).join(short.select(tid, flat("term").alias("_k")).distinct(), [tid, "_k"], "left_anti").distinct()
    names = facts.select(tid, F.explode(F.array("subject_name", "object_name")).alias("name")).select(tid, flat("name").alias("_whole")).distinct()
    open_ = found.withColumn("_whole", flat(F.concat("term", F.lit("("), "observed", F.lit(")")))).join(names, [tid, "_whole"], "left_anti")
    parts = open_.select(tid, "term", "observed", "_k", F.explode(F.filter(F.split("observed", r"[·/,+]"), lambda p: F.trim(p) != "")).alias("_p")).withColumn("_p", flat("_p"))
    related = facts.filter(F.col("predicate").isin("is_a", "part_of", "variant_of", "has_difficulty")).select(tid, flat("subject_name").alias("_k"), flat("object_name").alias("_p")).distinct()
    missing = parts.join(related, [tid, "_k", "_p"], "left_anti").select(tid, "term", "observed").distinct()
    return wrong.unionByName(missing.withColumn("expected", F.lit(None).cast("string"))).distinct()


def hydrate(chosen: DataFrame, relations: DataFrame, entities: DataFrame, tid: str = "query_id") -> DataFrame:
    """Facts with names and types of both ends, numbered by subject type, subject name, predicate and id; everything involved must be active."""
    end = lambda p: entities.filter("active").select(F.col("entity_id").alias(p), F.col("name").alias(f"{p}_name"), F.col("entity_type").alias(f"{p}_type"))
    facts = relations.filter("active").drop("active").join(end("subject"), "subject").join(end("object"), "object")
    order = Window.partitionBy(tid).orderBy("subject_type", "subject_name", "predicate", "relation_id")
    return chosen.select(tid, "relation_id").join(facts, "relation_id").withColumn("pos", F.row_number().over(order))


def merge_facts(query_facts: DataFrame, evidence_facts: DataFrame, tid: str = "query_id", scopes: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Facts of the query, then of the evidence; evidence facts of which a scope is given but disjoint from the query's go.

    Both have (tid, relation_id, pos, value) and an array of ids for each of scopes, such as a fact's jobs and its bosses;
    each is compared by itself. Of a relation given twice the first place and the last value stay.
    """
    asked = query_facts.groupBy(tid).agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"_{c}") for c in scopes])
    fit = evidence_facts.join(asked, tid, "left")
    for c in scopes:
        fit = fit.filter(f"_{c} is null or size(_{c}) = 0 or size({c}) = 0 or arrays_overlap(_{c}, {c})").drop(f"_{c}")
    both = query_facts.withColumn("part", F.lit(0)).unionByName(fit.withColumn("part", F.lit(1)))
    return both.groupBy(tid, "relation_id").agg(F.min(F.struct("part", "pos")).alias("place"), F.max_by("value", F.struct("part", "pos")).alias("value"))
