import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars
from loomspark.operators import analytics, chunking, entities, evaluation, merge, retrieval, temporal, terms, threads, vectors
from loomspark.plans import modes, registry
from loomspark.sources import pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_knn_ties_nulls_and_blocks(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [3.0, 0.0]), (11, [0.0, 1.0])], "query_id long, embedding array<double>")
    got = rows(vectors.knn(q, c, 2).select("query_id", "rank", "chunk_id"))
    assert got == [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 1)]
    assert vectors.knn(q.limit(0), c, 2).count() == 0 and vectors.knn(q, c.limit(0), 2).count() == 0


def clustered(n=1200, groups=40, seed=5):
    """Vectors about some directions, a third of them equal."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 16))
    made = middle[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, 16))
    made[: n // 3] = made[0]
    return made


def test_inverted_file(spark, tmp_path, monkeypatch):
    made = clustered()
    c = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(made)] + [("none", None), ("zero", [0.0] * 16), ("short", [1.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, made[i].tolist()) for i in range(0, len(made), 20)] + [(9999, [-x for x in made[0].tolist()])], "query_id int, embedding array<double>")
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    want = {}
    for r in q.collect():
        sims = np.round(unit @ (np.array(r["embedding"]) / np.linalg.norm(r["embedding"])), 12)
        want[r["query_id"]] = [f"c{i:04d}" for i in np.lexsort((np.arange(len(made)), -sims))[:20]]
    found = lambda df: {k: [r["chunk_id"] for r in sorted(g, key=lambda r: r["rank"])] for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: r["query_id"]), lambda r: r["query_id"])}
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(vectors, "TILE", 500)
    folder = str(tmp_path / "cells")
    vectors.build(c, folder, cells=40)
    assert found(vectors.knn(q, c, 20)) == want
    assert found(vectors.search(q, folder, 20, probes=1, exact=True)) == want
    near = vectors.search(q, folder, 20, probes=5)
    told = vectors.recall(near, vectors.knn(q, c, 20)).agg(F.sum("hits"), F.sum("wanted")).first()
    assert told[0] / told[1] >= 0.95
    scan = vectors.search(q.limit(1), folder, 5, probes=2)
    assert scan.count() == 5 and spark.read.parquet(f"{folder}/cells").agg(F.sum("n")).first()[0] == len(made)
    vectors.build(c.limit(0), str(tmp_path / "none"))
    assert vectors.search(q, str(tmp_path / "none"), 5, exact=True).count() == 0


def test_terms_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_BYTES", 6)
    words = ["a", "ab", "bab", "é", "", None, "zz", "ab"]
    texts = ["babab", "", None, "é a", "q" * 10_000 + "zz"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, body string")
    w = spark.createDataFrame([(x,) for x in words], "term string")
    got = {r["id"]: r["found"] for r in terms.contained(t, {"found": F.col("body")}, w).collect()}
    assert {i: None if f is None else sorted(f) for i, f in got.items()} == {i: None if x is None else sorted({y for y in words if y is not None and y in x}) for i, x in enumerate(texts)}
    spots = {r["id"]: sorted(tuple(s) for s in r["spots"]) for r in terms.located(t, F.col("body"), w).collect()}
    assert spots == {i: sorted({(y, j) for y in words if y for j in range(len(x or "")) if x.startswith(y, j)}) for i, x in enumerate(texts)}
    owned = spark.createDataFrame([(n, x) for n in (1, 2) for x in words[n:]], "who long, term string")
    got = {r["id"]: sorted(r["owners"]) for r in terms.owners(t, F.col("body"), owned, "who").collect()}
    assert got == {i: [n for n in (1, 2) if any(y and y in (x or "") for y in words[n:])] for i, x in enumerate(texts)}
    assert terms.contained(t, {"found": F.col("body")}, w.limit(0)).filter(F.size("found") > 0).count() == 0


def test_fusion_and_caps(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, chunk_id string, rank int")
    got = {r["chunk_id"]: r["rrf"] for r in retrieval.fuse([a, b]).collect()}
    assert got["y"] == pytest.approx(1 / 61 + 1 / 62) and got["x"] == pytest.approx(1 / 61)


def test_lexical_falls_back(spark):
    c = spark.createDataFrame([(1, "alpha beta"), (2, "gamma über")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "alp"), (2, "über"), (3, "zzz")], "query_id long, query string")
    got = rows(retrieval.lexical(q, c).select("query_id", "chunk_id"))
    assert (1, 1) in got and (2, 2) in got and all(g[0] != 3 for g in got)


def test_quality_boost_is_capped(spark):
    b = scalars.quality_boost(F.lit(10**6), F.lit(10**6), F.lit(True), F.lit(True), F.lit(0), F.lit(True))
    assert spark.range(1).select(b).first()[0] == pytest.approx(0.032)


def test_thread_cycles_and_orphans(spark):
    c = spark.createDataFrame(
        [(1, 10, None, "indexed"), (1, 20, 10, "indexed"), (1, 30, 20, "deleted"), (1, 40, 30, "sanitized"), (2, 1, 2, "indexed"), (2, 2, 1, "indexed"), (2, 3, 2, "indexed")],
        "article_id long, comment_id long, parent_id long, status string",
    )
    replies = rows(threads.project(c).filter("kind = 'reply_to'").select("article_id", "source", "target"))
    assert replies == [(1, 20, 10)]
    assert rows(threads.on_cycle(c)) == [(2, 1), (2, 2), (2, 3)]


def test_entity_linking(spark):
    aliases = spark.createDataFrame([("Dark Knight", "j1", "job"), ("Knight", "f1", "job_family"), ("jobs", "taxonomy:jobs", "taxonomy"), ("DK", "j1", "job"), ("DK", "i1", "item")], "alias string, entity_id string, entity_type string")
    q = spark.createDataFrame([(1, "the dark  knight and jobs"), (2, "all jobs"), (3, "dk")], "query_id long, query string")
    assert rows(entities.link(q, aliases).select("query_id", "entity_id")) == [(1, "j1"), (2, "taxonomy:jobs"), (3, "i1"), (3, "j1")]


def test_two_hops(spark):
    r = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "c", "d"), ("r4", "x", "y")], "relation_id string, subject string, object string")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, entity_id string")
    assert rows(entities.neighbourhood(seeds, r, 1).select("relation_id")) == [("r1",)]
    assert rows(entities.neighbourhood(seeds, r, 2).select("relation_id")) == [("r1",), ("r2",)]
    with pytest.raises(ValueError):
        entities.neighbourhood(seeds, r, 3)


def shuffled(spark, df):
    """A query's rows, and how many rows its stages wrote to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    got = rows(df)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return got, sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_neighbourhood_of_hubs(spark):
    rng, most = random.Random(3), 7
    edges = [(f"{rng.random():.9f}", f"n{rng.randrange(3)}", f"s{i % 40}") for i in range(90)] + [(f"{rng.random():.9f}", f"s{rng.randrange(40)}", f"t{rng.randrange(30)}") for _ in range(40)]
    asked = [(q, e) for q in range(60) for e in rng.sample([f"{k}{i}" for k in "nst" for i in range(3)], 1 + q % 2)]
    expected = []
    for q in range(60):
        own = {e for i, e in asked if i == q}
        one = {r for r, a, b in edges if {a, b} & own}
        ends = {x for r, a, b in edges if r in one for x in (a, b)}
        expected += [(r, q, hop) for hop, r in sorted([(1, r) for r in one] + [(2, r) for r, a, b in edges if {a, b} & ends and r not in one])[:most]]
    seeds, r = spark.createDataFrame(asked, "query_id long, entity_id string"), spark.createDataFrame(edges, "relation_id string, subject string, object string")
    assert rows(entities.neighbourhood(seeds, r, 2, most).select("relation_id", "query_id", "hop")) == sorted(expected)


def test_neighbourhood_of_a_hub_is_found_once(spark):
    seeds = spark.range(400).select(F.col("id").alias("query_id"), F.lit("n").alias("entity_id"))
    r = spark.range(300).select(F.format_string("%03d", "id").alias("relation_id"), F.concat(F.lit("s"), "id").alias("subject"), F.lit("n").alias("object"))
    got, moved = shuffled(spark, entities.neighbourhood(seeds, r, 2, 3).select("query_id", "relation_id", "hop"))
    assert got == [(q, f"{i:03d}", 1) for q in range(400) for i in range(3)]
    assert moved < 10_000  # every pair of a query and a relation, before: 602,400


def test_typed_relations_of_a_hub_are_found_once(spark):
    linked = spark.range(1, 401).selectExpr("id as query_id", "explode(if(id % 4 = 0, array('n', 'm'), array('n'))) as entity_id", "if(id % 5 = 0, 'job', 'job_family') as entity_type")
    r = spark.range(300).selectExpr("format_string('%03d', id) as relation_id", "concat('s', id) as subject", "'is_a' as predicate", "if(id % 3 = 0, 'm', 'n') as object")
    r = r.unionByName(spark.createDataFrame([("own", "n", "is_a", "x"), ("part", "n", "part_of", "y"), ("both", "m", "is_a", "n")], r.schema))
    got, moved = shuffled(spark, entities.typed_relations(linked, r).select("query_id", "relation_id"))
    of = lambda q: ["own", *["both"] * (q % 4 == 0)] if q % 5 == 0 else ["both", "part", *[f"{i:03d}" for i in range(300) if i % 3 or q % 4 == 0]]
    assert got == sorted((q, x) for q in range(1, 401) for x in of(q))
    assert moved < 10_000  # every pair of a query and a relation, before: 72,740


def test_facts_of_a_nation_are_numbered_once(spark, tmp_path):
    tables = {
        "customer": spark.range(400).selectExpr("id as c_custkey", "cast(id % 2 + 1 as int) as c_nationkey"),
        "supplier": spark.range(300).selectExpr("id as s_suppkey", "format_string('S%03d', 299 - id) as s_name", "cast(id % 3 as int) as s_nationkey"),
        "nation": spark.range(3).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got, moved = shuffled(spark, registry.QUERIES["hydrated_facts"](spark, str(tmp_path)))
    of = {n: [i for i in range(299, -1, -1) if i % 3 == n and i % 7] for n in (1, 2)}
    assert got == sorted((c, f"r{i}", f"S{299 - i:03d}", f"N{c % 2 + 1}", k + 1) for c in range(400) for k, i in enumerate(of[c % 2 + 1]))
    assert moved < 10_000  # every pair of a customer and a supplier, before: 74,572


def test_common_keywords_hand_on_their_first_chunks(spark, tmp_path):
    c = spark.range(600).selectExpr("id as chunk_id", "concat('night nightly nights ', if(id % 2 = 0, 'owl ', 'fox '), id) as text")
    q = spark.range(300).selectExpr("id as query_id", "if(id % 2 = 0, 'night owl', 'fox ni') as query")
    retrieval.write_index(c, str(tmp_path / "index"), buckets=4)
    held, moved = shuffled(spark, retrieval.keyword_hits(q, str(tmp_path / "index"), spark, 5))
    assert {query for query, _ in held} == set(range(300)) and all([c for i, c in held if i == n][:5] == list(range(5)) for n in (0, 1))
    assert moved < 20_000  # a row for each query and chunk, before: 270,016
    plain, indexed = retrieval.lexical(q, c, stage1=5, k=4), retrieval.lexical(q, c, str(tmp_path / "index"), stage1=5, k=4)
    assert rows(indexed) == rows(plain) and len(rows(plain)) == 1200


def test_upsert_and_outbox(spark):
    old = spark.createDataFrame([(1, "a", 1, "indexed"), (2, "b", 1, "indexed")], "k long, content_hash string, views long, status string")
    new = spark.createDataFrame([(1, "a", 9), (2, "c", 9), (3, "d", 9)], "k long, content_hash string, views long")
    got = merge.changed_upsert(old, new, "k", ("views",))
    assert rows(got) == [(1, "a", 9, "indexed", "unchanged"), (2, "c", 9, "sanitized", "updated"), (3, "d", 9, "sanitized", "inserted")]
    assert [r["dedupe_key"] for r in merge.outbox(got, "k").orderBy("source_key").collect()] == ["2:c", "3:d"]


def test_rate_limit_matches_fold(spark):
    rng = random.Random(3)
    events = [(k, float(t), i) for i, (k, t) in enumerate((rng.randrange(3), rng.randrange(300)) for _ in range(200))]
    df = spark.createDataFrame(events, "k int, t double, i long").withColumn("at", F.timestamp_seconds("t"))
    got = {r["i"]: r["accepted"] for r in temporal.rate_limit(df, "k", "at", "i", 3, 20.0).collect()}
    for k in range(3):
        own = sorted((t, i) for kk, t, i in events if kk == k)
        assert [got[i] for _, i in own] == temporal.allow([t for t, _ in own], 3, 20.0)


def test_queue_transitions(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    jobs = spark.sql("select id, 'queued' state, cast(id % 2 as int) priority, 0 attempts, cast(null as string) lease_owner, cast(null as timestamp) leased_until, timestamp '2023-01-01' next_attempt_at from range(4)")
    leased = temporal.lease(jobs, "w", now, 2)
    assert rows(leased.filter("state = 'leased'").select("id", "attempts")) == [(1, 1), (3, 1)]
    done = temporal.settle(leased, spark.createDataFrame([(1, "w", True), (3, "other", True)], "id long, owner string, ok boolean"), now)
    assert rows(done.filter("id in (1, 3)").select("id", "state")) == [(1, "succeeded"), (3, "leased")]
    assert rows(temporal.reclaim(leased, F.lit("2025-01-01").cast("timestamp")).filter("state = 'leased'")) == []


def test_round_robin(spark):
    boards = spark.createDataFrame([(1, 1, 0), (2, 5, 1), (3, None, 2)], "board_id int, next_page int, pos int")
    assert rows(temporal.round_robin(boards, 10, 4).select("round", "board_id", "start", "pages")) == [(1, 1, 1, 4), (2, 1, 5, 4), (2, 2, 5, 4), (3, 1, 9, 2), (3, 2, 9, 2)]


def test_potions(spark):
    table = {n: 100 for n in range(200, 301)}
    p = scalars.potions(F.lit(200), F.lit(50.0), F.lit(3), table, 201, 201, 250)
    assert tuple(spark.range(1).select(p.alias("p")).first()["p"]) == (205, 0.0, 450)


def test_chunks_cover_text(spark):
    words = " ".join(f"w{i}" for i in range(500))
    d = spark.createDataFrame([("article", "article:1:2", "t", "b", None, None, words)], "source_type string, source_key string, title string, board string, category string, published_at timestamp, text string")
    got = chunking.chunk(d, target=80, most=100, overlap=10).orderBy("ordinal").collect()
    assert all(r["token_count"] <= 100 for r in got) and len({r["chunk_id"] for r in got}) == len(got)
    assert {w for r in got for w in r["text"].split("\n\n", 1)[1].split()} == set(words.split())
    with pytest.raises(ValueError):
        chunking.chunk(d, target=10, most=5)


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "f", ["s1", "s2"], ["x"], False, False, []), ("b", "g", [], [], True, False, [])], "id string, family string, expected_sources array<string>, expected_terms array<string>, no_evidence boolean, security boolean, banned array<string>")
    told = spark.createDataFrame([("a", ["s9", "s1"], "X!"), ("b", ["s1"], "")], "id string, sources array<string>, answer string")
    s = evaluation.summary(evaluation.ranked_cases(cases, told)).first()
    assert (s["recall"], s["mrr"], s["unsupported_rate"], s["term_rate"]) == (0.5, 0.5, 0.5, 1.0)
    with pytest.raises(ValueError):
        evaluation.ranked_cases(cases, told.limit(1))


def test_pages(spark):
    listing = '<a data-category="x">x</a><article data-article-id="7"><a class="title" href="/7">old</a></article><article data-article-id="7"><a class="title" href="/7">new &amp; x</a></article>'
    got = spark.createDataFrame([(listing,), ("<p>",)], "h string").select(pages.listings("h", "https://a.b/").alias("p")).select("p.*").collect()
    assert got[0]["status"] == "ok" and [(a["id"], a["title"], a["url"]) for a in got[0]["articles"]] == [(7, "new & x", "https://a.b/7")]
    assert got[1]["status"] == "drift"
    board = '<a href="?category=Tips">Tips</a><a class="subject-link" href="/board/maple/2304/99?x">Hello <b>you</b></a><a class="subject-link" href="/board/maple/7/1">other</a>'
    own = spark.createDataFrame([(board,)], "h string").select(pages.listings("h", "https://a.b/", 2304).alias("p")).select("p.*").first()
    assert own["categories"] == ["Tips"] and [(a["id"], a["title"], a["url"]) for a in own["articles"]] == [(99, "Hello you", "https://a.b/board/maple/2304/99?x")]
    page = '<meta property="og:title" content="O"><h1 data-title="article">T</h1><span data-author="nickname"> N </span><p>조회 : 9</p><div class="articleHit"><div>조회 : 1,234</div> 추천: 5</div><div id="powerbbsContent"><p>a</p><script>x</script><p>b<img src="/i.png" alt="pic"></p></div>'
    art = spark.createDataFrame([(page,), ('<div id="powerbbsContent"><p>a',)], "h string").select(pages.articles("h", "https://a.b/").alias("p")).select("p.*").collect()
    assert (art[0]["status"], art[0]["title"], art[0]["body"], art[0]["views"], art[0]["likes"], art[0]["author"], art[0]["media"][0]["url"]) == ("ok", "T", "a\nb", 1234, 5, "N", "https://a.b/i.png")
    assert art[1]["status"] == "drift"


def test_comment_responses(spark):
    flat = '{"comments":[{"id":1,"parent_id":null,"author":"n","body":"hi a@b.co","score":2},{"id":2,"parent_id":1,"body":"x","deleted":true},{"id":3,"parent_id":99,"body":"y"}]}'
    grouped = '{"commentlist":[{"list":[{"__attr__":{"cmtidx":5,"cmtpidx":5},"o_comment":"root"},{"__attr__":{"cmtidx":6,"cmtpidx":5},"o_comment":"kid"},{"__attr__":{"cmtidx":7},"o_comment":"late"}]}]}'
    df = spark.createDataFrame([(1, flat), (2, grouped), (3, "nonsense")], "article_id long, response string")
    got = {(r["article_id"], r["comment_id"]): r for r in pages.comments(df, salt="0123456789abcdef").collect()}
    assert got[1, 2]["text"] == "" and got[1, 3]["status"] == "orphan" and got[1, 1]["text"] == "hi [이메일 삭제]"
    assert [got[2, i]["parent_id"] for i in (5, 6, 7)] == [None, 5, 5]
    assert got[3, None]["status"] == "drift"


def test_modes_and_routing(spark):
    assert modes.plan_of("MIX").linked and not modes.plan_of("bypass").evidence
    m = spark.createDataFrame([(1, False, 1, 2, "<@7> --rag-mode local what"), (1, False, 1, 2, "hello"), (1, False, 1, 2, "<@7> --rag-mode nope x"), (1, True, 1, 2, "<@7> x")], "author_id int, author_is_bot boolean, guild_id int, channel_id int, content string")
    got = [(r["reason"], r["mode"], r["question"]) for r in modes.route(m, 7, (1,), (2,)).collect()]
    assert got[0] == ("accepted", "local", "what") and [g[0] for g in got[1:]] == ["direct_mention_required", "invalid_rag_mode", "non_user_message"]


def test_guides_and_sections(spark):
    g = spark.createDataFrame([("Dark Knight",), ("Knight",)], "job_name string")
    asked = spark.createDataFrame([("knight",), ("dark",)], "asked string")
    assert rows(analytics.find_guides(asked, g).select("asked", "job_name")) == [("dark", "Dark Knight"), ("knight", "Knight")]
    h = spark.createDataFrame([(1, 1, 1, "S"), (1, 2, 2, "sub"), (1, 3, 3, "i"), (1, 4, 1, "S2"), (1, 5, 3, "j")], "doc_id int, pos int, level int, title string")
    assert rows(analytics.sectioned(h).select("title", "section", "subsection")) == [("i", "S", "sub"), ("j", "S2", None)]
