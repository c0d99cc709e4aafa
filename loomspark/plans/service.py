"""Registered queries of what a running service keeps: streams, job states, logs, indexes at rest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import answers, scalars, tables, text
from loomspark.operators import analytics, documents, embedding, entities, evaluation, merge, temporal
from loomspark.plans import modes
from loomspark.plans.corpus import ORACLE_SQL, QUERIES, query
from loomspark.sources import boards, shared, updates
from loomspark.streaming import stateful

__all__ = ["ORACLE_SQL", "QUERIES"]


def _streamed(events: DataFrame, machine: Callable[[DataFrame], DataFrame], key: str, at: str = "at") -> DataFrame:
    """What a stream makes of a table of events, once its folder may go."""
    spark = events.sparkSession
    with shared.Kept(spark) as kept:
        return kept.settled(stateful.backfilled(events, machine, key, at, kept.path))


_CALLS = """WITH s AS (SELECT user_id % 8 AS host, event_id AS seq, CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 200 ELSE 500 END AS status, CASE WHEN event_id % 97 = 96 THEN 'captcha' END AS event, ts FROM events),
 r AS (SELECT *, count(*) FILTER (WHERE status = 200) OVER (PARTITION BY host ORDER BY ts, seq) AS run FROM s),
 c AS (SELECT *, count(*) FILTER (WHERE status = 429) OVER (PARTITION BY host, run ORDER BY ts, seq) AS denials FROM r)
 SELECT host, CASE WHEN event IS NOT NULL THEN event ELSE 'repeated_429' END AS reason, seq AS opened_at FROM c WHERE event IS NOT NULL OR (status = 429 AND denials >= 3) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts, seq) = 1"""


@query(_CALLS)
def stream_circuit(t, spark: SparkSession) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "click", 200).otherwise(500)
    calls = t("events").select((F.col("user_id") % 8).alias("host"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 97 == 96, "captcha").alias("event"))
    return _streamed(calls, lambda e: stateful.circuit(e, 3), "host")


@query("""WITH s AS (SELECT user_id, event_id, event_type, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR, true) AS new FROM events), r AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
 SELECT user_id AS run_id, event_id AS step_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INT) AS step_index, row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY ts, event_id) > 1 AS repeated FROM r""")
def stream_steps(t, spark: SparkSession) -> DataFrame:
    """An agent's log, a run forgotten after twelve quiet hours."""
    log = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("fingerprint"))
    return _streamed(log, lambda e: stateful.replay(e, idle_seconds=12 * 3600), "run_id")


def _job_events(t) -> DataFrame:
    """Orders as jobs: each customer's events enqueue, lease, settle and fail a job of theirs."""
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "lease").when(F.col("event_type") == "purchase", "succeed").when(F.col("event_type") == "error", "fail").otherwise("enqueue")
    owner = F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string"))
    return t("events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("kind"), owner.alias("owner"), (F.col("event_id") % 7 * 3600 + 60).cast("long").alias("seconds"))


@query()
def job_history(t, spark: SparkSession) -> DataFrame:
    """Every change of state of all jobs, leases that ran out until 50 minutes after the last event included."""
    events = _job_events(t)
    return temporal.job_history(events, F.lit(events.agg(F.max("at") + F.expr("interval 50 minutes")).first()[0]))


@query()
def stream_jobs(t, spark: SparkSession) -> DataFrame:
    """The same by a stream, whose timers end the leases."""
    return _streamed(_job_events(t), stateful.jobs, "job_id")


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN NULL ELSE '{"a":[{"b":{"QUERY":"<redacted>","deep":[{"n":' || turn || ',"password":"<redacted>"},[]]},"token":"<redacted>"},null],"ok":' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ',"role":' || to_json(role) || ',"url":"see <redacted-url>h/x"}' END AS document FROM conversations""")
def redacted_documents(t, spark: SparkSession) -> DataFrame:
    """Sensitive fields up to depth five, inside lists of lists; every fifth turn's document is broken."""
    said = F.to_json(F.struct("text"))
    inner = F.concat(F.lit('{"token": '), said, F.lit(', "b": {"QUERY": {"x": 1}, "deep": [{"password": null, "n": '), F.col("turn").cast("string"), F.lit("}, []]}}"))
    made = F.concat(F.lit('{"url": "see https://u:p@h/x", "a": ['), inner, F.lit(', null], "role": "'), F.col("role"), F.lit('", "ok": '), (F.col("turn") % 2 == 0).cast("string"), F.lit("}"))
    broken = F.when(F.col("turn") % 5 == 4, F.substring(made, F.lit(1), F.length(made) - 1)).otherwise(made)
    return documents.redacted(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), broken.alias("document")))


def digest_embedder(texts: list[str]) -> list[tuple[int, list[float]]]:
    """Stands for a provider: the first eight bytes of a text's digest, plus one, as a vector of length one; the last text first."""
    out = []
    for i, said in reversed(list(enumerate(texts))):
        raw = [b + 1 for b in hashlib.sha256(said.encode()).digest()[:8]]
        norm = sum(x * x for x in raw) ** 0.5
        out.append((i, [x / norm for x in raw]))
    return out


@query("""WITH b AS (SELECT doc_id, list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256(text), CAST(2 * i + 1 AS INT), 2)) AS INT) + 1) AS v FROM documents)
 SELECT doc_id AS chunk_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS last, doc_id % 3 <> 0 AS later FROM b""")
def embedding_calls(t, spark: SparkSession) -> DataFrame:
    """Every third chunk is embedded first; a second run asks for the others only."""
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(True).alias("active"))
    with shared.Kept(spark) as kept:
        first = kept.keep(embedding.embed_missing(chunks.filter("chunk_id % 3 = 0"), f"{kept.path}/e", "v1", digest_embedder, 8).select("chunk_id", F.lit(True).alias("early")))
        both = embedding.embed_missing(chunks, f"{kept.path}/e", "v1", digest_embedder, 8).join(first, "chunk_id", "left")
        return kept.settled(both.select("chunk_id", F.round(F.get("embedding", F.lit(0)), 9).alias("first"), F.round(F.get("embedding", F.lit(7)), 9).alias("last"), F.col("early").isNull().alias("later")))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, 200 + p_size AS level, 25.0::DOUBLE AS pct, CAST(floor((1000 + 10 * p_size) * 0.25) AS BIGINT) AS exp FROM part),
 s(id, n, level, pct, exp, gained) AS (SELECT id, 0, level, pct, exp, CAST(0 AS BIGINT) FROM p UNION ALL
  SELECT id, n + 1, level + CASE WHEN level <= 230 THEN 1 ELSE up END, CASE WHEN level <= 230 THEN pct ELSE left_exp * 100.0 / (1000 + 10 * (level + up - 200)) END, CASE WHEN level <= 230 THEN CAST(floor((1000 + 10 * (level - 199)) * (pct / 100)) AS BIGINT) ELSE left_exp END, CAST(CASE WHEN level <= 230 THEN 1000 + 10 * (level - 200) ELSE 4000 END AS BIGINT)
  FROM (SELECT *, CAST(exp + 4000 - up * need - 5 * up * (up - 1) AS BIGINT) AS left_exp FROM (SELECT *, list_max(list_filter([0, 1, 2, 3, 4, 5], lambda c: c * need + 5 * c * (c - 1) <= exp + 4000)) AS up FROM (SELECT *, 1000 + 10 * (level - 200) AS need FROM s WHERE n < 6))))
 SELECT id, n, CAST(level AS INT) AS level, round(pct, 6) AS percent, gained FROM s WHERE n > 0""")
def potion_steps(t, spark: SparkSession) -> DataFrame:
    """Six potions for each part as a character, by a table function that carries level and experience on."""
    drinks = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 200).cast("int").alias("level"), F.lit(25.0).alias("percent"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    drinks = drinks.select("id", "n", "level", "percent", F.lit(230).alias("sure_level"), F.lit(4000).cast("long").alias("exp"))
    steps = tables.potion_steps({level: 1000 + 10 * (level - 200) for level in range(200, 301)})
    return steps(drinks.asTable()).select("id", "n", "level", F.round("percent", 6).alias("percent"), "gained")


@query("""WITH c AS (SELECT conv_id % 7 AS board_id, turn AS page, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY ALL), g AS (SELECT board_id, page, n, page - row_number() OVER (PARTITION BY board_id ORDER BY page) AS gap FROM c)
 SELECT board_id, CAST(page AS INT) AS page, n AS articles FROM g WHERE gap = 0""")
def board_crawl(t, spark: SparkSession) -> DataFrame:
    """Listing pages made of the conversations, crawled as a stream, two pages of each board in a batch, up to the first page that is missing."""
    rows = t("conversations").filter("turn > 0").select((F.col("conv_id") % 7).alias("board_id"), F.col("turn").alias("page"), F.concat(F.lit('<article data-article-id="'), (F.col("conv_id") + 1).cast("string"), F.lit('"><a class="title" href="/x">t</a></article>')).alias("row"))
    listings = rows.groupBy("board_id", "page").agg(F.array_join(F.collect_list("row"), "").alias("html"))
    with shared.Kept(spark) as kept:
        spark.createDataFrame([], "file string").coalesce(1).write.parquet(f"{kept.path}/made")
        listings.mapInPandas(boards.stored(f"{kept.path}/pages"), "file string").write.mode("append").parquet(f"{kept.path}/made")
        numbers = sorted(r[0] for r in listings.select("board_id").distinct().collect())
        places = boards.stream(spark, f"{kept.path}/pages", numbers, 2)
        while stateful.appended(places, f"{kept.path}/out", f"{kept.path}/checkpoint").lastProgress["numInputRows"]:
            continue
        read = boards.with_text(spark.read.schema(places.schema).parquet(f"{kept.path}/out"), f"{kept.path}/pages")
        return kept.settled(read.select("board_id", "page", F.regexp_count("html", F.lit("data-article-id")).cast("long").alias("articles")))


@query("""SELECT doc_id, 'ok' AS status, 'start' || chr(10) || 'Note ' || doc_id || ' [이미지: map ' || doc_id % 5 || '] end' AS body FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'drift', NULL FROM documents WHERE doc_id % 3 = 0""")
def update_notes(t, spark: SparkSession) -> DataFrame:
    """Official notes made of the documents' numbers; every third container is never closed."""
    number = F.col("doc_id").cast("string")
    page = F.concat(F.lit('<div class="x qs_text"><p>menu</p><div class="new_board_con"><script>no</script>start<p>Note '), number, F.lit('<img alt="map '), (F.col("doc_id") % 5).cast("string"), F.lit('">end</p></div>'), F.when(F.col("doc_id") % 3 != 0, "</div><div>after</div>").otherwise(""))
    return t("documents").select("doc_id", updates.body(page).alias("b")).select("doc_id", "b.status", "b.body")


_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"


@query(f"""WITH l AS (SELECT *, {_NTH} AS nth FROM lineitem),
 p AS (SELECT l_orderkey AS query_id, string_agg('- part ' || l_partkey || ' (날짜 미상): ' || left(l_returnflag || ' ' || l_linestatus || repeat(' x', 100), 180) || ' — 링크 없음', chr(10) ORDER BY nth) AS lines FROM l WHERE nth <= 5 GROUP BY l_orderkey),
 f AS (SELECT l_orderkey AS query_id, nth AS pos, '- s' || l_suppkey || ' → p' || l_partkey || CASE WHEN nth % 2 = 0 THEN ' (일부)' ELSE ' (sells)' END AS line, 'm' || l_suppkey % 3 AS src FROM l WHERE l_orderkey % 4 = 0),
 s AS (SELECT query_id, string_agg(src, ', ' ORDER BY pos) AS src FROM (SELECT query_id, src, min(pos) AS pos FROM f GROUP BY ALL) GROUP BY query_id),
 k AS (SELECT query_id, string_agg(line, chr(10) ORDER BY pos) AS lines FROM f WHERE pos <= 3 GROUP BY query_id)
 SELECT o_orderkey AS query_id, CASE WHEN k.lines IS NOT NULL THEN '로컬 AI 답변을 생성하지 못해 확인된 지식 그래프 관계만 제공합니다.' || chr(10) || k.lines || chr(10) || '출처: ' || s.src
  ELSE '로컬 AI 답변을 생성하지 못해 검색 결과만 제공합니다.' || coalesce(chr(10) || p.lines, '') || chr(10) || '위 목록은 AI 생성 답변이 아니며 원문 정보의 정확성을 보증하지 않습니다.' END AS answer
 FROM orders LEFT JOIN p ON p.query_id = o_orderkey LEFT JOIN k ON k.query_id = o_orderkey LEFT JOIN s ON s.query_id = o_orderkey""")
def grounded_answers(t, spark: SparkSession) -> DataFrame:
    lines = t("lineitem").withColumn("nth", F.expr(_NTH))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    said = F.concat("l_returnflag", F.lit("  "), "l_linestatus", F.lit(" x" * 100))
    evidence = lines.select(F.col("l_orderkey").alias("query_id"), F.col("nth").alias("rank"), name("part ", "l_partkey").alias("title"), F.lit(None).cast("string").alias("published_at"), F.lit("").alias("url"), said.alias("text"))
    facts = lines.filter("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("query_id"), F.col("nth").alias("pos"), name("s", "l_suppkey").alias("subject_name"), F.when(F.col("nth") % 2 == 0, "part_of").otherwise("sells").alias("predicate"), name("p", "l_partkey").alias("object_name"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("source_title"))
    return modes.grounded(t("orders").select(F.col("o_orderkey").alias("query_id")), evidence, facts, relations=3)


@query("""WITH u AS (SELECT l_orderkey AS answer_id, l_partkey % 50 AS chunk_id, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
 SELECT o_orderkey AS answer_id, sha256('q ' || o_custkey) AS question_hash, strftime(TIMESTAMP '2024-01-01' + INTERVAL 30 DAY, '%Y-%m-%d') AS expires, chunk_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY place, chunk_id) AS rank FROM orders JOIN u ON answer_id = o_orderkey""")
def recorded_answers(t, spark: SparkSession) -> DataFrame:
    made = t("orders").select(F.col("o_orderkey").alias("answer_id"), F.col("o_custkey").cast("string").alias("requester_hash"), F.concat(F.lit("q "), F.col("o_custkey").cast("string")).alias("question"), F.lit("a").alias("answer"), F.lit("generated").alias("mode"))
    used = t("lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_partkey") % 50).alias("chunk_id"), F.col("l_linenumber").alias("place"))
    kept, sources = modes.recorded(made.unionByName(made.limit(10)), used, F.lit("2024-01-01").cast("timestamp"))
    return kept.join(sources, "answer_id").select("answer_id", "question_hash", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"), "chunk_id", "rank")


@query("""WITH a AS (SELECT o_custkey AS query_id, o_orderkey AS relation_id, o_orderkey % 3 AS job, o_orderkey % 5 AS boss FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS query_id, o_orderkey AS relation_id, o_orderkey % 4 AS job, o_orderkey % 7 AS boss FROM orders WHERE o_orderkey % 3 <> 1),
 k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id) OR ((b.job = 3 OR EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.job = b.job)) AND EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.boss = b.boss)))
 SELECT DISTINCT query_id, relation_id FROM (SELECT query_id, relation_id FROM a UNION ALL SELECT query_id, relation_id FROM k)""")
def merged_scopes(t, spark: SparkSession) -> DataFrame:
    """Jobs and bosses apart; evidence of job 3 names none."""

    def side(keep: str, jobs: int, bosses: int) -> DataFrame:
        job = F.col("o_orderkey") % jobs
        return t("orders").filter(keep).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("relation_id"), F.col("o_orderkey").alias("pos"), F.when(job == 3, F.array().cast("array<bigint>")).otherwise(F.array(job)).alias("jobs"), F.array(F.col("o_orderkey") % bosses).alias("bosses"), F.lit("v").alias("value"))

    return entities.merge_facts(side("o_orderkey % 2 = 0", 3, 5), side("o_orderkey % 3 <> 1", 4, 7), scopes=("jobs", "bosses")).select("query_id", "relation_id")


@query("SELECT o_orderkey, round((o_custkey % 50 * 5 + ln(o_totalprice + 1) * 2 + o_orderkey % 9 + CASE WHEN age <= 30 THEN 50 ELSE 0 END) * pow(0.5, age / 45.0), 6) AS score FROM (SELECT *, greatest(0, datediff('day', o_orderdate, TIMESTAMP '1998-08-03')) AS age FROM orders) WHERE age < 200")
def fresh_score(t, spark: SparkSession) -> DataFrame:
    age = scalars.age_days(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-03").cast("timestamp"))
    rows = t("orders").withColumn("age", age).filter("age < 200")
    return rows.select("o_orderkey", F.round(scalars.decay_score(F.col("o_custkey") % 50, "o_totalprice", F.col("o_orderkey") % 9, "age", fresh_days=30), 6).alias("score"))


@query("""SELECT event_id, '{"a":' || to_json(event_type) || ',"b":' || to_json(CAST(user_id AS VARCHAR)) || ',"z":"1"}' AS fingerprint FROM events""")
def call_fingerprints(t, spark: SparkSession) -> DataFrame:
    made = F.create_map(F.lit("z"), F.lit("1"), F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return t("events").select("event_id", text.fingerprint(made).alias("fingerprint"))


@query("SELECT p_partkey, 'Blade ' || p_partkey || ' <&> \"x\"' AS said FROM part")
def unescaped_names(t, spark: SparkSession) -> DataFrame:
    """Names whose references were escaped twice."""
    name = F.concat(F.lit("Blade&nbsp;"), F.col("p_partkey").cast("string"), F.lit(" &amp;lt;&#38;&gt; &quot;x&#x22;"))
    return t("part").select("p_partkey", F.replace(text.unescaped(name), F.lit("\u00a0"), F.lit(" ")).alias("said"))


@query("SELECT p_partkey, p_brand AS skill, 'code' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code FROM part")
def skill_headings(t, spark: SparkSession) -> DataFrame:
    heading = F.concat((F.col("p_partkey") % 90).cast("string"), F.lit(". 오리진: "), "p_brand", F.lit(" (active) [6]"))
    page = F.concat(F.lit("<script>var CMTCHKCODE = 'code"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("';</script>"))
    return t("part").select("p_partkey", answers.skill_name(heading).alias("skill"), answers.check_code(page).alias("code"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'official' WHEN s_suppkey % 3 = 0 THEN 'curated' ELSE 'community' END AS category FROM supplier")
def fact_categories(t, spark: SparkSession) -> DataFrame:
    return t("supplier").select("s_suppkey", modes.fact_category(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")), F.col("s_suppkey") % 5 == 0).alias("category"))


@query("""SELECT item_id AS id, item_id % 3 = 0 AS exact_sources, item_id % 4 = 0 AND item_id % 2 = 0 AS violation, item_id % 6 = 5 AS unsupported FROM benchmark""")
def case_flags(t, spark: SparkSession) -> DataFrame:
    b, own = t("benchmark").select(F.col("item_id").alias("id")), F.col("id").cast("string")
    none = F.array().cast("array<string>")
    cases = b.select("id", F.lit("f").alias("family"), F.when(F.col("id") % 6 == 5, none).otherwise(F.array(own, F.lit("x"))).alias("expected_sources"), none.alias("expected_terms"), (F.col("id") % 6 == 5).alias("no_evidence"), (F.col("id") % 2 == 0).alias("security"), F.array(F.lit("SECRET")).alias("banned"))
    got = b.select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("x"), own, own)).otherwise(F.array(own)).alias("sources"), F.when(F.col("id") % 4 == 0, "a Secret word").otherwise("nothing").alias("answer"))
    return evaluation.ranked_cases(cases, got).select("id", "exact_sources", "violation", "unsupported")


_CRAWLS = """WITH o AS (SELECT 'a' || conv_id AS article_key, turn AS comment_id, text, CASE WHEN turn % 3 = 0 THEN 'indexed' ELSE 'sanitized' END AS status, md5(text) AS content_hash FROM conversations WHERE turn % 4 <> 3),
 n AS (SELECT 'a' || conv_id AS article_key, turn AS comment_id, CASE WHEN turn % 5 = 2 THEN '' ELSE text END AS text, CASE WHEN turn % 5 = 2 THEN 'deleted' ELSE 'sanitized' END AS status, md5(text || CASE WHEN turn % 2 = 1 THEN '!' ELSE '' END) AS content_hash FROM conversations WHERE turn > 0) """


def _crawls(t) -> tuple[DataFrame, DataFrame]:
    c = t("conversations").select(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("article_key"), F.col("turn").alias("comment_id"), "text", "turn")
    rest = lambda day, digest, status: [F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("author_hash"), "text", F.lit(0).alias("score"), status.alias("status"), F.md5(digest).alias("content_hash"), *[F.lit(day).cast("timestamp").alias(f"{n}_observed_at") for n in ("first", "last")]]
    old = c.filter("turn % 4 <> 3").select("article_key", "comment_id", *rest("2024-01-01", F.col("text"), F.when(F.col("turn") % 3 == 0, "indexed").otherwise("sanitized")))
    new = c.filter("turn > 0").select("article_key", "comment_id", *rest("2024-01-02", F.concat("text", F.when(F.col("turn") % 2 == 1, "!").otherwise("")), F.lit("new")), (F.col("turn") % 5 == 2).alias("deleted"))
    return old, new


@query(_CRAWLS + """SELECT coalesce(n.article_key, o.article_key) AS article_key, coalesce(n.comment_id, o.comment_id) AS comment_id, coalesce(n.text, o.text) AS text, coalesce(n.status, o.status) AS status, coalesce(n.content_hash, o.content_hash) AS content_hash, CASE WHEN o.comment_id IS NULL THEN 2 ELSE 1 END AS first_day, CASE WHEN n.comment_id IS NULL THEN 1 ELSE 2 END AS last_day
 FROM o FULL JOIN n ON n.article_key = o.article_key AND n.comment_id = o.comment_id""")
def comment_upserts(t, spark: SparkSession) -> DataFrame:
    return merge.upsert_comments(*_crawls(t))[0].select("article_key", "comment_id", "text", "status", "content_hash", F.day("first_observed_at").alias("first_day"), F.day("last_observed_at").alias("last_day"))


@query(_CRAWLS + """SELECT 'comment:' || n.article_key || ':' || n.comment_id AS source_key, CASE WHEN n.status = 'deleted' THEN 'comment.deleted' ELSE 'comment.sanitized' END AS topic, 'comment:' || n.article_key || ':' || n.comment_id || ':' || n.content_hash AS dedupe_key
 FROM n LEFT JOIN o ON n.article_key = o.article_key AND n.comment_id = o.comment_id WHERE o.comment_id IS NULL OR o.content_hash <> n.content_hash""")
def comment_events(t, spark: SparkSession) -> DataFrame:
    return merge.upsert_comments(*_crawls(t))[1]


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS name FROM part""")
def name_expansions(t, spark: SparkSession) -> DataFrame:
    """Expansions of ABC that hold the official name, speak of a scroll, are too long, equal the abbreviation, or share nothing with it."""
    said = ["the Official  Name of it", "주문서 x", "abc" * 5, "A bc", "zzz", "q"]
    pick = F.get(F.array(*[F.lit(x) for x in said]), (F.col("p_partkey") % 6).cast("int"))
    return t("part").select("p_partkey", text.resembles(pick, F.lit("ABC"), F.lit("official name")).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'buff_sequence,deal_cycle,burst_rotation,sub_burst_and_normal' WHEN 1 THEN 'buff_sequence' WHEN 2 THEN 'stolen_skills' WHEN 3 THEN 'core_v_matrix' ELSE 'buff_sequence,deal_cycle,burst_rotation,sub_burst_and_normal,stolen_skills,core_v_matrix' END AS sections FROM part""")
def guide_sections(t, spark: SparkSession) -> DataFrame:
    topic = F.get(F.array(*[F.lit(x) for x in (" 극딜 버프 ", "버프 시퀀스", "훔치기", "V매트릭스")]), (F.col("p_partkey") % 5).cast("int"))
    return t("part").select("p_partkey", F.array_join(analytics.sections_of(topic), ",").alias("sections"))


@query("""WITH j AS (SELECT n_nationkey AS k, n_name AS job_name, n_regionkey AS r FROM nation)
 SELECT job_name, 'o' || k AS skill FROM j WHERE k % 3 = 0 UNION SELECT job_name, x FROM j, (VALUES ('c1'), ('c2')) v(x) WHERE k % 3 > 0 UNION SELECT job_name, 'own' || k FROM j WHERE k % 3 > 0 UNION SELECT job_name, 'f' || r FROM j WHERE k % 3 > 0 AND k % 2 = 0""")
def skill_whitelists(t, spark: SparkSession) -> DataFrame:
    n, k = t("nation"), F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    jobs = n.select(F.col("n_name").alias("job_name"), F.when(k % 3 == 0, F.array(name("o", "n_nationkey"))).alias("official_skills"), F.array(name("own", "n_nationkey")).alias("own_skills"))
    families = t("region").select(F.col("r_regionkey").alias("family"), name("f", "r_regionkey").alias("skill"))
    members = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("job_name"), F.col("n_regionkey").alias("family"))
    return analytics.allowed_skills(jobs, spark.createDataFrame([("c1",), ("c2",)], "skill string"), families, members)
