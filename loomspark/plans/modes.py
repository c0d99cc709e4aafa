"""Which parts of the retrieval plan a query mode uses, and the state of an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What an answer without a generator says, and how relations are named in it.
NO_ANSWER, NO_WARRANTY = "로컬 AI 답변을 생성하지 못해 검색 결과만 제공합니다.", "위 목록은 AI 생성 답변이 아니며 원문 정보의 정확성을 보증하지 않습니다."
FACTS_ONLY, SOURCES = "로컬 AI 답변을 생성하지 못해 확인된 지식 그래프 관계만 제공합니다.", "출처: "
NO_TITLE, NO_DATE, NO_LINK = "제목 없음", "날짜 미상", "링크 없음"
PREDICATES = {
    "is_a": "속함", "part_of": "일부", "abbreviation_of": "공식 명칭", "has_effect": "효과", "variant_of": "난이도 변형",
    "has_difficulty": "난이도", "uses_mode": "적용 모드", "has_condition": "도전 조건", "upgrades_from": "이전 장비", "requires": "선행 조건",
}


@dataclass(frozen=True)
class Plan:
    """evidence: search passages; hops: graph distance, 0 for none; linked: entities of the evidence too; anchors: boost their names."""

    evidence: bool
    hops: int
    linked: bool
    anchors: bool


MODES = {
    "local": Plan(False, 1, False, False),
    "global": Plan(False, 2, False, False),
    "hybrid": Plan(True, 2, False, True),
    "naive": Plan(True, 0, False, False),
    "mix": Plan(True, 1, True, True),
    "bypass": Plan(False, 0, False, False),
}
#: Rejections in the order in which they are checked, with the message's flag.
REJECTIONS = ("non_user_message", "guild_denied", "channel_denied", "user_denied", "direct_mention_required", "invalid_rag_mode", "empty_question", "question_too_long", "dangerous_url_scheme", "too_many_mentions")


def plan_of(mode: str) -> Plan:
    try:
        return MODES[mode.lower()]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}") from None


def route(messages: DataFrame, bot_id: int, guilds: tuple[int, ...], channels: tuple[int, ...], blocked: tuple[int, ...] = (), longest: int = 1000) -> DataFrame:
    """messages with reason, question and mode: the first rejection that holds, or accepted.

    messages: author_id, author_is_bot, guild_id, channel_id, content. Leading options --no-rag and --rag-mode <mode> are
    taken off the question in any number; the last one counts.
    """
    mention = rf"<@!?{bot_id}>"
    q = F.trim(F.regexp_replace(F.regexp_replace("content", mention, " "), r"(?U)\s+", " "))
    options = F.regexp_extract(q, r"(?i)^((?:--no-rag(?: |$)|--rag-mode \S+(?: |$))*)", 1)
    modes = F.regexp_extract_all(options, F.lit(r"(?i)--(?:no-(rag)|rag-mode (\S+))"), F.lit(0))
    value = F.transform(modes, lambda m: F.when(F.lower(m) == "--no-rag", F.lit("bypass")).otherwise(F.lower(F.element_at(F.split(m, " "), -1))))
    rows = messages.withColumn("question", F.trim(F.substring(q, F.length(options) + 1, F.length(q) + 1))).withColumn("mode", F.coalesce(F.try_element_at(value, F.lit(-1)), F.lit("mix")))
    bad_mode = F.exists(value, lambda m: ~m.isin(*MODES))
    among = lambda c, ids: F.col(c).isin(*ids) if ids else F.lit(False)
    reason = F.when(F.col("author_is_bot"), REJECTIONS[0]).when(~among("guild_id", guilds), REJECTIONS[1]).when(~among("channel_id", channels), REJECTIONS[2]).when(among("author_id", blocked), REJECTIONS[3])
    reason = reason.when(~F.col("content").rlike(mention), REJECTIONS[4]).when(bad_mode, REJECTIONS[5]).when(F.col("question") == "", REJECTIONS[6]).when(F.length("question") > longest, REJECTIONS[7])
    reason = reason.when(F.col("question").rlike(r"(?i)\b(?:javascript|data|file|vbscript):"), REJECTIONS[8]).when(F.regexp_count(F.col("question"), F.lit("<@")) > 2, REJECTIONS[9])
    return rows.withColumn("reason", reason.otherwise("accepted"))


def answer_mode(direct: Column | str, evidence: Column | str, facts: Column | str, generated: Column | str) -> Column:
    """State of an answer: direct, insufficient_evidence (neither evidence nor facts), generated or retrieval_only."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(direct), "direct").when((c(evidence) == 0) & (c(facts) == 0), "insufficient_evidence").when(c(generated), "generated").otherwise("retrieval_only")


def fact_category(publisher: Column | str, official: Column | str) -> Column:
    """Which disclosure a fact's source needs."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(official), "official").when(c(publisher).isNull(), "curated").otherwise("community")


def provenance(answers: DataFrame, sources: DataFrame, chunks: DataFrame, requester: Column, now: Column) -> DataFrame:
    """Sources of a requester's answers that haven't expired, by rank; addresses of inactive chunks are hidden."""
    live = answers.filter((F.col("requester_hash") == requester) & (F.col("expires_at") > now)).select("answer_id")
    return sources.join(live, "answer_id").join(chunks.select("chunk_id", "active", "url"), "chunk_id").select("answer_id", "rank", "chunk_id", F.when(F.col("active"), F.col("url")).alias("url"))


def fallback(evidence: DataFrame, most: int = 5, length: int = 180) -> DataFrame:
    """Text of an answer without generator: the first passages, cut to length, numbered."""
    top = evidence.filter(F.col("rank") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.regexp_replace("text", r"(?U)\s+", " "), 1, length).alias("t")))), lambda e: F.concat(e["rank"].cast("string"), F.lit(". "), e["t"]))
    return top.groupBy("query_id").agg(F.array_join(lines, "\n").alias("answer"))


def grounded(queries: DataFrame, evidence: DataFrame, facts: DataFrame, passages: int = 5, relations: int = 20, length: int = 180) -> DataFrame:
    """(query_id, answer) without a generator: a query's facts with their sources, or without any its first passages.

    evidence (query_id, rank, title, published_at, url, text); facts (query_id, pos, subject_name, predicate, object_name,
    source_title). Of the facts the first `relations` are named, of the sources each once, in the order of the facts.
    """
    of = lambda rows, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows, c.alias("line")))), lambda x: x["line"]), "\n")
    given = lambda c, none: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    passage = F.concat(F.lit("- "), given("title", NO_TITLE), F.lit(" ("), F.substring(given("published_at", NO_DATE), 1, 10), F.lit("): "), F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, length), F.lit(" — "), given("url", NO_LINK))
    found = evidence.filter(F.col("rank") <= passages).groupBy("query_id").agg(of("rank", passage).alias("passages"))
    label = F.lit(None).cast("string")
    for name, said in PREDICATES.items():
        label = F.when(F.col("predicate") == name, said).otherwise(label)
    relation = F.concat(F.lit("- "), "subject_name", F.lit(" → "), "object_name", F.lit(" ("), F.coalesce(label, "predicate"), F.lit(")"))
    titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_title"))), lambda x: x["source_title"]))
    named = facts.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    known = named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= relations, F.struct("n", relation.alias("line"))))), lambda x: x["line"]), "\n").alias("relations"), F.array_join(titles, ", ").alias("titles"))
    both = queries.select("query_id").distinct().join(found, "query_id", "left").join(known, "query_id", "left")
    plain = F.concat_ws("\n", F.lit(NO_ANSWER), "passages", F.lit(NO_WARRANTY))
    return both.select("query_id", F.when(F.col("relations").isNotNull(), F.concat(F.lit(f"{FACTS_ONLY}\n"), "relations", F.lit(f"\n{SOURCES}"), "titles")).otherwise(plain).alias("answer"))


def recorded(answers: DataFrame, used: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """What is kept of answers: (answer_id, requester_hash, question_hash, answer, mode, created_at, expires_at) and their sources (answer_id, rank, chunk_id).

    answers (answer_id, requester_hash, question, answer, mode); used (answer_id, chunk_id, place). An answer that is given
    twice is kept once, the last; sources are numbered from 1 in the order of place, each chunk once.
    """
    last = answers.groupBy("answer_id").agg(F.max_by(F.struct(*[c for c in answers.columns if c != "answer_id"]), F.struct("question", "answer")).alias("a")).select("answer_id", "a.*")
    kept = last.select("answer_id", "requester_hash", F.sha2(F.encode("question", "UTF-8"), 256).alias("question_hash"), "answer", "mode", now.alias("created_at"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"))
    once = used.join(last.select("answer_id"), "answer_id", "left_semi").groupBy("answer_id", "chunk_id").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("place", "chunk_id"))
    return kept, once.select("answer_id", rank.alias("rank"), "chunk_id")


def attribution(steps: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Per run the tools that were used, in a fixed order."""
    used = steps.filter("status = 'succeeded'").groupBy("run_id").agg(F.collect_set("tool").alias("used"))
    return used.select("run_id", F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains("used", t)).alias("tools"))
