import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import answers, text
from loomspark.operators import chunking, retrieval
from loomspark.plans import registry


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_masks_in_order_and_keeps_lines(spark):
    raw = "mail a.b@c.de  now\t010-1234-5678\n\n\n\n<@123456789012345678> x"
    assert one(spark, text.masked("t"), t=raw) == "mail [이메일 삭제] now [전화번호 삭제]\n\n[Discord 식별자 삭제] x"
    assert one(spark, text.masked_fields("t"), t=raw) == ["discord_id", "email", "phone"]


def test_masks_and_their_sql_agree(spark, tmp_path):
    texts = {
        "a@b.co a@b.co+c@d.kr": "[이메일 삭제] [이메일 삭제]+[이메일 삭제]", "01012345678 +82 10-1234-5678": "[전화번호 삭제] [전화번호 삭제]", "ab#1234.cd#5678": "[Discord 식별자 삭제].[Discord 식별자 삭제]",
        "٣01012345678": "٣01012345678", "𝟘01012345678": "𝟘01012345678", "xⒶ#1234 x²#1234": "[Discord 식별자 삭제] x²#1234", "x\u00a0\x1cy \u3000": "x\ny", "\u2003a\x85\x0b\r\n\nb": "a\n\nb",
    }
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["pii_mask"](spark, str(tmp_path)).collect())
    assert got == list(enumerate(texts.values()))
    held = duckdb.connect()
    held.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(held.sql(registry.ORACLE_SQL["pii_mask"]).fetchall()) == got


def test_content_hash_separates_parts(spark):
    import hashlib

    def expected(*parts):
        h = hashlib.sha256()
        for p in parts:
            h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
        return h.hexdigest()

    assert one(spark, text.content_hash("a", "b"), a="äb", b="c") == expected("äb", "c")
    assert one(spark, text.content_hash("a", "b"), a="ä", b="bc") != expected("äb", "c")


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    salt = "0123456789abcdef"
    assert one(spark, text.keyed_hash("t", salt), t="  Nick ") == hmac.new(salt.encode(), b"loomspark:nickname:v1\0nick", hashlib.sha256).hexdigest()


def test_tokens_keywords_sections(spark):
    assert one(spark, text.token_count("t"), t="Añb c가d, x!") == 5
    assert one(spark, text.keywords("t"), t="a-b 가 " + "x" * 101) == ["a", "b", "가"]
    assert one(spark, text.sections("t"), t="a\n\nb\n- c\n## d e") == ["a", "b", "- c", "## d e"]


def test_similarity_and_coverage(spark):
    assert one(spark, text.set_similarity(text.trigrams("a"), text.trigrams("b")), a="word", b="words") == 4 / 7
    assert one(spark, text.coverage("a", "b"), a="ab cd", b="xab") == 1 / 4
    assert one(spark, text.coverage("a", "b"), a="", b="xab") == 0.0


def test_expansions_and_compounds(spark):
    assert one(spark, text.expansions("t", F.lit("AB")), t="AB(alpha  beta) AB = gamma, AB[alpha beta]") == ["alpha beta", "gamma"]
    assert one(spark, text.compounds("t", F.lit("가나"), "가-힣"), t="가나 가나다 x가나라") == ["가나다", "가나라"]


def test_messages(spark):
    assert one(spark, text.neutral_mentions("t"), t="@everyone <@1>") == "@​everyone <@​1>"
    parts = one(spark, text.message_parts("t", 100), t="a" * 60 + "\n" + "b" * 70)
    assert parts == ["a" * 60, "b" * 70]
    assert one(spark, text.truncated("t", 5), t="ab  cdef") == "ab c…"


def test_redaction_and_urls(spark):
    got = one(spark, text.redacted("m"), m={"token": "t", "note": "see https://u:p@h/x"})
    assert got == {"token": "<redacted>", "note": "see <redacted-url>h/x"}
    assert one(spark, text.allowed_url("u", ("a.com",)), u="https://a.com/x") is True
    assert one(spark, text.allowed_url("u", ("a.com",)), u="https://u@a.com/x") is False
    assert one(spark, text.allowed_url("u", ("a.com",)), u="http://a.com/x") is False


def test_python_backed_functions(spark):
    assert one(spark, text.normalized_nfkc("t"), t=" Ｆｕｌｌ  ß ") == "full ss"
    assert one(spark, text.unescaped("t"), t="&amp;lt;b&gt;") == "<b>"
    assert abs(one(spark, text.matching_ratio("a", "b"), a="abcd", b="bcde") - 0.75) < 1e-12


def test_roles_and_groups(spark):
    row = spark.createDataFrame([(True, "b", "comment:article:1:2:9", None, "질문 문맥: q\n\n댓글 1: a")], "q boolean, b string, k string, p string, t string")
    kind = text.role("q", "b")
    got = row.select(kind.alias("r"), text.group_key("k", kind, "p").alias("g"), text.claim_text("t", kind).alias("c")).first()
    assert tuple(got) == ("answer_with_question_context", "comment-thread:article:1:2", "댓글 1: a")


def test_message_parts_fill_what_they_can(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(["ab", " ", "\n", "\n\n", "x" * 40, "é", "@here "]) for _ in range(rng.randrange(300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*made, None, " \n ", "y" * 350])], "id long, t string")
    got = {r["id"]: r["p"] for r in df.select("id", text.message_parts("t", 100).alias("p")).collect()}
    for i, body in enumerate(made):
        safe = body.replace("@here", "@\u200bhere")
        assert "".join("".join(got[i]).split()) == "".join(safe.split()) and all(0 < len(p) <= 100 and p == p.strip() for p in got[i])
        rest = safe.strip()
        for part in got[i][:-1]:
            assert rest.startswith(part) and len(rest) > 100
            tail = rest[len(part) : 101]
            assert not tail.strip() or len(part) == 100 or not any(c in " \n" for c in tail.lstrip())
            rest = rest[len(part) :].lstrip()
    assert got[60] == got[61] == [] and got[62] == ["y" * 100] * 3 + ["y" * 50]


def test_log_values_are_redacted(spark):
    row = spark.sql("select map('message', 'a', 'discord_token', 'b', 'Query', 'c', 'level', 'info', 'url', 'https://u:p@h/x') m").select(text.redacted("m").alias("r")).first()["r"]
    assert row["message"] == row["discord_token"] == row["Query"] == "<redacted>" and row["level"] == "info" and "u:p" not in row["url"]


def test_chunks_hold_all_words_within_bounds(spark):
    rng = random.Random(5)
    for _ in range(300):
        body = "".join(rng.choice(["word ", "b! ", "\n\n", "\n# head ", "\n- item ", "!" * 30 + " ", "x" * 9, "가나 "]) for _ in range(rng.randrange(60)))
        sections = chunking.pieces(body, 17)
        assert "".join("".join(sections).split()) == "".join(body.split()) and all(0 < chunking.tokens(s) <= 17 for s in sections)
        sizes = [chunking.tokens(s) for s in sections]
        ranges = chunking.spans(sizes, 9, 17, 5)
        assert [b for _, b in ranges] == sorted({b for _, b in ranges}) and (not sizes or ranges[-1][1] == len(sizes))
        fresh = 0
        for a, b in ranges:
            assert a <= fresh < b and sum(sizes[a:fresh]) <= 5 and (sum(sizes[a:b]) <= 17)
            assert b == fresh + 1 or sum(sizes[a:b]) <= 9
            assert b == len(sizes) or sum(sizes[a : b + 1]) > 9
            fresh = b
    with pytest.raises(ValueError, match="budget"):
        chunking.bodies("a", 15, 9, 20, 5)


def test_rerank_documents_keep_the_header(spark):
    head = "제목: t\n게시판: b\n\n"
    rows = [(1, head + "x" * 3000, "community_post"), (2, "제목: t\n게시판: b\nbody " + "y" * 3000, "community_post"), (3, "plain " * 400, "community_post"), (4, "질문 문맥: q\n\n댓글 1: " + "z" * 3000, answers.BRANCH), (5, "short", "community_post"), (6, "제목: " + "w" * 3000, "community_post")]
    df = spark.createDataFrame(rows, "id long, p string, k string")
    got = {r["id"]: r for r in df.select("id", answers.rerank_document("p", "k", F.lit("T"), F.lit(None)).alias("d"), answers.question_context("p", "k").alias("q")).collect()}
    assert all(len(got[i]["d"]) == 1500 for i in (1, 2, 3, 4, 6)) and got[5]["d"] == "short"
    assert got[1]["d"].startswith(head) and got[2]["d"].startswith("제목: t\n게시판: b\nbody ") and got[4]["d"].startswith("제목: T\n게시판: 게시판 미상\n댓글 답변:\n댓글 1: zz")
    assert got[4]["q"] == "q" and got[1]["q"] is None


def test_scope_and_anchors_steer_the_hybrid_search(spark):
    corpus = spark.createDataFrame([(1, "article:1", "g1", "red fox", "the red fox runs"), (2, "article:2", "g2", "blue fox", "the blue fox runs"), (3, "article:3", "g3", "red hen", "the red hen sits")], "chunk_id long, source_key string, group_key string, title string, text string")
    legs = spark.createDataFrame([(7, 3, 1), (7, 2, 2), (7, 1, 3)], "query_id long, chunk_id long, rank int")
    asked = spark.createDataFrame([(7, "red fox runs", [["red"], ["fox", "wolf"]], ["fox"])], "query_id long, query string, groups array<array<string>>, anchors array<string>")
    found = retrieval.hybrid(asked, corpus, legs, legs)
    assert [r["chunk_id"] for r in found.collect()] == [1]
    assert {r["chunk_id"] for r in retrieval.hybrid(asked.drop("groups", "anchors"), corpus, legs, legs).collect()} == {1, 2, 3}
