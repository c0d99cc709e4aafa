"""What a running service keeps: embeddings, boards, notes, JSON, percentiles, calculators, the index at rest."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import tables
from loomspark.operators import documents, embedding, evaluation, retrieval, trigram
from loomspark.sources import boards, updates
from loomspark.streaming import stateful


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def provider(log):
    def embed(texts):
        with open(log, "a") as f:
            f.write(json.dumps(texts) + "\n")
        return [(i, [1.0, 0.0] if len(t) % 2 else [0.0, 1.0]) for i, t in reversed(list(enumerate(texts)))]

    return embed


def test_embeddings_are_asked_for_once(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "x" * (i % 5), i != 3) for i in range(70)] + [(99, None, True)], "chunk_id long, text string, active boolean").coalesce(1)
    log, folder = str(tmp_path / "calls"), str(tmp_path / "e")
    first = embedding.embed_missing(chunks, folder, "v1", provider(log), 2)
    assert first.count() == 69 and {r["chunk_id"] for r in first.collect()} == set(range(70)) - {3}
    calls = [json.loads(line) for line in open(log)]
    assert sum(map(len, calls)) == 69 and max(map(len, calls)) == embedding.SHARD
    assert {tuple(r["embedding"]) for r in first.filter("chunk_id % 5 = 1").collect()} == {(1.0, 0.0)}
    embedding.embed_missing(chunks.withColumn("active", F.lit(True)), folder, "v1", provider(log), 2)
    assert [json.loads(line) for line in open(log)][len(calls) :] == [["xxx"]]
    assert embedding.embed_missing(chunks, folder, "v2", provider(log), 2).count() == 69


@pytest.mark.parametrize("answer", [[], [(0, [1.0, 0.0])] * 2, [(0, [1.0])] + [(1, [1.0, 0.0])], [(0, [math.nan, 0.0]), (1, [1.0, 0.0])], [(0, [2.0, 0.0]), (1, [1.0, 0.0])], [(0, [1.0, 0.0]), (2, [1.0, 0.0])], [(False, [1.0, 0.0]), (1, [1.0, 0.0])]])
def test_bad_answers_are_refused(answer):
    with pytest.raises(embedding.BadAnswer):
        embedding.asked(lambda texts: answer, ["a", "b"], 2)


def test_failed_calls_are_tried_again():
    tries = []

    def flaky(texts):
        tries.append(texts)
        if len(tries) < 3:
            raise ConnectionError
        return [(0, [1.0])]

    assert embedding.asked(flaky, ["a"], 1, tries=3, wait=0) == [[1.0]] and len(tries) == 3
    with pytest.raises(OSError):
        embedding.asked(lambda texts: (_ for _ in ()).throw(TimeoutError()), ["a"], 1, tries=2, wait=0)


def listing(ids):
    return "".join(f'<article data-article-id="{i}"><a class="title" href="/b/{i}">t</a></article>' for i in ids)


def put(folder, pages):
    for (board, page), ids in pages.items():
        (folder / str(board)).mkdir(parents=True, exist_ok=True)
        (folder / str(board) / f"{page}.html").write_text(listing(ids))


def test_boards_stop_at_known_pages_and_go_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put(folder, {(1, 1): [30, 29], (1, 2): [28, 27], (1, 3): [26], (2, 1): [5]})

    def crawl(number):
        while stateful.appended(boards.stream(spark, str(folder), [1, 2], 1, number), out, checkpoint).lastProgress["numInputRows"]:
            continue
        return rows(spark.read.parquet(out))

    first = [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1)]
    assert crawl(1) == first and crawl(1) == first
    put(folder, {(1, 1): [33, 30], (1, 2): [31, 29], (1, 3): [28, 27], (1, 4): [26]})
    assert crawl(2) == sorted([*first, (1, 1, 2), (1, 2, 2)])
    html = boards.with_text(spark.createDataFrame([(1, 1, 2), (9, 1, 1)], "board_id long, page int, crawl int"), str(folder)).orderBy("board_id").collect()
    assert boards.ids_of(html[0]["html"]) == [33, 30] and html[1]["html"] is None


def test_pages_between_offsets_are_the_same_again(tmp_path):
    put(tmp_path, {(1, p): [50 - p] for p in range(1, 6)})
    reader = boards.BoardReader({"path": str(tmp_path), "boards": "1", "pagesPerBatch": "2"})
    at, seen = reader.initialOffset(), []
    for _ in range(4):
        found, after = reader.read(at)
        found = list(found)
        assert list(reader.readBetweenOffsets(at, after)) == found
        seen, at = seen + found, after
    assert [p for _, p, _ in seen] == [1, 2, 3, 4, 5] and json.loads(at["1"])["done"]


def test_update_notes(spark):
    page = """<ul><li><a href="/News/Update/7?x=1"><b>First</b> note</a><dl><dd>2024.05.01</dd><dd>views</dd></dl><ul><li>x</li></ul></li>
      <li><a href="/News/Update/8">Second</a><em class="new modify_common" data-modifytime="2024-05-03 10:30"></em><dd>2024.05.02</dd></li><li><a href="/News/Update/7">Again</a><dd>2024.05.04</dd></li><li><a href="/other">no</a></li></ul>"""
    broken = page.replace("2024-05-03 10:30", "soon")
    df = spark.createDataFrame([(1, page), (2, broken), (3, "<p>none</p>"), (4, None)], "id int, html string")
    got = {r["id"]: r["n"] for r in df.select("id", updates.notes("html", "https://x.example/News/Update").alias("n")).collect()}
    assert [(n["id"], n["title"], n["url"]) for n in got[1]["notes"]] == [(7, "Again", "https://x.example/News/Update/7"), (8, "Second", "https://x.example/News/Update/8")]
    assert [str(n["modified_at"]) for n in got[1]["notes"]] == ["None", "2024-05-03 01:30:00"] and str(got[1]["notes"][0]["published_at"]) == "2024-05-03 15:00:00"
    assert {i: r["status"] for i, r in got.items()} == {1: "ok", 2: "drift", 3: "drift", 4: "drift"}
    bodies = ["<div class=qs_text><div class='a new_board_con'>one<br>two<img alt='map'><style>x</style></div></div><div>after</div>", "<div class=new_board_con>outside</div>", "<div class=qs_text><div class=new_board_con></div></div>", None]
    got = [tuple(r["b"]) for r in spark.createDataFrame(list(enumerate(bodies)), "id int, html string").select("id", updates.body("html").alias("b")).orderBy("id").collect()]
    assert got == [("ok", "one\ntwo [이미지: map]"), ("drift", None), ("drift", None), ("drift", None)]


def plain_redacted(value, key=None):
    if key is not None and key.lower() in ("token", "password", "query"):
        return "<redacted>"
    if isinstance(value, dict):
        return {k: plain_redacted(v, k) for k, v in value.items()}
    return [plain_redacted(v) for v in value] if isinstance(value, list) else value


def test_redaction_at_any_depth(spark):
    rng = random.Random(6)

    def made(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice(["text", 'q"\\', "", 7, -1.5, True, None])
        if kind < 5:
            return {rng.choice(["token", "Password", "a", "b", 'k"', "QUERY", "z"]): made(depth - 1) for _ in range(rng.randrange(4))}
        return [made(depth - 1) for _ in range(rng.randrange(4))]

    docs = {i: made(6) for i in range(60)}
    df = spark.createDataFrame([(i, json.dumps(d), 1) for i, d in docs.items()] + [(100, "{broken", 2), (101, None, 3), (None, "{}", 4)], "id long, document string, text int")
    got = {r["id"]: r for r in documents.redacted(df).collect()}
    assert {i: json.loads(got[i]["document"]) for i in docs} == {i: plain_redacted(d) for i, d in docs.items()}
    assert got[100]["document"] is None and got[101]["document"] is None and None in got and len(got) == 63 and got[5]["text"] == 1
    assert documents.redacted(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 50, 100_000])
def test_percentiles_by_histograms(spark, most):
    rng = random.Random(most)
    data = {"a": [rng.gauss(0, 1e6) for _ in range(900)], "b": [5.0] * 400 + [7.0], "c": [1.0], None: [float(i * i) for i in range(300)], "d": [-1e300, 1e300, 0.0, 1e-300]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None)], "k string, v double")
    for share in (0.05, 0.5, 0.95, 1.0):
        got = {r["k"]: r["v"] for r in evaluation.percentile(df, ["k"], "v", share, most=most, bins=8).collect()}
        want = {k: sorted(vs)[math.ceil(len(vs) * share - 1e-9) - 1] for k, vs in data.items()}
        assert got == {**want, "none": None}


def test_potions_refuse_other_tables(spark):
    steps = tables.potion_steps({1: 10, 2: 20, 3: 30}, top=3)
    drinks = spark.createDataFrame([(1, 2, 1, 50.0, 0, 15), (1, 1, 1, 50.0, 0, 4), (1, 3, 1, 50.0, 0, 100), (1, 4, 1, 50.0, 0, 100)], "id long, n int, level int, percent double, sure_level int, exp int")
    got = rows(steps(drinks.asTable()))
    assert [(r[1], r[2], r[4]) for r in got] == [(1, 1, 4), (2, 2, 15), (3, 3, 100), (4, 3, 0)] and got[0][3] == pytest.approx(90.0) and got[1][3] == pytest.approx(70.0)
    with pytest.raises(Exception, match="sure_level"):
        steps(drinks.drop("sure_level").asTable()).collect()


def test_index_at_rest_reads_what_the_keywords_need(spark, tmp_path):
    words = ["alpha", "alpine", "beta", "über", "gamma"]
    rng = random.Random(2)
    c = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(60)] + [(100, None), (101, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "alp"), (2, "beta gam"), (3, "zzz"), (4, "über"), (5, "")], "query_id long, query string")
    folder = str(tmp_path / "index")
    retrieval.write_index(c, folder, buckets=16)
    plain, indexed = retrieval.lexical(q, c, stage1=20, k=9), retrieval.lexical(q, c, folder, stage1=20, k=9)
    assert rows(plain) == rows(indexed) and plain.count() > 20
    plan = retrieval.keyword_hits(q.filter("query_id = 2"), folder, spark)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_trigrams_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trigram, "BLOCK_CHARS", 30)
    monkeypatch.setattr(trigram, "TEXTS", 3)
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abé_ ") for _ in range(5)) for _ in range(3))
    texts, asked = {i: text() for i in range(30)}, {f"q{i}": text() for i in range(8)}
    own = lambda t: {p[i : i + 3] for w in "".join(ch if ch.isalnum() else " " for ch in t.lower()).split() for p in [f"  {w} "] for i in range(len(p) - 2)}
    want = set()
    for q, said in asked.items():
        scored = sorted((-len(own(said) & own(t)) / len(own(said) | own(t)), i) for i, t in texts.items() if own(said) & own(t))
        want |= {(q, i, n + 1, round(-s, 9)) for n, (s, i) in enumerate(scored[:4])}
    c = spark.createDataFrame([*texts.items(), (99, None)], "chunk_id long, text string")
    q = spark.createDataFrame([*asked.items(), ("none", None)], "query_id string, query string")
    got = trigram.similar(q, c, 4)
    assert {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in got.collect()} == want
    pairs = got.select("query_id", "chunk_id")
    assert {(r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in trigram.scored(pairs, q, c).collect()} == {(a, b, s) for a, b, _, s in want}
