"""Language, toxicity, personal data, pages, archives and licences."""

import hashlib
import io
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspark.llm import html_extract, langid, license_scan, pii, queries, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op10_language_id(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null")
    share = got.agg(F.avg(F.when(F.col("lang") == F.col("lang_pred"), 1.0).otherwise(0.0)), F.avg(F.col("accepted").cast("int"))).first()
    assert share[0] > 0.97 and share[1] > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "hello there you", "en"), (2, "bonjour mes amis", "fr"), (3, None, "en"), (4, "123 !", None), (5, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 and not got[i]["accepted"] for i in (3, 4, 5))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("left", ["de", "es", "fr"])
def test_language_rejects_the_unlearned(spark, left):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and n_chars > 400")
    model = langid.fit(docs.filter(F.col("lang") != left))
    accepted = lambda lang: [model.classify(r["text"])[2] for r in docs.filter(F.col("lang") == lang).limit(60).collect()]
    foreign, english = accepted(left), accepted("en")
    assert sum(foreign) <= 0.2 * len(foreign) and sum(english) >= 0.9 * len(english)
    short = [" ".join(r["text"].split()[:n]) for r in docs.filter("lang = 'en'").limit(60).collect() for n in (2, 4, 9)]
    assert sum(model.classify(t)[2] for t in short) >= 0.9 * len(short)


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    ranks = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (ranks[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.8
    assert got.score.between(0, 1).all() and (got[got.predicted == 1].toxic == 1).mean() > 0.7


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0.0, 0.0]
    assert toxicity.Lexicon({"bad": 2.0}, {}).features("you b4d BAD") != toxicity.Lexicon({"bad": 2.0}, {}).features("you good fine")


def reference_spans(text):
    """The fixed formats by plain regular expressions."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(pii.KINDS.index(k), m.start(), m.end()) for k, m in out]


def test_base_spans_equal_plain_expressions():
    rng = random.Random(6)
    bits = ["a@b.c", "x.y+z@d-e.f.g", "@", ".", "_", "1.2.3.4", "0255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "é", "12", "\n", "a", "-", "4929123412341234"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == reference_spans(text)


def test_long_runs_are_read_once():
    for text in ("7" * 200_000 + ".", "a" * 200_000 + "@", "1." * 100_000, "+" + "1 (" * 60_000, "a=" * 100_000, "k1" * 100_000 + "=", "1.2.3." + "0" * 5000 + "1"):
        began = time.time()
        pii.instances(text, pii.base_spans(text))
        assert time.time() - began < 3
    assert pii.base_spans("1.2.3." + "0" * 5000 + "1") == [(1, 0, 5007)]


def hexed(i):
    return hashlib.sha1(str(i).encode()).hexdigest()[:18]


def planted():
    """(id, text, what patterns must find): keys name patterns, which find values that are no seeds."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, plain = [], ["hunter-two", "x", "correct horse battery", "p!ss#w$rd", "é" * 300, "1234"]
    for i in range(60):
        rows.append((i, f"{word()} {word()} vault-pass = \"{hexed(i)}\" {word()}", hexed(i)))
        rows.append((100 + i, f"{word()}: {word()}\ntel: +1 (555) 01{i:02}-4567 {word()} commit: {hexed(i + 500)}", None))
    rows += [(200 + i, f"{word()} vault-pass = \"{v}\" {word()}", v) for i, v in enumerate(plain)]
    rows += [(300 + i, f"{word()} tel: (0{i}0) 555 12{i:02} {word()}", f"(0{i}0) 555 12{i:02}") for i in range(8)]
    return rows


def test_patterns_find_what_no_seed_looks_like(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    spans = {r["id"]: r["spans"] for r in pii.find(docs).collect()}
    texts = {i: t for i, t, _ in rows}
    hidden = [(i, v) for i, _, v in rows if i >= 200]
    met = sum(any(texts[i][s["start"] : s["end"]] == v for s in spans[i]) for i, v in hidden)
    assert met >= 0.9 * len(hidden)
    assert all([texts[i][s["start"] : s["end"]] for s in spans[i]] == [v] for i, _, v in rows if i < 100)
    assert all([s["kind"] for s in spans[i]] == [3] for i in range(100, 160))


def brute_patterns(occurrences, rounds, confidence, support):
    edges = {(p, v) for v, ps, _ in occurrences for p in ps}
    size = {p: len({v for q, v in edges if q == p}) for p, _ in edges}
    seeds = {(v, k): 1.0 for v, _, k in occurrences if k >= 0}
    confirmed, scored = {}, {}
    for turn in range(rounds):
        named = {k: max(seeds.get(k, 0), confirmed.get(k, 0)) for k in {*seeds, *confirmed}}
        mass = {}
        for p, v in edges:
            for (w, kind), x in (confirmed if p.startswith("own ") else named).items():
                if w == v:
                    mass[p, kind] = mass.get((p, kind), 0) + x
        scored = {(p, k): m / (size[p] + 1) for (p, k), m in mass.items() if size[p] >= support and m / (size[p] + 1) >= confidence}
        confirmed = {}
        for p, v in edges:
            for (q, k), x in scored.items():
                if p == q:
                    confirmed[v, k] = max(x, confirmed.get((v, k), 0))
    return scored


def test_pattern_scores_equal_brute_force(spark):
    rows = [(v, p, s) for _, t, _ in planted() for v, p, _, _, s, _ in pii.instances(t, pii.base_spans(t))]
    rows += [(1000 + i, ["value a=", f"own abc {i % 3}"], 4 if i < 9 else -1) for i in range(11)] + [(2000 + i, [f"own abc {i % 3}"], -1) for i in range(2)]
    occurrences = spark.createDataFrame(rows, "value long, patterns array<string>, seed int")
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii.score_patterns(occurrences, 3, 0.6, 3).collect()}
    want = brute_patterns(rows, 3, 0.6, 3)
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_patterns_alone_find_the_secrets_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted_in = {r["doc_id"] for r in docs.filter("text rlike 'token = \"[0-9a-f]{40}\"'").collect()}
    found = {r["doc_id"] for r in queries.op8_personal_data(spark, SF).filter("n_secret > 0").collect()}
    assert found == planted_in and planted_in


def test_masking_and_edges(spark):
    rows = [(i, f"some words password={hexed(i)} more {i}") for i in range(8)] + [(i, f"the vault-id: {hexed(i % 8)}, as said") for i in range(8, 16)] + [(20, f"also vault-id: {hexed(99)}"), (20, f"also vault-id: {hexed(99)}"), (21, "order of 12345678 pieces"), (22, None), (23, ""), (None, "a@b.c x"), (24, "my Password: correct-horse! and api_key='a b c' 12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("body", "id", "spans", "_body", "_id", "_spans", "row", "of", "hash")])
    found = pii.find(docs)
    spans = {r["id"]: r["spans"] for r in found.collect()}
    assert all(len(spans[i]) == 1 for i in range(16)), spans
    assert len(spans[20]) == 1 and spans[20][0]["kind"] == 4
    assert [(s["start"], s["end"]) for s in spans[24]] == [(13, 26), (41, 46)]
    assert spans[21] == [] and spans[22] == [] and spans[23] == []
    masked = pii.mask(docs, found)
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert got[20] == "also vault-id: <secret>" and got[22] is None and got[None] == "<email> x" and masked.count() == len(rows) and masked.columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0


def brute_cut(odds, edges):
    def cost(label):
        return sum(max(0, x) if not c else max(0, -x) for x, c in zip(odds, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

    return min(cost(label) for label in itertools.product((False, True), repeat=len(odds))), cost


def test_min_cut_equals_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 8)
        odds = [rng.randrange(-8, 9) / 2 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 8) / 2) for _ in range(rng.randrange(12))]
        edges = [e for e in edges if e[0] != e[1]]
        best, cost = brute_cut(odds, edges)
        assert cost(html_extract.min_cut(odds, edges)) == pytest.approx(best)


def test_main_text(spark):
    page = '<html><head><title>t</title><script>var a="<p>x</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy a lot of things now.</div><article><h1>A &amp; B</h1><p>First <b>bold</b>er part\n of it.<p>Second.</article><div id="comments"><p>I like this very much, thanks a lot!</p></div><footer>&copy; x</footer><p>cut <sp'
    assert html_extract.main_text(page).startswith("A & B First bolder part of it. Second.") and "like" not in html_extract.main_text(page) and "Buy" not in html_extract.main_text(page)
    got = html_extract.extract(spark.createDataFrame([(page,), (None,), ("",), ("plain",)], "html string").withColumn("text", F.lit(1))).collect()
    assert got[1]["text"] == "" and got[2]["text"] == ""


def test_classes_of_an_article_do_not_empty_it():
    long = "This paragraph says a great deal about the matter, and it does so in several whole sentences. It goes on."
    page = f'<body><nav class=menu><a href=x>Home</a></nav><article class="post category-social tag-search related"><p>{long}</p><p class="legal-note">{long}</p><div class="ad"><p>Buy it now.</p></div></article>{{}}</body>'
    assert html_extract.main_text(page.format("")) == f"{long} {long}"
    readers = f'<div id="comments"><article class="comment"><p>{long}</p></article></div>'
    assert html_extract.main_text(page.format(readers)) == f"{long} {long}"
    assert html_extract.main_text(page.format(f'<article class="comment-body"><p>{long}</p></article>')) == f"{long} {long}"


def test_neighbours_overturn_what_a_block_says_itself():
    long = "This paragraph says a great deal about the matter, and it does so in several whole sentences. It goes on."
    page = f"<body><div><p>{long}</p><p>Fig 3</p><p>{long}</p></div><div><a href=x>Home</a></div><div><a href=y>More</a></div></body>"
    blocks = html_extract.blocks_of(page)
    own = html_extract.evidence(blocks, html_extract.Costs())
    labels = html_extract.min_cut(own, html_extract.ties(blocks))
    assert own[1] < 0 and labels == [True, True, True, False, False]
    assert html_extract.main_text(page) == f"{long} Fig 3 {long}"


def test_whole_pages_equal_the_cheapest_labelling(spark):
    rng = random.Random(12)
    tags = ["<p>{}</p>", "<div class=ad>{}</div>", "<li><a href=x>{}</a></li>", "<h2>{}</h2>", "<article>{}</article>", "<footer>{}</footer>", "<span>{}</span><br>"]
    words = lambda: " ".join(rng.choice(["One", "two,", "three.", "four", "© five"]) for _ in range(rng.randrange(1, 12)))
    pages = ["".join(rng.choice(tags).format(words()) for _ in range(rng.randrange(1, 10))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    costs = html_extract.fit(df)
    assert costs != html_extract.Costs()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, costs=costs).collect()}
    for i, page in enumerate(pages):
        blocks = html_extract.blocks_of(page)
        own, ties = html_extract.evidence(blocks, costs), html_extract.ties(blocks)
        best, cost = brute_cut(own, ties)
        kept = [b.text for b in blocks]
        texts = {" ".join(t for t, c in zip(kept, label, strict=True) if c) for label in itertools.product((False, True), repeat=len(blocks)) if cost(label) < best + 1e-6}
        assert got[i] in texts


def test_pages_of_every_kind(spark):
    long = "<article>" + "<p>word and word.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "<p>"), (4, "<p>")], "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("x", F.lit(1))
    got = html_extract.extract(df, costs=html_extract.fit(df))
    rows = got.collect()
    assert got.columns == df.columns and len(rows) == 5 and {len(r["text"]) for r in rows} == {0, 15 * 20_000 - 1}
    assert html_extract.fit(df.limit(0)) == html_extract.Costs() and html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 7, 100, 10_000])
def test_split_reader_owns_each_record_once(split):
    inner = warc.member("response", "<urn:x:inner>", None, None, b"inner", "d", content="text/plain")
    records = [warc.member("response", f"<urn:x:{i}>", None, None, bytes([i]) * i + (inner if i == 3 else b""), "d", content="text/plain") for i in range(6)]
    data = b"".join(records)
    if split == 1:
        data, records = b"".join(records[:3]), records[:3]
    got = [r for s in range(0, len(data), split) for r in warc.records_in(io.BytesIO(data), len(data), s, s + split)]
    assert [r[2] for r in got] == [f"<urn:x:{i}>" for i in range(len(records))]
    assert got[2][6] == b"\x02\x02"


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ö", "x" * 1500), (2, None, "x" * 1500), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "bad\r\nname", "é" * 600), (6, "again", "é" * 600), (None, "n", "x" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/w")
    got = [r for r in warc.read(spark, files, 512).collect() if r["type"] != "warcinfo"]
    kinds = sorted((r["record_id"], r["type"], r["refers_to"]) for r in got)
    assert len(got) == 8 and ("<urn:x-page:1>", "revisit", "<urn:x-page:2>") in kinds and sum(k[1] == "revisit" for k in kinds) == 1
    for r in got:
        if r["payload"] is not None:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["digest"]
    assert warc.read(spark, warc.write(pages.limit(0), f"file://{tmp_path}/e")).filter("type <> 'warcinfo'").count() == 0


def test_licences_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "some text"), (3, "a/b/LICENSE.txt", "words\nLicensed under the Apache License, Version 2.0.\nwords"), (4, "a/y.py", "The work. \nThis work is licensed under the GNU General Public License, version 3."),
        (5, "z/q.py", "mit dem Zug"), (6, None, "Released under the MIT License."), (7, "a/n.py", None), (7, "a/n.py", None),
    ]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).select("doc_id", "own", "licence", "from_dir", "up").collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", "MIT", None, None), (2, None, "Apache-2.0", "a/b", 1), (3, "Apache-2.0", "Apache-2.0", None, None), (4, "GPL-3.0", "GPL-3.0", None, None), (5, None, None, None, None), (6, "MIT", "MIT", None, None), (7, None, "MIT", "a", 0), (7, None, "MIT", "a", 0)], key=str)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "hello there you", "en"), (2, "bonjour mes amis", "fr")], "doc_id long, text string, lang string").withColumn("_found", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2))
    got = langid.identify(docs, langid.fit(docs))
    assert [r["_found"] for r in got.collect()] == ["mine", "mine"] and got.columns[: len(docs.columns)] == docs.columns
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs.limit(0), toxicity.fit(docs, labels))
    assert scored.count() == 0 and scored.columns == [*docs.columns, "score"]
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_language_equals_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(150)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        counts = langid.ngram_counts(r["text"])
        if counts is None:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        weights = [math.log(1 + int(c)) * float(w) for c, w in zip(counts, model.idf, strict=True)]
        length = math.sqrt(sum(x * x for x in weights))
        cosines = [sum(x * float(y) for x, y in zip(weights, centre, strict=True) if x) / length for centre in model.centroids]
        assert abs(got[r["doc_id"]]["score"] - max(cosines)) < 1e-9
        assert got[r["doc_id"]]["lang_pred"] in {n for n, c in zip(model.languages, cosines, strict=True) if c > max(cosines) - 1e-9}


def test_toxicity_features_equal_plain_counts():
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 3.0}, {"idio": 1.5})
    text = "YOU are BAD, bad idiots!! and b4d? tu 3x"
    got = dict(zip(toxicity.FEATURES, lexicon.features(text), strict=True))
    words = re.findall(r"[^\W_]+", text.lower())
    assert got["word_hits"] == 2 and got["word_density"] == 2 / len(words) and got["stem_hits"] == 1 and got["strongest"] == 2.0 and got["distinct_hits"] == 2
    assert got["exclamations"] == 2 / len(words) and got["questions"] == 1 / len(words) and got["mark_runs"] == 1 / len(words)
    assert got["capitals"] == sum(c.isupper() for c in text) / len(text) and got["obfuscated_hits"] == 1 and got["second_person"] == 2 / len(words)
    assert lexicon.features(None) == lexicon.features("") == [0.0] * len(toxicity.FEATURES)
    assert len(lexicon.features("bad " * 300_000)) == len(toxicity.FEATURES)


def test_headers_of_very_long_texts(spark):
    lines = [f"line of text number {i}" for i in range(100_000)]
    lines[70_000] = "# Released under the MIT License."
    df = spark.createDataFrame([(1, "a/b.txt", "\n".join(lines)), (2, "a/c.txt", "\n".join(["Licensed under CC BY 4.0."] * 5_000))], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert (got[1]["own"], got[1]["line"], got[1]["lines"]) == ("MIT", 70_000, 1)
    assert (got[2]["own"], got[2]["line"]) == ("CC-BY-4.0", 0)


def test_real_headers_are_found(spark):
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    full = [(n, t) for n, t in license_scan.TEMPLATES if len(t.split()) > 20]
    rows = []
    for i, (name, text) in enumerate(full):
        for j, mark in enumerate((" * ", "# ")):
            rows.append((10 * i + j, f"src/{i}/{j}.c", f"#include <x>\n{wrap(text, mark)}\n\nint main() {{ return 0; }}", name))
    rows += [(1000 + i, f"id/{i}/x.py", f"# SPDX-License-Identifier: {n}\nimport os", n) for i, n in enumerate(license_scan.IDENTIFIERS)]
    rows += [(2000, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 A\n\n" + wrap(next(t for n, t in full if n == "MIT"), "") + "\n\nThe above copyright notice and this permission notice shall be included in all copies.", "MIT"), (2001, "m/a/b.c", "int x;" * 100_000, "MIT")]
    plain = [(3000 + i, f"p/{i}.txt", t, None) for i, t in enumerate(["the general public is free to use the library", "you may copy this file and use it", "", None, "permission is needed for use of the source"])]
    df = spark.createDataFrame(rows + plain, "doc_id long, path string, text string, want string").withColumn("key", F.lit(1)).withColumn("licence", F.lit("x"))
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(df).collect()}
    assert sum(got[r[0]] == r[3] for r in rows) >= 0.9 * len(rows)
    assert all(got[r[0]] is None for r in plain)


def test_pipeline_keeps_the_clean(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.language(spark, docs, SF)
    assert left.columns == docs.columns and left.count() > 0.97 * docs.count()
    clean = corpus_pipeline.personal_data(spark, left.limit(50), SF)
    assert clean.columns == docs.columns and clean.count() == 50


def test_pipeline_stages_on_rows_of_every_kind(spark):
    import corpus_pipeline

    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(n))
    body, item = words(60), spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, body, "en"), (2, body + " more", "en"), (3, words(70), "en"), (3, words(80), None), (4, None, "en"), (5, "", None), (None, body + " x", "en"), (6, f"{words(20)} {item} {words(20)}", "en"), (7, body, "en"), (7, body, "en"), (8, "mail a@b.example now", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("_found", F.lit(1)).withColumn("bucketed", F.lit(2))
    for name in ("n_tokens", "bucket", "bucket_end", "batch", "slot", "component_id", "n_shingles", "lang_pred", "score", "accepted", "item_id", "spans", "base", "key", "row", "found"):
        docs = docs.withColumn(name, F.lit("clash"))
    once = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["lang"] or "") for r in once.collect()) == [(0, "en"), (1, "en"), (3, ""), (3, "en"), (4, "en"), (5, ""), (6, "en"), (8, "en")]
    twice = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3"))
    assert corpus_pipeline.near_duplicates(spark, twice, SF).count() == 2
    assert {r["doc_id"] for r in corpus_pipeline.benchmark_leaks(spark, docs, SF).collect()} == {1, 2, 3, 4, 5, 7, 8, None}
    masked = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert masked[8]["text"] == "mail <email> now" and masked[8]["n_chars"] == 16 and masked[4]["text"] is None
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {*docs.columns} == {*packed.columns} and dict(packed.dtypes)["batch"] == "bigint" and packed.count() == len(rows) and {r["text"] for r in packed.collect()} == {r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_pipeline_leaves_what_plain_stages_leave(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    kept = {i: r["text"] for i, r in texts.items() if model.classify(r["text"])[2]}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in kept.items() if (w := t.lower().split())}
    least = {i: i for i in kept}
    by_gram = {}
    for i, own in sets.items():
        for g in own:
            by_gram.setdefault(g, []).append(i)

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for pair in {p for ids in by_gram.values() if len(ids) > 1 for p in itertools.combinations(ids, 2)}:
        a, b = (sets[i] for i in pair)
        if 10 * len(a & b) >= 8 * len(a | b):
            x, y = sorted(map(top, pair))
            least[y] = x
    kept = {i: t for i, t in kept.items() if least[i] == i}
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verbatim = {i for i, t in kept.items() if any(" ".join(item) in " ".join(t.lower().split()) for item in items)}
    assert verbatim and not verbatim & set(out) and set(out) <= set(kept)
    assert len(set(kept) - verbatim - set(out)) <= 0.03 * len(kept)
    for i, r in out.items():
        assert not pii.base_spans(r["text"]) or pii.base_spans(r["text"]) != pii.base_spans(kept[i])
        if not pii.base_spans(kept[i]) and "token" not in kept[i]:
            assert r["text"] == kept[i] and r["n_chars"] == len(kept[i])
        assert r["n_tokens"] <= r["bucket_end"] and (r["slot"] + 1) * r["bucket_end"] <= max(16384, r["bucket_end"])


