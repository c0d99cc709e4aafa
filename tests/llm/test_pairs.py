"""Similarity join, fingerprints, packing and decontamination against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import common, decontam, fingerprint, ngram_join, packing


def corpus(seed=5, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 90))] for _ in range(n // 4)]
    out = []
    for own in base:
        out.append(" ".join(own))
        for edits in (1, 2, 5):
            copy = list(own)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if edits == 1 else "\t".join(copy))
    return [*out, *out[:3], "", None, "one two", "one two", "  \n ", "x" * 5000]


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "threshold", "percent", "cluster"), [(4, "0.85", 85, 100), (5, "0.8", 80, 5), (4, "0.85", 85, 0)])
def test_components_equal_brute_force(spark, k, threshold, percent, cluster, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    monkeypatch.setattr(ngram_join, "CLUSTER", cluster)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sig", F.lit("clash"))
    got = ngram_join.jaccard_components(df, k=k, threshold=threshold)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, k, percent)


def test_join_on_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_components(df).collect()].count((1, 2, 1)) == 2


def test_spanning_pairs_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for i in range(60):
        own = base.copy()
        own[rng.choice(200, rng.integers(0, 12), replace=False)] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(own))
    limit = ngram_join.Fraction("0.85")
    row = lambda i, no=None: (-1, i, i, len(sets[i]), ngram_join.bitmap(sets[i]), no)
    every = set(ngram_join._spanning([row(i) for i in range(60)], limit, 60))
    some = set(ngram_join._spanning([row(i) for i in range(60)], limit))
    linked = {(i, j) for i, j in itertools.combinations(range(60), 2) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= every and some <= every and len(some) < 60
    refuted = {i: [j for pair in some for j in pair if i in pair and j != i] for i in range(60)}
    assert not some & set(ngram_join._spanning([row(i, refuted[i]) for i in range(60)], limit))


def test_prefixes_share_as_many_shingles_as_they_must():
    rng = np.random.default_rng(3)
    limit = ngram_join.Fraction("0.85")
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.concatenate((a[: len(a) - int(rng.integers(0, 1 + len(a) // 8))], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if both * 100 >= 85 * (len(a) + len(b) - both):
            size = [ngram_join._prefix_size(len(v), limit) for v in (a, b)]
            met = len(np.intersect1d(a[: size[0]], b[: size[1]]))
            assert met >= max(len(v) * 85 // (100 * ngram_join.SPARE) + 1 for v in (a, b))


def test_components_of_a_path(spark):
    ids = [7, -3, 12, 5, 99, -40, 8]
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (200, 201), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(ids, -40), 200: 200, 201: 200}


def test_components_of_few_edges_write_few_tables(spark, monkeypatch):
    rng = random.Random(17)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(500)]
    edges, written = spark.createDataFrame([*pairs, (None, 4)], "a long, b long"), []
    keep = common.Scratch.written
    monkeypatch.setattr(common.Scratch, "written", lambda self, df: written.append(1) or keep(self, df))
    few = sorted(map(tuple, common.components(edges).collect()))
    assert len(written) <= 2
    monkeypatch.setattr(common, "EDGES_OF_A_TASK", 10)
    assert few == sorted(map(tuple, common.components(edges).collect())) and len(written) > 6
    assert common.components(edges.limit(0)).count() == 0


def test_words_are_hashed_apart():
    a = common.word_hashes("Ab  c\x0bé ab")
    assert len(a) == 4 and a[0] == a[3] and len(set(a.tolist())) == 3
    assert not len(common.word_hashes(None)) and not len(common.word_hashes(" \t\n"))


def test_bucket_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 9)))
        counts = rng.integers(1, 9, len(lengths))
        for k in (1, 2, 3, 12):
            def padding(ends):
                return sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))

            best = min(padding([*own, lengths[-1]]) for r in range(min(k, len(lengths))) for own in itertools.combinations(lengths[:-1], r))
            assert padding(packing.best_boundaries(lengths, counts, k)) == best


def test_batches_respect_the_budget(spark):
    df = spark.createDataFrame([(i % 50, "a " * (i % 37)) for i in range(200)] + [(None, None), (7, "b " * 500)], "doc_id long, text string")
    got = packing.pack(df, buckets=4, budget=100).collect()
    assert len(got) == 202
    for (_, batch), own in itertools.groupby(sorted(got, key=lambda r: (r["bucket"], r["batch"])), key=lambda r: (r["bucket"], r["batch"])):
        own = list(own)
        assert len(own) == 1 or len(own) * own[0]["bucket_end"] <= 100
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and batch >= 0
    assert packing.pack(df.limit(0)).count() == 0


def test_results_replace_carried_columns_of_their_names(spark):
    docs = spark.createDataFrame([(i, "a b " * i, 7, 7, "x") for i in range(5)], "doc_id long, text string, bucket int, Slot int, batch string")
    got = packing.pack(docs, carry=("text", "bucket", "Slot", "batch"))
    assert got.columns == ["doc_id", *packing.RESULTS, "text"] and sorted(r["n_tokens"] for r in got.collect()) == [0, 2, 4, 6, 8]


def test_buckets_stay_exact_with_a_very_long_document(spark):
    lengths = [3, 5, 5, 8, 21, 34, 55, 55, 89, 1_000_001]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = {r["doc_id"]: r["bucket_end"] for r in packing.pack(df, F.col("n"), buckets=4).collect()}
    ends = packing.best_boundaries(*np.unique(lengths, return_counts=True), 4)
    assert got == {i: min(e for e in ends if e >= n) for i, n in enumerate(lengths)} and ends[-1] == 1_000_001


def test_fingerprints_follow_edits(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) + str(rng.randrange(500)) for _ in range(120)) for _ in range(6)]
    rows = [(10, texts[0]), (20, texts[1]), (30, texts[0]), (40, ""), (50, None), (60, "é x"), (60, "é x"), (None, texts[2])]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))).select("*", fingerprint.likeness("sketch", "edited_sketch").alias("e"), fingerprint.likeness("sketch", "next_sketch").alias("n")).collect()}
    assert len(got) == 7 and fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows) and got[10]["sketch"] == got[30]["sketch"] and got[40]["sketch"] == []
    order = [None, 10, 20, 30, 40, 50, 60, 60]
    bodies = dict((k, t or "") for k, t in rows)
    for i, k in enumerate(order):
        t, after = bodies[k], bodies[order[(i + 1) % len(order)]]
        cut = len(t) // 4
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert got[k]["n_chars"] == len(t)
    assert 0.2 < got[10]["e"] < 1 and got[10]["n"] < 0.1 and got[40]["n"] == 1.0
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_equal_plain_order_minhash(spark):
    """The selection, the order in the text and the pairs in plain Python, over the same hashes."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma!", "delta", "o"]) for _ in range(n)) for n in (1, 3, 30, 90, 400)] + ["x", "", "漢字 と kana"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    mers = {r["id"]: r["m"] for r in df.select("id", fingerprint._kmers(F.col("text")).alias("m")).collect()}
    numbered = {i: [(m, own[: p + 1].count(m)) for p, m in enumerate(own)] for i, own in mers.items()}
    asked = sorted({x for own in numbered.values() for x in own})
    hashed = spark.createDataFrame(asked, "mer long, nth int").select("mer", "nth", F.xxhash64("mer", "nth").alias("x")).select("*", F.xxhash64("x").alias("h"))
    known = {(r["mer"], r["nth"]): (r["x"], r["h"] >> 32) for r in hashed.collect()}
    chosen, pairs = {}, set()
    for i, own in numbered.items():
        least = {}
        for pos, x in enumerate(own):
            stratum, value = known[x][0] % 16, (known[x][1], pos)
            least[stratum] = min(least.get(stratum, value), value)
        for k in range(8):
            a, b = least.get(2 * k), least.get(2 * k + 1)
            if a or b:
                first, second = (a, b) if a and b and a[1] < b[1] else (b, a)
                chosen[i, k] = (first and first[0], second and second[0])
                pairs.add(chosen[i, k])
    table = {(r["a"], r["b"]): r["p"] % 65536 for r in spark.createDataFrame(list(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("p")).collect()}
    want = {i: sorted(k * 65536 + table[pair] for (j, k), pair in chosen.items() if j == i) for i in mers}
    got = {r["id"]: r["sketch"] for r in fingerprint.sketch(df, ["id"], "text", sketches=8).collect()}
    assert got == want and got[6] == [] and len(got[4]) == 8


def test_fingerprints_see_order(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[200:] + words[:200]))]
    r = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").select(fingerprint.likeness("sketch", "next_sketch").alias("n")).first()
    assert 0.3 < r["n"] < 0.75


def test_lcs_equals_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 6, 20).astype(np.uint64), rng.integers(0, 6, 35).astype(np.uint64)
        table = np.zeros((21, 36), dtype=int)
        for i, j in itertools.product(range(20), range(35)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.lcs_length(decontam._masks(a), 20, b) == table[-1, -1]


def test_leaks_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (15, 30, 45, 60)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{filler(100)} {item.upper()} {filler(300)}") for i, item in enumerate(items)]
    changed = [w if rng.random() > 0.12 else word() for w in items[2].split()]
    docs += [(10, f"{filler(80)} {' '.join(changed)} {filler(80)}"), (11, filler(500)), (12, None), (13, ""), (14, " ".join(items[3].split()[:20]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (10, 2)]
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.leaks(d.limit(0), b).count() == 0


def test_verbatim_leaks_are_found_whatever_surrounds_them(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    items = [" ".join(word("abcdefghij") for _ in range(n)) for n in (3, 6, 7, 16, 16)]
    foreign = [word("pqrstuvwxyz") for _ in range(4000)]
    filler = lambda n: " ".join(rng.choice(foreign) for _ in range(n))
    known = lambda n: " ".join(rng.choice(" ".join(items).split()) for _ in range(n))
    common = items[3].split()
    docs = [(i, f"{known(60)} {items[i]} {known(60)}") for i in range(3)] + [(3, f"{filler(90)} {items[3]} {filler(90)}"), (4, filler(40) + " " + items[4])]
    docs += [(100 + i, f"{filler(30)} {' '.join(rng.sample(common, 8))}") for i in range(300)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, i) for i in range(5)}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    monkeypatch.setattr(decontam, "OWN_ROWS", 4)
    monkeypatch.setattr(decontam, "SHARED_ROWS", 8)
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    assert decontam.leaks(d.filter("doc_id >= 100").select("doc_id", F.lit(filler(90)).alias("text")), b).count() == 0


def brute_leaks(docs, items, overlap=0.6, sure=0.8, answer=0.6):
    """Every window as wide as the search's regions, every item: longest common subsequence by dynamic programming."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    out = set()
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            want = item.lower().split()
            around = max(0, len(want) - decontam.PASSAGE) + 4
            for start in range(0, max(1, len(words) - decontam.STRIDE), decontam.STRIDE):
                region = words[max(0, start - around) : start + decontam.WINDOW + around]
                share = lcs(want, region) / len(want)
                if share >= overlap and (share >= sure or lcs(want[-8:], region) / len(want[-8:]) >= answer):
                    out.add((d, i))
    return out


def test_candidate_search_recalls_all_windows(spark):
    rng = random.Random(21)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(400)]
    word = lambda: common[min(int(rng.expovariate(0.02)), 399)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 50)))) for i in range(12)]
    docs = []
    for d in range(40):
        text = [word() for _ in range(rng.randrange(20, 200))]
        if d % 2:
            keep, copy = rng.choice([0.7, 0.8, 0.9]), rng.choice(items)[1].split()
            at = rng.randrange(len(text))
            text[at:at] = [w if rng.random() < keep else word() for w in copy]
        docs.append((d, " ".join(text)))
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 10 and len(got & want) >= 0.9 * len(want)


def test_only_windows_with_rare_words_are_projected(spark, monkeypatch):
    rng = random.Random(5)
    often, seldom = [f"often{i}" for i in range(30)], [f"seldom{i}" for i in range(300)]
    text = lambda n, share: [rng.choice(seldom if rng.random() < share else often) for _ in range(n)]
    items = [text(n, 0.9) for n in (1, 3, 15, 30, 45, 60)]
    docs = [text(400, 0.01) for _ in range(40)] + [text(n, 0.05) for n in (1, 15, 16, 17, 32, 33)]
    for i, doc in enumerate(docs[:24]):
        at = rng.randrange(len(doc))
        doc[at:at] = [w for w in items[i % 6] if rng.random() < 0.8]
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{key} long, text string")
    space = decontam.fit(table(items, "item_id"), table(docs, "doc_id"))
    rows = [{"item": i, "text": " ".join(r), "answer": None} for i, r in enumerate(items)]
    known, projected, kept = decontam._prepare(rows, space, 8, 0.6), [], decontam.LatentSpace.windows
    monkeypatch.setattr(decontam.LatentSpace, "windows", lambda self, at, chosen: projected.append(len(chosen)) or kept(self, at, chosen))
    for doc in docs:
        words = common.word_hashes(" ".join(doc))
        at, count = space.columns(words), max(1, -(-len(words) // decontam.STRIDE) - 1)
        near = set(zip(*(x.tolist() for x in decontam._near(at, known, 0, count)), strict=True))
        for w, item in itertools.product(range(count), range(len(items))):
            around = max(0, len(items[item]) - decontam.PASSAGE) + 4
            region = words[max(0, w * decontam.STRIDE - around) : w * decontam.STRIDE + decontam.WINDOW + around]
            if decontam.lcs_length(known.masks[item], known.lengths[item], region) >= 0.6 * known.lengths[item]:
                assert (w, item) in near
        found = decontam._leaks(words, space, known, 0.5, 0.6, 0.8, 0.6)
        with monkeypatch.context() as m:
            m.setattr(decontam, "HITS", 1)
            again = decontam._leaks(words, space, known, 0.5, 0.6, 0.8, 0.6)
        assert found.keys() == again.keys() and all(found[i] == pytest.approx(again[i], abs=1e-6) for i in found)
    assert projected
    projected.clear()
    assert not decontam._leaks(common.word_hashes(" ".join(text(4000, 0))), space, decontam._prepare(rows[2:], space, 8, 0.6), 0.5, 0.6, 0.8, 0.6)
    assert not projected


def test_leaks_of_repeated_rows_and_clashing_columns(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, "b " * 300_000 + item), (3, None)], "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("cosine", F.lit("y"))
    bench = spark.createDataFrame([(7, item), (8, item), (9, "")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect())
    assert got == [(1, 7), (1, 7), (1, 8), (1, 8), (2, 7), (2, 8)]
