"""Token-id files, the prefix trie and phrases against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import phrases, prefix_trie, queries, token_files
from loomspark.llm.common import Scratch
from loomspark.llm.running import running

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "á ́b", "J̌ J̌. j", "x y z　q", "İstanbul ΣΑΣ ς\nΣ", "\x1c\x1d a\tb\r\nc'll 'll ' s.", "<|ENDOFTEXT|> a<|endoftext|>b",
       "don't Can't. 1234 ½ ² ...", "heer.. heer., Heer!", "가 가", "w" * 3000, " \n ", "café. CAFÉ. café."]


@pytest.mark.parametrize("n, most", [(1, 5), (10, 0), (1000, 10**6), (5000, 200), (3000, 2**45)])
def test_elias_fano_gives_what_it_was_given(n, most):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, most + 1, n))
    params, data = token_files.EliasFano.encode(values)
    read = lambda at, size: data[at : at + size]
    for i, j in [(0, n), (n - 1, n), (n, n), *((min(p), max(p)) for p in rng.integers(0, n + 1, (40, 2)).tolist())]:
        assert (token_files.EliasFano.values(params, read, i, j) == values[i:j]).all()
    assert len(data) * 8 <= n * (3 + max(0, (most // n).bit_length())) + n // 4 + 128


def test_words_apart_have_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for t in ODD] + [" ".join(p) for p in itertools.permutations(["İ", "é.", "A,", "'S", "\ń"], 3)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    own = token_files.Encoder(TOKENIZER, "<u2")
    assert own.apart and list(own.encode(pa.array(texts))) == want and list(own.encode(pa.array(texts))) == want and list(own.encode(pa.array([], type=pa.string()))) == []
    assert not token_files.Encoder.fits(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_OF_A_FILE", 200)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["one", "Two.", "drei", "quatre,"]) for _ in range(rng.randrange(60)))) for k in rng.sample(range(-50, 10**12), 60)]
    rows += [(7, t) for t in ODD] + [(None, "null key"), (None, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, key string")
    for path in (TOKENIZER, public_tokenizers.path("byte_bpe_50k.json")):
        folder = f"file://{tmp_path}/{len(path)}"
        files = token_files.write(df, folder, path, end_id=2)
        got = token_files.read(files, docs_of_a_read=7).collect()
        whole = Tokenizer.from_file(path)
        want = Counter((k, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in rows)
        assert Counter((r["key"], tuple(r["ids"])) for r in got) == want
        order = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in order] == list(itertools.accumulate((len(r["ids"]) for r in order), initial=0))[:-1]
        keys = [r["key"] for r in order]
        assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
        sums = {r["start"]: r["ids_crc32"] for r in token_files.digests(files, docs_of_a_read=5).collect()}
        assert sums == {r["start"]: zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got}
        assert files.count() > 4


def test_token_files_of_nothing(spark, tmp_path):
    files = token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", TOKENIZER)
    assert files.count() == 0 and token_files.read(files).count() == 0


@pytest.mark.parametrize("group", [None, "g"])
def test_running_sums(spark, group):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 2, 2, 2, 9]), i, rng.randrange(5)) for i in range(400)]
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
        got = running(df, ["g", "i"], {"total": F.col("v"), "n": F.lit(1)}, scratch, group=group).orderBy("g", "i").collect()
        total, n, last = 0, 0, None
        for r in got:
            if group and r["g"] != last:
                total, n, last = 0, 0, r["g"]
            total, n = total + r["v"], n + 1
            assert (r["total"], r["n"]) == (total, n)
        assert len(got) == 400 and running(df.limit(0), ["g", "i"], {"total": F.col("v")}, scratch, group=group).count() == 0


def plain_trie(sequences):
    """Nodes by walking all prefixes."""
    members, chars = defaultdict(list), {}
    for c, seq in sorted(sequences.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = {}
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in members if q}
        ends = ",".join(str(c) for c in cs if len(sequences[c]) == len(p))
        out[cs[0], len(p)] = (members[p[:-1]][0] if p else None, len(cs), sum(q[:-1] == p and len(q) == len(p) + 1 for q in under), sum(q not in inner for q in under),
                              sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under), hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_trie_equals_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 32)
    rng = random.Random(block)
    rows, own = [], defaultdict(list)
    for c in [0, 100, 300, *rng.sample(range(1, 450), 40)]:
        for turn in range(rng.randrange(1, 9)):
            role, text = rng.choice(["user", None]), rng.choice(["a", "b", "", None, "éé", "x" * 500])
            own[c].append((role or "", text or ""))
            rows.append((c, turn if turn else None, role, text, "clash"))
    rows.append((None, 1, "user", "nobody's", "clash"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, symbol string")
    rebuilt = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + seq[h:]
    with Scratch(spark) as scratch:
        turns = prefix_trie.turns(df, scratch)
        got = prefix_trie.trie(prefix_trie.branched(turns), turns.select("conv_id").distinct(), scratch).collect()
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {(r["conv_id"], r["depth"]): tuple(r[n] for n in names) for r in got} == plain_trie(rebuilt) and any(not s for s in rebuilt.values())


def test_trie_of_nothing_and_of_repeated_turns(spark):
    with Scratch(spark) as scratch:
        none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
        turns = prefix_trie.turns(none, scratch)
        assert prefix_trie.trie(prefix_trie.branched(turns), turns.select("conv_id").distinct(), scratch).count() == 0
        same = spark.createDataFrame([(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a")], "conv_id long, turn long, role string, text string")
        first = [r["symbol"] for r in prefix_trie.turns(same, scratch).orderBy("n").collect()]
        assert first == sorted(first) and len(set(first)) == 2


def plain_phrases(rows, least, most, k):
    pieces = [(lang or "und", re.findall(r"[^\x20\x09]+", p)) for text, lang in rows for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    n, f = Counter(), Counter()
    for lang, w in pieces:
        n[lang] += len(w)
        f.update((lang, tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if any(lang == lg and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), c in often.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:i]] * f[lang, p[i:]]), i) for i in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang]))
    return {(lang, i + 1, p.decode(), -a, lf, r, total, -s) for lang, found in out.items() for i, (s, a, p, lf, r, total) in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("shard, group, least, small", [(1 << 21, 1 << 17, 3, 1 << 21), (50, 16, 3, 0), (300, 1 << 17, 8, 1 << 21)])
def test_phrases_equal_plain_counts(spark, monkeypatch, shard, group, least, small):
    monkeypatch.setattr(phrases, "SMALL", small)
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "GROUP", group)
    rng = random.Random(shard)
    words = ["a", "b", "The", "the", "Été", "x\x1cy", "z z", "la"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\r"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "fr", None])) for _ in range(40)] + [("", "en"), (None, None), (" . ", "de"), ("la la la la la la la la la", "fr"), ("a b " * 400, "en"), ("a b " * 400, "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int")
    got = phrases.collocations(df, least=least, most=5, k=25).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows, least, 5, 25) and len(got) > 10


def test_triples_too_rare_in_all_shards_are_never_listed():
    rng, names = np.random.default_rng(4), np.arange(10, 50, dtype=np.int32)
    places = [np.where(rng.random(4000) < 0.1, 0, np.minimum(rng.geometric(0.25, 4000), 40)) for _ in range(3)]
    shards = [phrases.Shard(names, *phrases.bitmaps(p, 40)[1:]) for p in places]
    pairs, size, least = (np.repeat(names, 40), np.tile(names, 40)), 1 << 20, 20
    total, plain = np.zeros(size, dtype=np.int64), Counter()
    for shard, p in zip(shards, places, strict=True):
        for at, n in shard.triples(pairs, size):
            total[at] += n
        plain.update(tuple(names[p[i : i + 3] - 1].tolist()) for i in range(len(p) - 2) if p[i : i + 3].all())
    listed = Counter()
    for shard in shards:
        for found, n in shard.longer(pairs, np.packbits(total >= least, bitorder="little"), (3, 3)):
            listed.update(dict(zip(map(tuple, found.tolist()), n.tolist(), strict=True)))
    often = {t: n for t, n in plain.items() if n >= least}
    assert total.sum() == sum(plain.values()) and {t: listed[t] for t in often} == often
    assert 10 < len(often) <= len(listed) < 1.1 * len(often) + 5 < len(plain)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("one word", "en")], "text string, lang string")).count() == 0


def test_queries_of_sequences_are_registered():
    assert {"op11_token_files", "op12_prefix_trie", "op13_phrases"} <= set(queries.QUERIES)
