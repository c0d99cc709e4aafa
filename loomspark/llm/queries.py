"""The registered queries of the training-data operators, with the parameters used in production."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, fingerprint, html_extract, langid, license_scan, ngram_join, packing, phrases, pii, prefix_trie, token_files, toxicity, warc
from loomspark.llm.common import Scratch, cut, delete, fold_of, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labelled rows whose crc32 fold of three is not 1."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(fold_of("doc_id", 3) != 1), read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_extract.extract(pages, costs=html_extract.fit(pages)).drop("html")
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaks into it."""
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document: eight buckets, 16,384 tokens a batch."""
    return packing.pack(read(spark, sf_dir, "documents"), buckets=8, budget=16384)


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source / thousands / dozens, with a licence file first in each sixth directory."""
    number = F.col("doc_id")
    name = F.when(number % 96 == 0, F.lit("LICENSE")).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    folder = F.when(number % 96 == 0, F.concat_ws("/", "source", (number / 960).cast("long"))).otherwise(F.concat_ws("/", "source", (number / 960).cast("long"), (number / 16).cast("long")))
    return docs.withColumn("path", F.concat_ws("/", folder, name))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, placed in a tree of directories, its own or inherited."""
    return license_scan.scan(document_paths(read(spark, sf_dir, "documents")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprint of every document and of its edited text, and their likeness."""
    marks = fingerprint.fingerprints(read(spark, sf_dir, "documents"))
    return marks.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.written("sketch").alias("fingerprint"), fingerprint.written("edited_sketch").alias("edited_fingerprint"),
        fingerprint.likeness("sketch", "edited_sketch").alias("near_edited"), fingerprint.likeness("sketch", "next_sketch").alias("near_next"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to WARC archives in the shared folder and reads them back."""
    files = warc.write(read(spark, sf_dir, "pages"), warc.scratch(spark))
    records = warc.read(spark, files).filter(F.col("type").isin("response", "revisit"))
    page = lambda c: F.when(F.col(c) != "<urn:x-page:null>", F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1)).cast("long")
    response = F.col("type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-format spans and discovered identifiers of every document."""
    found = pii.find(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == pii.KINDS.index("secret"))).cast("long").alias("n_secret"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by Jaccard 0.85 over 4-word shingles."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), k=4, threshold="0.85")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows whose crc32 fold of five is not 0.

    lang_pred and score are the nearest centroid's; accepted is the operator's own rejection by distance.
    """
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold_of("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of every document to files in the shared folder and reads them back."""
    import public_tokenizers

    folder = token_files.scratch(spark)
    try:
        files = token_files.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
        return cut(token_files.digests(files).withColumnRenamed("key", "doc_id"))
    finally:
        delete(spark, folder)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each opened by the first turns of the first of its hundred."""
    with Scratch(spark) as scratch:
        own = prefix_trie.turns(read(spark, sf_dir, "conversations"), scratch)
        return prefix_trie.trie(prefix_trie.branched(own), own.select("conv_id").distinct(), scratch)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two to five words of each language, by how much they occur together."""
    return phrases.collocations(read(spark, sf_dir, "documents").select("text", "lang"), least=100, most=5, k=2000)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_personal_data": op8_personal_data,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_language_id": op10_language_id,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}

_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]"


def _packing_sql(buckets: int = 8, budget: int = 16384) -> str:
    """Dynamic programming over the length histogram, one step for each further bucket, then numbering inside buckets."""
    parts = [
        f"docs AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_TOKENS}')) AS BIGINT) AS n FROM documents)",
        "hist AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n) AS j FROM docs GROUP BY n)",
        "pre AS (SELECT 0 AS j, 0 AS n, 0::HUGEINT AS r, 0::HUGEINT AS m UNION ALL SELECT j, n, sum(c) OVER (ORDER BY j), sum(n * c) OVER (ORDER BY j) FROM hist)",
        "b1 AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE n * r - m END AS cost, 0 AS i FROM pre)",
    ]
    for step in range(2, buckets + 1):
        parts.append(
            f"t{step} AS (SELECT q.j, b.j AS i, b.cost + q.n * (q.r - p.r) - (q.m - p.m) AS cost FROM pre q JOIN b{step - 1} b ON b.j < q.j JOIN pre p ON p.j = b.j), "
            f"b{step} AS (SELECT j, cost, i FROM t{step} QUALIFY row_number() OVER (PARTITION BY j ORDER BY cost, i) = 1 UNION ALL SELECT 0, 0, 0)"
        )
    parts.append(f"e{buckets} AS (SELECT max(j) AS j FROM hist)")
    for step in range(buckets, 1, -1):
        parts.append(f"e{step - 1} AS (SELECT b.i AS j FROM e{step} e JOIN b{step} b ON b.j = e.j)")
    ends = " UNION ".join(f"SELECT j FROM e{step}" for step in range(1, buckets + 1))
    parts.append(f"ends AS (SELECT h.n AS bucket_end, CAST(row_number() OVER (ORDER BY h.n) - 1 AS INTEGER) AS bucket FROM ({ends}) JOIN hist h USING (j) WHERE j > 0)")
    parts.append("placed AS (SELECT d.doc_id, d.n, (SELECT min(bucket) FROM ends e WHERE e.bucket_end >= d.n) AS bucket FROM docs d)")
    parts.append("numbered AS (SELECT p.*, e.bucket_end, row_number() OVER (PARTITION BY p.bucket ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3), doc_id NULLS FIRST, n) - 1 AS place FROM placed p JOIN ends e USING (bucket))")
    room = f"greatest(1, {budget} // greatest(bucket_end, 1))"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n AS n_tokens, bucket, bucket_end, CAST(place // {room} AS BIGINT) AS batch, CAST(place % {room} AS BIGINT) AS slot FROM numbered"


_WARC_SQL = """
WITH d AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM f
"""


def _jaccard_sql(k: int = 4, percent: int = 85) -> str:
    """Shingle sets, the pairs that share a shingle and reach the threshold, and components by recursion."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {k - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
h AS (SELECT doc_id, s FROM sh JOIN common USING (s)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM h x JOIN h y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= {percent} * (na.n + nb.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, seen) AS (SELECT DISTINCT a, a FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS least FROM reach GROUP BY node) c USING (doc_id)
"""


def _licence_sql(cosine: float = 0.8) -> str:
    """Every line of every document against every template, then the nearest licensed directory above."""
    counted = [re.findall(license_scan.WORD, body.lower()) for _, body in license_scan.TEMPLATES]
    values = ", ".join(f"({i}, '{license_scan.TEMPLATES[i][0]}', '{w}', {own.count(w)})" for i, own in enumerate(counted) for w in sorted(set(own)))
    return f"""
WITH f AS (SELECT doc_id, text, doc_id % 96 = 0 AS given, CASE WHEN doc_id % 96 = 0 THEN source || '/' || (doc_id // 960) ELSE source || '/' || (doc_id // 960) || '/' || (doc_id // 16) END AS dir FROM documents),
t(i, name, w, tf) AS (VALUES {values}),
seen AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM f) WHERE w IN (SELECT w FROM t) GROUP BY w),
idf AS (SELECT w, ln(((SELECT count(*) FROM f) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM t) LEFT JOIN seen USING (w)),
v AS (SELECT i, name, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY i)) AS x FROM t JOIN idf USING (w)),
l AS (SELECT doc_id, text, given, string_split(text, chr(10)) AS ls FROM f),
u AS (SELECT doc_id, i * 16 + n AS line, array_to_string(ls[i + 1:i + n], ' ') AS unit FROM l, (VALUES (1), (2), (4), (8)) r(n), LATERAL (SELECT unnest(range(0, len(ls) - n + 1)) AS i) UNION ALL SELECT doc_id, len(ls) * 16, text FROM l WHERE given),
k AS (SELECT doc_id, line, w, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS w FROM u) GROUP BY ALL),
x AS (SELECT doc_id, line, w, tf * coalesce(idf, (SELECT max(idf) FROM idf)) AS x FROM k LEFT JOIN idf USING (w)),
n AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
sc AS (SELECT doc_id, line, i, name, round(sum(x.x * v.x) / any_value(norm), 9) AS score FROM x JOIN v USING (w) JOIN n USING (doc_id, line) GROUP BY ALL),
own AS (SELECT doc_id, name, score, line FROM sc WHERE score >= {cosine} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, line) = 1),
lic AS (SELECT dir, arg_max(name, (score, name)) AS licence FROM own JOIN f USING (doc_id) WHERE given GROUP BY dir),
up AS (SELECT doc_id, lic.dir AS from_dir, licence, len(string_split(f.dir, '/')) - len(string_split(lic.dir, '/')) AS up FROM f JOIN lic ON f.dir = lic.dir OR starts_with(f.dir, lic.dir || '/') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(lic.dir) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || CASE WHEN given THEN 'LICENSE' ELSE f.doc_id || '.txt' END AS path, own.name AS own, own.score, CAST(own.line // 16 AS BIGINT) AS line, CAST(own.line % 16 AS BIGINT) AS lines, coalesce(own.name, up.licence) AS licence,
       CASE WHEN own.name IS NULL THEN up.from_dir END AS from_dir, CASE WHEN own.name IS NULL THEN CAST(up.up AS BIGINT) END AS up
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN up USING (doc_id)
"""


#: crc32 of a text of ASCII letters and digits, bit by bit.
_CRC32 = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"

_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(r) || ':' || r || x), 1, 32)) AS n FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
i AS (SELECT c, c - c % 100 AS b, {_CRC32.format('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT i.c, h, coalesce(least(h, (SELECT max(n) FROM t WHERE t.c = i.b)), 0) AS m FROM i),
s AS (SELECT i.c, t.n AS d, r, x FROM i JOIN t ON t.c = i.b AND t.n <= i.h UNION ALL SELECT t.c, t.n - o.h + o.m, r, x FROM t JOIN o ON t.c = o.c AND t.n > o.h),
k AS (SELECT c, d, x, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS key FROM s),
u AS (SELECT c, d, x, CAST(key AS VARCHAR) AS key, CASE WHEN d > 1 THEN CAST(key[1:d - 1] AS VARCHAR) ELSE '' END AS up FROM k UNION ALL SELECT c, 0, '', '', NULL FROM i),
z AS (SELECT c, arg_max(key, d) AS last FROM u GROUP BY c),
v AS (SELECT key, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, any_value(length(x)) AS chars FROM u GROUP BY key, d),
e AS (SELECT last AS key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM z GROUP BY last),
ch AS (SELECT up AS key, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch USING (key)),
below AS (SELECT DISTINCT a.key AS top, b.key FROM u a JOIN u b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM below JOIN w USING (key) GROUP BY top)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM w JOIN sub USING (key) LEFT JOIN v p ON p.key = w.up LEFT JOIN e ON e.key = w.key
"""

def _phrases_sql(least: int = 100, most: int = 5, k: int = 2000) -> str:
    """All n-grams counted, all cuts, and what stands inside any longer phrase as often."""
    cuts = " UNION ALL ".join(f"SELECT lang, g, f AS a, {i} AS k, g[1:{i}] AS x, g[{i} + 1:] AS y FROM c WHERE len(g) > {i}" for i in range(1, most))
    inner = " UNION ".join(f"SELECT lang, g[{i}:{i + m - 1}] AS g, f FROM c WHERE len(g) >= {i + m - 1} AND len(g) > {m}" for m in range(2, most) for i in range(1, most - m + 2))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM p, range(1, {most + 1}) r(m)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= {least}),
c AS (SELECT * FROM f WHERE len(g) > 1),
ins AS ({inner}),
al AS (SELECT * FROM c ANTI JOIN ins USING (lang, g, f)),
cuts AS ({cuts}),
s AS (SELECT cuts.*, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts JOIN al USING (lang, g) JOIN f x ON x.lang = cuts.lang AND x.g = cuts.x JOIN f y ON y.lang = cuts.lang AND y.g = cuts.y JOIN n ON n.lang = cuts.lang),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {k}
"""


ORACLE_SQL: dict[str, str] = {"op4_packing": _packing_sql(), "op5_license_scan": _licence_sql(), "op7_warc": _WARC_SQL, "op9_ngram_jaccard": _jaccard_sql(), "op12_prefix_trie": _TRIE_SQL, "op13_phrases": _phrases_sql()}
