"""Registered corpus queries: text functions, retrieval, graph, evaluation, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import scalars, text
from loomspark.operators import analytics, chunking, entities, evaluation, retrieval, trigram, vectors
from loomspark.plans import modes
from loomspark.sources import pages, shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables, spark) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _title(c: str = "text"):
    """The first line of a text stands for its title."""
    return F.substring_index(c, "\n", 1)


_TITLE = "split_part(text, chr(10), 1)"


#: SQL macros as text: trigrams of a string, and similarity of two lists.
def _tri(c: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def _big(c: str) -> str:
    v = f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    return f"list_distinct(list_transform(range(1, greatest(length({v}), 1)), lambda i: substring({v}, i, 2)))"


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\s\\p{L}\\p{N}\\p{M}_]')) AS INT) AS tokens FROM documents")
def token_count(t, spark: SparkSession) -> DataFrame:
    return t("documents").select("doc_id", text.token_count("text").alias("tokens"))


@query("""SELECT doc_id, sha256(unhex(lpad(hex(CAST(octet_length(encode(source)) AS BIGINT)), 16, '0')) || encode(source) || unhex(lpad(hex(CAST(octet_length(encode(text)) AS BIGINT)), 16, '0')) || encode(text)) AS digest FROM documents""")
def content_hash(t, spark: SparkSession) -> DataFrame:
    return t("documents").select("doc_id", text.content_hash("source", "text").alias("digest"))


@query("SELECT n_nationkey, sha256(n_name || chr(0) || 'part_of' || chr(0) || r_name) AS relation_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def relation_ids(t, spark: SparkSession) -> DataFrame:
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.relation_id("n_name", F.lit("part_of"), "r_name").alias("relation_id"))


@query("SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[a-zA-Z0-9가-힣]+'), lambda w: length(w) <= 100)[1:10], ' ') AS words FROM benchmark")
def keywords_extract(t, spark: SparkSession) -> DataFrame:
    return t("benchmark").select("item_id", F.array_join(text.keywords("text"), " ").alias("words"))


#: The signs of \w, \d, and of \s but line ends, as masks see them, spelled out for SQL.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\x{200C}\x{200D}"
_D, _S = r"\p{Nd}", r"\t\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def _between(t: str, inside: str, body: str, after: str, label: str) -> str:
    """SQL that masks body where no sign of inside stands before and none of after behind it; body takes a sign outside of inside as _twice(sign).

    SQL has no look-around: such signs are written twice, so that one copy can end a match and the other begin the next.
    """
    doubled = f"regexp_replace({t}, '([^{inside}])', '\\1' || chr(0) || '\\1', 'g')"
    return f"regexp_replace(regexp_replace({doubled}, '(^|\\x00[^{inside}]){body}($|[^{after}])', '\\1{label}\\2', 'g'), '(?s)\\x00.', '', 'g')"


def _twice(sign: str) -> str:
    return rf"(?:{sign}\x00{sign})"


_GAP = rf"(?:{_twice('-')}|{_twice(' ')}|{_twice('[.]')})?"


@query(f"""WITH e AS (SELECT doc_id, replace(text, chr(0), '') AS t FROM documents),
 m1 AS (SELECT doc_id, {_between('t', _W + '.-', rf"(?:[{_W}.-]|{_twice('[+]')})+{_twice('@')}[{_W}.-]+[.][A-Za-z]{{2,}}", _W + '.-', '[이메일 삭제]')} AS t FROM e),
 m2 AS (SELECT doc_id, {_between('t', _D, rf"(?:{_twice('[+]')}?82{_GAP})?0?1[016789]{_GAP}{_D}{{3,4}}{_GAP}{_D}{{4}}", _D, '[전화번호 삭제]')} AS t FROM m1),
 m3 AS (SELECT doc_id, regexp_replace(t, '<@!?{_D}{{15,22}}>|<@&{_D}{{15,22}}>', '[Discord 식별자 삭제]', 'g') AS t FROM m2),
 m4 AS (SELECT doc_id, {_between('t', _W, rf"(?:[{_W}]|{_twice('[.]')}){{2,32}}{_twice('#')}{_D}{{4}}", _D, '[Discord 식별자 삭제]')} AS t FROM m3),
 l AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '[{_S}]*\\n[{_S}]*', chr(10), 'g') AS t FROM m4)
 SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\n{_S}]+|[\\n{_S}]+$', '', 'g') AS masked FROM l""")
def pii_mask(t, spark: SparkSession) -> DataFrame:
    return t("documents").select("doc_id", text.masked("text").alias("masked"))


@query("SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(substring(f, 1, 79)) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def truncate_excerpt(t, spark: SparkSession) -> DataFrame:
    return t("documents").select("doc_id", text.truncated("text", 80).alias("excerpt"))


_HOSTS = ("blog.tionsh.example.net", "www.ththhe.example.com", "blog.tionsh.example.com", "tionble.example.org")


@query(f"""SELECT page_id, coalesce(regexp_extract(url, '^([a-z]+)://', 1) = 'https' AND regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) IN {_HOSTS} AND regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) LIKE '/en/%', false) AS allowed FROM pages""")
def url_policy(t, spark: SparkSession) -> DataFrame:
    return t("pages").select("page_id", text.allowed_url("url", _HOSTS, "^/en/").alias("allowed"))


@query("SELECT doc_id, '제목: ' || split_part(text, chr(10), 1) || chr(10) || '게시판: ' || source || chr(10) || '분류: ' || coalesce(lang, '분류 없음') || chr(10) || '작성일: 날짜 미상' AS header FROM documents")
def chunk_header(t, spark: SparkSession) -> DataFrame:
    return t("documents").select("doc_id", chunking.header(_title(), "source", "lang", F.lit(None).cast("timestamp")).alias("header"))


@query(f"""WITH q AS (SELECT item_id, {_tri('text')} AS g FROM benchmark), d AS (SELECT doc_id, {_tri('text')} AS g FROM documents),
  s AS (SELECT item_id, doc_id, {_sim('q.g', 'd.g')} AS score FROM q, d) SELECT item_id, doc_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def trigram_topk(t, spark: SparkSession) -> DataFrame:
    q = t("benchmark").select("item_id", F.col("text").alias("query"))
    return trigram.similar(q, t("documents"), 5, "item_id", "doc_id").withColumn("score", F.round("score", 9))


@query(f"""SELECT b.item_id, c.item_id AS other, round(CASE WHEN len(b.g) = 0 THEN 0.0 ELSE len(list_intersect(b.g, c.g)) / len(b.g) END, 9) AS coverage FROM (SELECT item_id, {_big('text')} AS g FROM benchmark WHERE item_id % 20 = 0) b, (SELECT item_id, {_big(_TITLE)} AS g FROM benchmark) c WHERE b.item_id <> c.item_id""")
def bigram_title_coverage(t, spark: SparkSession) -> DataFrame:
    """Every item whose id 20 divides against the titles of all others."""
    b = t("benchmark")
    asked = retrieval.small(b.filter("item_id % 20 = 0").select("item_id", "text"))
    j = b.select(F.col("item_id").alias("other"), _title().alias("title")).join(asked, F.col("item_id") != F.col("other"))
    return j.select("item_id", "other", F.round(text.coverage("text", "title"), 9).alias("coverage"))


def _asked(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _corpus(t) -> DataFrame:
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t("documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "text", _title().alias("title"), F.concat(F.lit("article:"), F.col("doc_id").cast("string")).alias("source_key"),
        F.col("source").alias("group_key"), "n_chars", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("lang").alias("lang"),
    )


_LEXICAL = f"""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
 w AS (SELECT DISTINCT query_id, lower(unnest(list_filter(regexp_extract_all(query, '[a-zA-Z0-9가-힣]+'), lambda w: length(w) <= 100)[1:10])) AS word FROM q),
 p AS (SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents),
 words AS (SELECT DISTINCT word FROM w), hit AS (SELECT word, chunk_id FROM p JOIN words ON token LIKE word || '%'),
 m AS (SELECT DISTINCT query_id, chunk_id FROM w JOIN hit USING (word)),
 f AS (SELECT query_id, chunk_id FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 600),
 qg AS (SELECT query_id, {_tri('query')} AS qg FROM q), cg AS (SELECT doc_id AS chunk_id, {_tri('text')} AS cg FROM documents),
 s AS (SELECT query_id, chunk_id, {_sim('qg', 'cg')} AS score FROM f JOIN qg USING (query_id) JOIN cg USING (chunk_id)),
 lexical AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) """


@query(_LEXICAL + "SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM lexical WHERE rank <= 50")
def lexical_two_stage(t, spark: SparkSession) -> DataFrame:
    return retrieval.lexical(_asked(t), _corpus(t).select("chunk_id", "text"), k=50).withColumn("score", F.round("score", 9))


@query(_LEXICAL + "SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM lexical WHERE rank <= 50")
def lexical_at_rest(t, spark: SparkSession) -> DataFrame:
    """The same from an index that is written first and read by its partitions."""
    folder, corpus = shared.new(spark, "index"), _corpus(t).select("chunk_id", "text")
    try:
        retrieval.write_index(corpus, folder)
        return retrieval.lexical(_asked(t), corpus, folder, k=50).withColumn("score", F.round("score", 9))
    finally:
        shared.delete(spark, folder)


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


_NEAREST = f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS chunk_id, embedding AS e FROM embeddings),
 s AS (SELECT query_id, chunk_id, {_DOT.format(a='q.e', b='c.e')} / (sqrt({_DOT.format(a='q.e', b='q.e')}) * sqrt({_DOT.format(a='c.e', b='c.e')})) AS sim FROM q, c)
 SELECT query_id, chunk_id, round(greatest(0.0, sim), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s) WHERE rank <= 20"""


def _vectors(t) -> tuple[DataFrame, DataFrame]:
    """Every row whose id 20 divides as query, and all rows."""
    e = t("embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query(_NEAREST)
def knn_exact(t, spark: SparkSession) -> DataFrame:
    return vectors.knn(*_vectors(t), 20).withColumn("score", F.round("score", 6))


@query(_NEAREST)
def knn_cells_exact(t, spark: SparkSession) -> DataFrame:
    """The same from an inverted file: near cells first, then those that may hold a better neighbour."""
    asked, corpus = _vectors(t)
    folder = shared.new(spark, "cells")
    try:
        vectors.build(corpus, folder)
        return vectors.search(asked, folder, 20, exact=True).withColumn("score", F.round("score", 6))
    finally:
        shared.delete(spark, folder)


@query()
def knn_ivf_recall(t, spark: SparkSession) -> DataFrame:
    """(query_id, wanted, hits): how many of the 20 nearest three of four cells give; these vectors lie evenly in all directions, which is as hard as it gets."""
    asked, corpus = _vectors(t)
    folder = shared.new(spark, "cells")
    try:
        vectors.build(corpus, folder)
        found = vectors.search(asked, folder, 20, probes=max(8, spark.read.parquet(f"{folder}/cells").count() * 3 // 4))
        return vectors.recall(found, vectors.knn(asked, corpus, 20))
    finally:
        shared.delete(spark, folder)


@query("SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 0.001 AS valid FROM embeddings")
def embedding_contract(t, spark: SparkSession) -> DataFrame:
    return t("embeddings").select("vec_id", scalars.valid_embedding("embedding", 64).alias("valid"))


def _dense_leg(t, k: int = 1000) -> DataFrame:
    """The k nearest documents with an embedding; a query has the embedding of its number."""
    e = t("embeddings")
    asked = e.join(_asked(t).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    held = e.join(t("documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.knn(asked, held, k).select("query_id", "chunk_id", "rank")


def _lexical_leg(t) -> DataFrame:
    return retrieval.lexical(_asked(t), t("documents").select(F.col("doc_id").alias("chunk_id"), "text")).select("query_id", "chunk_id", "rank")


_LEGS = _LEXICAL + f""", lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
 near AS (SELECT a.vec_id AS query_id, c.vec_id AS chunk_id, {_DOT.format(a='a.embedding', b='c.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='c.embedding', b='c.embedding')})) AS sim
   FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM q)) a, (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) c),
 dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM near),
 rrf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT query_id, chunk_id, rank FROM lexical WHERE rank <= 200 UNION ALL SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 1000) GROUP BY ALL) """


@query(_LEGS + "SELECT query_id, chunk_id, round(rrf, 9) AS rrf FROM rrf")
def rrf_fusion(t, spark: SparkSession) -> DataFrame:
    return retrieval.fuse([_dense_leg(t), _lexical_leg(t)]).withColumn("rrf", F.round("rrf", 9))


_BOOST = "least(0.012, least(0.004, ln(1 + n_chars) / 1000) + least(0.0025, ln(1 + n_chars * 10) / 4000) + CASE WHEN quality = 1 THEN 0.0025 ELSE 0.0 END + 0.003 * exp(-(chunk_id % 700) / 365.0)) + CASE WHEN lang = 'en' THEN 0.02 ELSE 0.0 END"


def _boost():
    return scalars.quality_boost("n_chars", F.col("n_chars") * 10, F.col("quality") == 1, F.lit(False), F.col("chunk_id") % 700, F.col("lang") == "en")


@query(f"SELECT doc_id AS chunk_id, round({_BOOST}, 9) AS boost FROM (SELECT doc_id, doc_id AS chunk_id, n_chars, lang, coalesce(quality, 0) AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))")
def quality_boost(t, spark: SparkSession) -> DataFrame:
    return _corpus(t).select("chunk_id", F.round(_boost(), 9).alias("boost"))


@query("""SELECT doc_id, round(least(0.06, list_sum(list_transform(['the', 'and', 'que', 'der'], lambda w: CASE WHEN contains(ti, w) OR (doc_id % 2 = 0 AND contains(tx, w)) THEN 0.04 WHEN contains(tx, w) THEN 0.006 ELSE 0.0 END))), 9) AS boost
  FROM (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g')) AS ti, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS tx FROM documents)""")
def anchor_boost(t, spark: SparkSession) -> DataFrame:
    key = F.when(F.col("doc_id") % 2 == 0, "article:1").otherwise("comment:1")
    terms = F.array(*[F.lit(w) for w in ("the", "and", "que", "der")])
    b = scalars.anchor_boost(terms, text.normalized(_title()), text.normalized("text"), key)
    return t("documents").select("doc_id", F.round(b, 9).alias("boost"))


@query(_LEGS + f""", c AS (SELECT doc_id AS chunk_id, text, source AS group_key, n_chars, lang, coalesce(quality, 0) AS quality FROM documents LEFT JOIN lab USING (doc_id)),
 fused AS (SELECT query_id, chunk_id, group_key, rrf + {_BOOST} AS score FROM rrf JOIN c USING (chunk_id)),
 g AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, group_key ORDER BY score DESC, chunk_id) <= 3),
 k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30),
 tb AS (SELECT query_id, {_big('query')} AS b FROM q), cb AS (SELECT doc_id AS chunk_id, {_big(_TITLE)} AS b FROM documents),
 r AS (SELECT query_id, chunk_id, group_key, score, greatest({_sim('qg', 'cg')}, least(1.0, 0.6 * CASE WHEN len(tb.b) = 0 THEN 0.0 ELSE len(list_intersect(tb.b, cb.b)) / len(tb.b) END)) AS rerank
   FROM k JOIN qg USING (query_id) JOIN cg USING (chunk_id) JOIN tb USING (query_id) JOIN cb USING (chunk_id)),
 b AS (SELECT * FROM r WHERE rerank >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id, group_key ORDER BY rerank DESC, score DESC, chunk_id) = 1)
 SELECT query_id, rank, chunk_id, group_key, round(rerank, 6) AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, chunk_id) AS rank FROM b) WHERE rank <= 8""")
def hybrid_topk(t, spark: SparkSession) -> DataFrame:
    found = retrieval.hybrid(_asked(t), _corpus(t), _dense_leg(t), _lexical_leg(t), _boost())
    return found.select("query_id", "rank", "chunk_id", "group_key", F.round("rerank", 6).alias("rerank"))


_SCOPED = ORACLE_SQL["hybrid_topk"].replace("AS score FROM rrf JOIN c USING (chunk_id))", """ + CASE WHEN contains(flat, anchor) THEN 0.04 ELSE 0.0 END AS score FROM rrf JOIN c USING (chunk_id) JOIN (SELECT doc_id AS chunk_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g')) || ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS flat FROM documents) USING (chunk_id)
   JOIN (SELECT query_id, lower(regexp_extract(query, '[a-zA-Z0-9가-힣]+')) AS anchor FROM q) USING (query_id) WHERE (query_id % 2 = 1 OR contains(flat, 'the') OR contains(flat, 'der')) AND (query_id % 3 > 0 OR contains(flat, anchor)))""")


@query(_SCOPED)
def hybrid_scoped(t, spark: SparkSession) -> DataFrame:
    """The same for queries with groups of terms that a chunk must name, and their first word as an anchor."""
    word = F.lower(F.regexp_extract("query", "[a-zA-Z0-9가-힣]+", 0))
    groups = F.array_compact(F.array(F.when(F.col("query_id") % 2 == 0, F.array(F.lit("the"), F.lit("der"))), F.when(F.col("query_id") % 3 == 0, F.array(word))))
    asked = _asked(t).withColumn("groups", groups).withColumn("anchors", F.array(word))
    found = retrieval.hybrid(asked, _corpus(t), _dense_leg(t), _lexical_leg(t), _boost())
    return found.select("query_id", "rank", "chunk_id", "group_key", F.round("rerank", 6).alias("rerank"))


@query("""WITH a AS (SELECT 'nation:' || n_nationkey AS entity_id, CASE WHEN n_nationkey % 3 = 0 THEN 'job' WHEN n_nationkey % 3 = 1 THEN 'job_family' ELSE 'item' END AS entity_type, lower(n_name) AS alias FROM nation),
 q AS (SELECT c_custkey AS query_id, lower(n_name || ' or nation_' || (c_custkey % 25)) AS query FROM customer JOIN nation ON c_nationkey = n_nationkey),
 o AS (SELECT query_id, entity_id, entity_type, alias, CAST(s - 1 AS INT) AS start, CAST(s - 1 + length(alias) AS INT) AS "end" FROM q, a, LATERAL (SELECT unnest(range(1, 60)) AS s) WHERE substring(query, s, length(alias)) = alias),
 k AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.query_id = o.query_id AND x.start < o."end" AND o.start < x."end" AND length(x.alias) > length(o.alias))),
 h AS (SELECT *, max(CASE entity_type WHEN 'job' THEN 3 WHEN 'job_family' THEN 2 END) OVER (PARTITION BY query_id) AS top FROM k)
 SELECT query_id, entity_id, start, "end" FROM h WHERE entity_type = 'item' OR top IS NULL OR top = CASE entity_type WHEN 'job' THEN 3 ELSE 2 END""")
def entity_link(t, spark: SparkSession) -> DataFrame:
    n = t("nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "job").when(F.col("n_nationkey") % 3 == 1, "job_family").otherwise("item")
    aliases = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("entity_id"), kind.alias("entity_type"), F.col("n_name").alias("alias"))
    asked = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    texts = asked.select(F.col("c_custkey").alias("query_id"), F.concat("n_name", F.lit(" or nation_"), (F.col("c_custkey") % 25).cast("string")).alias("query"))
    return entities.link(texts, aliases).select("query_id", "entity_id", "start", "end")


def _graph(t) -> DataFrame:
    """nation part_of region, supplier and customer is_a member of their nation."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("nation").select(name("n", "n_nationkey").alias("subject"), F.lit("part_of").alias("predicate"), name("r", "n_regionkey").alias("object"))
    edges = edges.unionByName(t("supplier").select(name("s", "s_suppkey").alias("subject"), F.lit("is_a").alias("predicate"), name("n", "s_nationkey").alias("object")))
    return edges.withColumn("relation_id", text.relation_id("subject", "predicate", "object"))


_GRAPH = """WITH g AS (SELECT *, sha256(subject || chr(0) || predicate || chr(0) || object) AS relation_id FROM (SELECT 'n' || n_nationkey AS subject, 'part_of' AS predicate, 'r' || n_regionkey AS object FROM nation UNION ALL SELECT 's' || s_suppkey, 'is_a', 'n' || s_nationkey FROM supplier)),
 e AS (SELECT c_custkey AS query_id, 'n' || c_nationkey AS entity_id FROM customer) """


@query(_GRAPH + """, one AS (SELECT DISTINCT query_id, relation_id, subject, object FROM e JOIN g ON entity_id IN (subject, object)),
 near AS (SELECT query_id, subject AS x FROM one UNION SELECT query_id, object FROM one),
 both AS (SELECT query_id, relation_id, 1 AS hop FROM one UNION ALL SELECT n.query_id, g.relation_id, 2 FROM near n JOIN g ON n.x IN (g.subject, g.object)),
 m AS (SELECT query_id, relation_id, CAST(min(hop) AS INT) AS hop FROM both GROUP BY ALL)
 SELECT query_id, relation_id, hop FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, relation_id) <= 16""".replace("both", "reached"))
def graph_two_hop(t, spark: SparkSession) -> DataFrame:
    seeds = t("customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("entity_id"))
    return entities.neighbourhood(seeds, _graph(t), 2, 16)


@query(_GRAPH + """SELECT DISTINCT query_id, relation_id FROM e JOIN g ON (query_id % 20 = 0 AND subject = entity_id AND predicate = 'is_a') OR (query_id % 20 <> 0 AND ((object = entity_id AND predicate = 'is_a') OR (subject = entity_id AND predicate = 'part_of')))""")
def typed_traversal(t, spark: SparkSession) -> DataFrame:
    linked = t("customer").select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.when(F.col("c_custkey") % 20 == 0, "job").otherwise("job_family").alias("entity_type")
    )
    return entities.typed_relations(linked, _graph(t))


@query("""WITH c AS (SELECT item_id AS id, 'f' || (item_id % 5) AS family, [CAST(item_id AS VARCHAR), CAST(item_id + 1 AS VARCHAR)] AS want FROM benchmark), p AS (SELECT item_id AS id, list_transform(range(0, 12), lambda i: CAST(item_id + (i * 7 + item_id) % 13 AS VARCHAR)) AS got FROM benchmark),
 s AS (SELECT id, family, len(list_intersect(want, list_distinct(got[1:10]))) / 2 AS recall, coalesce(1.0 / list_min(list_filter([list_position(got[1:10], want[1]), list_position(got[1:10], want[2])], lambda x: x > 0)), 0.0) AS rr FROM c JOIN p USING (id))
 SELECT round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr, round((SELECT min(r) FROM (SELECT avg(recall) AS r FROM s GROUP BY family)), 9) AS min_family_recall FROM s""")
def eval_recall_mrr(t, spark: SparkSession) -> DataFrame:
    b = t("benchmark").select(F.col("item_id").alias("id"))
    none = F.array().cast("array<string>")
    cases = b.select("id", F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("family"), F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("expected_sources"), none.alias("expected_terms"), F.lit(False).alias("no_evidence"), F.lit(False).alias("security"), none.alias("banned"))
    got = b.select("id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("id") + (i * 7 + F.col("id")) % 13).cast("string")).alias("sources"), F.lit("").alias("answer"))
    s = evaluation.summary(evaluation.ranked_cases(cases, got))
    return s.select(*[F.round(c, 9).alias(c) for c in ("recall", "mrr", "min_family_recall")])


@query("""WITH t AS (SELECT 'd' || i AS target, unnest([CASE i WHEN 0 THEN 'the' WHEN 1 THEN 'der' ELSE 'que' END, CASE i WHEN 0 THEN 'thon' WHEN 1 THEN 'ung' ELSE 'ción' END]) AS term FROM range(0, 3) r(i)),
 a AS (SELECT doc_id AS article_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS body, n_chars, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INT)) + to_minutes(doc_id % 1440) AS ts FROM documents WHERE doc_id % 3 <> 2),
 d AS (SELECT * FROM a WHERE ts >= TIMESTAMP '2024-01-10 15:00:00' AND ts < TIMESTAMP '2024-01-11 15:00:00'),
 o AS (SELECT conv_id AS article_id, turn, lower(text) AS body FROM conversations WHERE conv_id IN (SELECT article_id FROM d)), c AS (SELECT article_id, count(*) AS n FROM o GROUP BY article_id),
 m AS (SELECT target, article_id, max(titled) AS titled FROM (SELECT target, article_id, contains(title, term) AS titled FROM d JOIN t ON contains(body, term) OR contains(title, term) UNION ALL SELECT target, article_id, false FROM o JOIN t ON contains(body, term)) GROUP BY ALL)
 SELECT target, rank, article_id, titled FROM (SELECT target, article_id, titled, row_number() OVER (PARTITION BY target ORDER BY titled DESC, n_chars DESC, coalesce(n, 0) DESC, ts DESC, article_id DESC) AS rank FROM m JOIN d USING (article_id) LEFT JOIN c USING (article_id)) WHERE rank <= 20""")
def day_ranked_search(t, spark: SparkSession) -> DataFrame:
    terms = [("d0", ["the", "thon"]), ("d1", ["der", "ung"]), ("d2", ["que", "ción"])]
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int), 0, cast(doc_id % 1440 as int))")
    articles = t("documents").select(
        F.col("doc_id").alias("article_id"), (F.col("doc_id") % 3).cast("int").alias("board_id"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("category"),
        _title().alias("title"), F.col("text").alias("body"), F.col("n_chars").alias("recommended"), F.lit(0).alias("views"), at.alias("published_at"), F.lit(None).cast("timestamp").alias("collected_at"),
    )
    comments = t("conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("comment_id"), F.col("text").alias("body"), (F.col("turn") % 3).alias("score"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("indexed").alias("status"))
    targets = spark.createDataFrame(terms, "target string, terms array<string>")
    return analytics.day_search(targets, articles, comments, (0, 1), "2024-01-11").select("target", "rank", "article_id", "titled")


@query("""SELECT o_orderkey, round((o_custkey % 50 * 5 + ln(o_totalprice + 1) * 2 + o_orderkey % 9) * pow(0.5, age / 45.0), 6) AS score FROM (SELECT *, greatest(0, datediff('day', o_orderdate, TIMESTAMP '2001-01-01')) AS age FROM orders) WHERE age < 400""")
def half_life_score(t, spark: SparkSession) -> DataFrame:
    age = scalars.age_days(F.col("o_orderdate").cast("timestamp"), F.lit("2001-01-01").cast("timestamp"))
    rows = t("orders").withColumn("age", age).filter("age < 400")
    return rows.select("o_orderkey", F.round(scalars.decay_score(F.col("o_custkey") % 50, "o_totalprice", F.col("o_orderkey") % 9, "age"), 6).alias("score"))


@query("""WITH p AS (SELECT * FROM (VALUES ('the', 'with'), ('der', 'ung'), ('que', 'ción')) v(abbreviation, official)), f AS (SELECT abbreviation, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[a-z]+'), lambda w: length(w) BETWEEN 2 AND 20 AND contains(w, abbreviation) AND w <> abbreviation))) AS form FROM documents, p WHERE contains(text, abbreviation)),
 c AS (SELECT abbreviation, form, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL)
 SELECT abbreviation, form, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY abbreviation ORDER BY n DESC, form) AS rank FROM c) WHERE rank <= 20""")
def surface_topk(t, spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([("the", "with"), ("der", "ung"), ("que", "ción")], "abbreviation string, official string")
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return analytics.audit_terms(chunks, pairs, "a-z").select("abbreviation", F.explode("compounds").alias("c")).select("abbreviation", "c.form", "c.n", "c.rank")


@query("""SELECT abbreviation, official, (SELECT count(*) FROM documents WHERE contains(text, abbreviation)) AS abbreviation_chunks, (SELECT count(*) FROM documents WHERE contains(text, official)) AS official_chunks FROM (VALUES ('the', 'with'), ('der', 'ung'), ('que', 'ción')) v(abbreviation, official)""")
def term_audit(t, spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([("the", "with"), ("der", "ung"), ("que", "ción")], "abbreviation string, official string")
    return analytics.audit_terms(t("documents").select(F.col("doc_id").alias("chunk_id"), "text"), pairs, "a-z").select("abbreviation", "official", "abbreviation_chunks", "official_chunks")


@query()
def chunk_documents(t, spark: SparkSession) -> DataFrame:
    d = t("documents").select(F.lit("article").alias("source_type"), F.concat(F.lit("article:1:"), F.col("doc_id").cast("string")).alias("source_key"), text.truncated(_title(), 80).alias("title"), F.col("source").alias("board"), F.col("lang").alias("category"), F.lit(None).cast("timestamp").alias("published_at"), "text")
    return chunking.chunk(d).select("source_key", "ordinal", "chunk_id", "token_count")


@query()
def page_articles(t, spark: SparkSession) -> DataFrame:
    """Title and text of pages whose article element and heading are given the marks of an article page."""
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit('<article id="powerbbsContent">')), F.lit("<h1>"), F.lit('<h1 data-title="article">'))
    return t("pages").select("page_id", pages.articles(html, "https://example.com/").alias("a")).select("page_id", "a.status", "a.title", F.length("a.body").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'non_user_message' WHEN turn % 7 = 6 THEN 'guild_denied' WHEN length(q) = 0 THEN 'empty_question' WHEN length(q) > 300 THEN 'question_too_long' ELSE 'accepted' END AS reason, CASE WHEN turn % 2 = 1 THEN 'local' ELSE 'mix' END AS mode
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations)""")
def message_routing(t, spark: SparkSession) -> DataFrame:
    said = F.concat(F.lit("<@7> "), F.when(F.col("turn") % 2 == 1, "--rag-mode LOCAL ").otherwise(""), F.col("text"))
    m = t("conversations").select("conv_id", "turn", F.lit(1).alias("author_id"), (F.col("role") == "system").alias("author_is_bot"), F.when(F.col("turn") % 7 == 6, 9).otherwise(1).alias("guild_id"), F.lit(2).alias("channel_id"), said.alias("content"))
    return modes.route(m, 7, (1,), (2,), longest=300).select("conv_id", "turn", "reason", "mode")
