"""Registered relational queries: scans, joins, aggregates, windows, sets, merges, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import scalars, text
from loomspark.operators import merge, retrieval, temporal, threads

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


def cents(c):
    """Exact sum of amounts with two decimals."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 30")
def scan_filter_active(t, spark: SparkSession) -> DataFrame:
    return t("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 30)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
  count(*) AS n, max(l_discount) AS max_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '2002-01-01' GROUP BY ALL""")
def pricing_summary(t, spark: SparkSession) -> DataFrame:
    rows = t("lineitem").filter("l_shipdate <= timestamp_ntz '2002-01-01 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(cents("l_quantity").alias("sum_qty"), cents("l_extendedprice").alias("sum_price"), F.count("*").alias("n"), F.max("l_discount").alias("max_discount"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list_filter(t, spark: SparkSession) -> DataFrame:
    return t("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)")
def semi_exists_match(t, spark: SparkSession) -> DataFrame:
    big = t("lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_denylist(t, spark: SparkSession) -> DataFrame:
    denied = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(denied, "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE '%\\%%' ESCAPE '\\'")
def ilike_escaped(t, spark: SparkSession) -> DataFrame:
    terms = spark.createDataFrame([("ring",), ("%",)], "term string").select(F.concat(F.lit("%"), text.like_escaped("term"), F.lit("%")).alias("wanted"))
    return t("part").join(F.broadcast(terms), F.expr("p_name ilike wanted"), "left_semi").select("p_partkey", "p_name")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'ECO%' OR contains(p_name, 'widget') GROUP BY p_type")
def prefix_and_contains(t, spark: SparkSession) -> DataFrame:
    return t("part").filter(F.col("p_type").startswith("ECO") | F.col("p_name").contains("widget")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE coalesce(ts, TIMESTAMP '1970-01-01') >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-10 15:00:00'")
def local_day_range(t, spark: SparkSession) -> DataFrame:
    start, end = scalars.day_window(F.lit("2024-01-10"))
    at = F.coalesce(F.col("ts").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    return t("events").filter((at >= start) & (at < end)).select("event_id", "user_id")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def join_dim_left(t, spark: SparkSession) -> DataFrame:
    region = t("region").filter("r_regionkey < 3")
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_four_way(t, spark: SparkSession) -> DataFrame:
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(cents("l_extendedprice").alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT s.n_name AS subject, o.n_name AS object, r_name FROM nation s JOIN nation o ON s.n_regionkey = o.n_regionkey AND s.n_nationkey < o.n_nationkey JOIN region ON s.n_regionkey = r_regionkey")
def self_join_pairs(t, spark: SparkSession) -> DataFrame:
    s, o = t("nation").alias("s"), t("nation").alias("o")
    j = s.join(o, (F.col("s.n_regionkey") == F.col("o.n_regionkey")) & (F.col("s.n_nationkey") < F.col("o.n_nationkey"))).join(t("region"), F.col("s.n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s.n_name").alias("subject"), F.col("o.n_name").alias("object"), "r_name")


@query("SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn - 1 = p.turn")
def self_join_reply(t, spark: SparkSession) -> DataFrame:
    c = t("conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", "parent_role")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS supplied, b.n AS bought FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN
  (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k""")
def outer_merge_lists(t, spark: SparkSession) -> DataFrame:
    a = t("supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("s"), F.lit(None).cast("int").alias("b"))
    b = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(None).cast("int").alias("s"), F.lit(1).alias("b"))
    return a.unionByName(b).groupBy("k").agg(F.sum("s").alias("supplied"), F.sum("b").alias("bought"))


@query("""SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open, count(DISTINCT o_custkey) AS customers,
  min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders""")
def filtered_counts(t, spark: SparkSession) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return t("orders").agg(F.count("*").alias("n"), n("F").alias("done"), n("O").alias("open"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def group_to_list(t, spark: SparkSession) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    return t("nation").groupBy("n_regionkey").agg(F.array_join(names, ",").alias("names"))


@query("SELECT round(min(m), 6) AS least_mean FROM (SELECT CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS m FROM events GROUP BY event_type)")
def min_of_group_means(t, spark: SparkSession) -> DataFrame:
    return t("events").groupBy("event_type").agg((cents("value") / F.count("*")).alias("m")).agg(F.round(F.min("m"), 6).alias("least_mean"))


@query("""SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type = 'view' THEN 1 END) AS views,
  round(count(CASE WHEN event_type = 'error' THEN 1 END) / nullif(count(CASE WHEN event_type = 'view' THEN 1 END), 0), 6) AS rate FROM events GROUP BY user_id""")
def safe_ratio(t, spark: SparkSession) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return t("events").groupBy("user_id").agg(n("error").alias("errors"), n("view").alias("views")).withColumn("rate", F.round(F.try_divide("errors", "views"), 6))


@query("""SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P
  FROM orders GROUP BY o_orderpriority""")
def status_tallies(t, spark: SparkSession) -> DataFrame:
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def distinct_pairs(t, spark: SparkSession) -> DataFrame:
    return t("orders").filter("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority").distinct()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def window_keep_latest(t, spark: SparkSession) -> DataFrame:
    return merge.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id DESC) AS keeper FROM events")
def window_first_value(t, spark: SparkSession) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), F.desc("ts"), F.desc("event_id"))
    return t("events").select("event_id", F.first("event_id").over(w).alias("keeper"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS g FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM a WHERE g <= 3) SELECT l_suppkey, rank, l_orderkey, l_linenumber FROM b WHERE rank <= 8""")
def window_group_cap(t, spark: SparkSession) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    kept = retrieval.top(t("lineitem"), ["l_suppkey", "l_returnflag"], order, 3, "g")
    return retrieval.top(kept, ["l_suppkey"], order, 8).select("l_suppkey", "rank", "l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def topn_per_parent(t, spark: SparkSession) -> DataFrame:
    return retrieval.top(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 3, "n").select("o_custkey", "o_orderkey", "n")


@query("SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5")
def session_last_turns(t, spark: SparkSession) -> DataFrame:
    return temporal.last_turns(t("conversations"), ["conv_id"], ["turn"], 5).select("conv_id", "turn", "back")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_index FROM events")
def step_index(t, spark: SparkSession) -> DataFrame:
    log = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), F.col("ts").alias("at"), F.col("event_type").alias("fingerprint"))
    return temporal.replay(log).select(F.col("step_id").alias("event_id"), "step_index")


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_custkey DESC, o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def sort_limit_keys(t, spark: SparkSession) -> DataFrame:
    return t("orders").orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_totalprice"), F.desc("o_custkey"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey")


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) > 4 AS truncated FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4""")
def truncation_probe(t, spark: SparkSession) -> DataFrame:
    return threads.bounded(t("conversations").withColumnsRenamed({"conv_id": "article_id", "turn": "comment_id"}), 4).select(F.col("article_id").alias("conv_id"), F.col("comment_id").alias("turn"), "truncated")


@query("""SELECT 'missing' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def coverage_difference(t, spark: SparkSession) -> DataFrame:
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    return c.subtract(o).select(F.lit("missing").alias("side"), "k").unionAll(o.subtract(c).select(F.lit("extra").alias("side"), "k"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def union_of_rules(t, spark: SparkSession) -> DataFrame:
    rules = [t("nation").filter("n_regionkey = 1").select("n_nationkey"), t("supplier").filter("s_acctbal > 5000").select("s_nationkey"), t("customer").filter("c_acctbal > 9900").select("c_nationkey")]
    return rules[0].union(rules[1]).union(rules[2]).toDF("k").dropDuplicates(["k"])


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, upper(c_name) AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0)
  SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n ON o.k = n.k""")
def upsert_keep_first(t, spark: SparkSession) -> DataFrame:
    c = t("customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), (F.col("c_acctbal") + 1).alias("bal"))
    return merge.upsert(old, new, ["k"], keep=("name",))


def _change_sets(t) -> DataFrame:
    o = t("orders")
    old = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("content_hash"), F.col("o_totalprice").alias("views"), F.lit("indexed").alias("status"))
    new = o.filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("content_hash"), (F.col("o_totalprice") * 2).alias("views"))
    return merge.changed_upsert(old, new, "k", ("views",))


_CHANGES = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS h, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS h, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 3 <> 1),
 j AS (SELECT coalesce(o.k, n.k) AS k, coalesce(n.h, o.h) AS content_hash, coalesce(n.v, o.v) AS views, CASE WHEN o.k IS NULL OR (n.k IS NOT NULL AND o.h <> n.h) THEN 'sanitized' ELSE 'indexed' END AS status,
 CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.k = n.k) """


@query(_CHANGES + "SELECT k, content_hash, views, status, action FROM j")
def upsert_changed(t, spark: SparkSession) -> DataFrame:
    return _change_sets(t)


@query(_CHANGES + "SELECT k AS source_key, action, k || ':' || content_hash AS dedupe_key FROM j WHERE action IN ('inserted', 'updated')")
def outbox_changes(t, spark: SparkSession) -> DataFrame:
    return merge.outbox(_change_sets(t), "k")


@query(_CHANGES + "SELECT action, count(*) AS n FROM j GROUP BY action")
def sync_counters(t, spark: SparkSession) -> DataFrame:
    return _change_sets(t).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def append_missing(t, spark: SparkSession) -> DataFrame:
    return merge.append_missing(t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_custkey, c_mktsegment <> 'FURNITURE' AND (c_nationkey >= 10 OR c_custkey IN (SELECT o_custkey FROM orders)) AS active FROM customer")
def soft_delete_missing(t, spark: SparkSession) -> DataFrame:
    old = t("customer").withColumn("active", F.col("c_mktsegment") != "FURNITURE")
    return merge.deactivate_missing(old, t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], scope=F.col("c_nationkey") < 10).select("c_custkey", "active")


@query("""WITH o AS (SELECT l_orderkey AS source_key, l_orderkey || '-' || l_linenumber AS chunk_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), n AS (SELECT * FROM o WHERE source_key % 7 = 0 AND chunk_id NOT LIKE '%-1')
  SELECT source_key, chunk_id, source_key NOT IN (SELECT source_key FROM n) OR chunk_id IN (SELECT chunk_id FROM n) AS active FROM o""")
def chunk_replace(t, spark: SparkSession) -> DataFrame:
    old = t("lineitem").select(F.col("l_orderkey").alias("source_key"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id")).distinct().withColumn("active", F.lit(True))
    new = old.filter("source_key % 7 = 0 and chunk_id not like '%-1'").drop("active")
    return merge.replace_versions(old, new)


@query("""SELECT source_key, regexp_extract(source_key, '^(?:comment:)?article:\\d+:(\\d+)', 1)::BIGINT % 11 <> 0 AS active
  FROM (SELECT 'article:1:' || conv_id AS source_key FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'comment:article:1:' || conv_id || ':' || turn FROM conversations)""")
def exclusion_cascade(t, spark: SparkSession) -> DataFrame:
    c = t("conversations")
    key = F.concat(F.lit("article:1:"), F.col("conv_id").cast("string"))
    articles = c.select("conv_id").distinct().select(key.alias("source_key"))
    keys = articles.unionAll(c.select(F.concat(F.lit("comment:"), key, F.lit(":"), F.col("turn").cast("string")))).withColumn("active", F.lit(True))
    return merge.exclusion_cascade(keys, c.filter("conv_id % 11 = 0").select(key.alias("source_key")))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-12 15:00:00' AS active FROM events")
def retention_expiry(t, spark: SparkSession) -> DataFrame:
    cutoff = scalars.retention_cutoff(F.lit("2024-01-20 03:00:00").cast("timestamp"), 7)
    rows = t("events").withColumn("active", F.lit(True)).withColumn("at", F.col("ts").cast("timestamp"))
    return merge.expire(rows, "at", cutoff).select("event_id", "active")


@query("""SELECT event_id, sum(CASE WHEN ts - before <= INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def ttl_sessions(t, spark: SparkSession) -> DataFrame:
    return temporal.sessions(t("events"), "user_id", "ts", "event_id", 12 * 3600).select("event_id", "session")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT user_id, event_id, n, true AS accepted, [t] AS held FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, len(list_filter(f.held, lambda x: x > e.t - 86400000000)) < 5, CASE WHEN len(list_filter(f.held, lambda x: x > e.t - 86400000000)) < 5 THEN list_append(list_filter(f.held, lambda x: x > e.t - 86400000000), e.t) ELSE f.held END
 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT user_id, event_id, accepted FROM f""")
def rate_limit(t, spark: SparkSession) -> DataFrame:
    return temporal.rate_limit(t("events"), "user_id", "ts", "event_id", 5, 86400.0)


@query("""SELECT o_orderkey AS id, CASE WHEN n <= 100 THEN 'leased' ELSE 'queued' END AS state, CASE WHEN n <= 100 THEN 1 ELSE 0 END AS attempts FROM
  (SELECT *, CASE WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN row_number() OVER (PARTITION BY o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT) DESC, o_orderkey) END AS n FROM orders)""")
def queue_lease(t, spark: SparkSession) -> DataFrame:
    jobs = t("orders").select(
        F.col("o_orderkey").alias("id"), F.lit("queued").alias("state"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("timestamp").alias("leased_until"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_at"),
    )
    return temporal.lease(jobs, "w1", F.lit("1997-01-01").cast("timestamp"), 100).select("id", "state", "attempts")


@query("""SELECT CAST((s - 1) // 10 + 1 AS INT) AS round, CAST(n_nationkey AS INT) AS board_id, CAST(greatest(p, s) AS INT) AS start, CAST(s + 9 - greatest(p, s) + 1 AS INT) AS pages FROM
  (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 7 + 1 END AS p FROM nation), range(1, 201, 10) r(s) WHERE p <= s + 9""")
def round_robin_plan(t, spark: SparkSession) -> DataFrame:
    boards = t("nation").select(F.col("n_nationkey").alias("board_id"), F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") * 7 + 1).alias("next_page"))
    return temporal.round_robin(boards).drop("pos")


@query("SELECT n_nationkey AS attempt, CAST(least(3600, 30 * pow(2, n_nationkey - 1)) AS BIGINT) AS wait FROM nation WHERE n_nationkey > 0")
def backoff_schedule(t, spark: SparkSession) -> DataFrame:
    return t("nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("attempt"), scalars.backoff_seconds("n_nationkey").alias("wait"))


@query("""WITH e AS (SELECT user_id % 8 AS host, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 200 ELSE 500 END AS status FROM events),
 r AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY event_id) AS run FROM e),
 c AS (SELECT *, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY host, run ORDER BY event_id) AS k FROM r)
 SELECT host, CASE WHEN min(CASE WHEN status = 429 AND k >= 2 THEN event_id END) IS NOT NULL THEN 'repeated_429' END AS reason, min(CASE WHEN status = 429 AND k >= 2 THEN event_id END) AS opened_at FROM c GROUP BY host""")
def circuit_breaker(t, spark: SparkSession) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "click", 200).otherwise(500)
    rows = t("events").select((F.col("user_id") % 8).alias("host"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("event"))
    return temporal.circuit(rows)


@query("""SELECT event_id, CASE WHEN l < date_trunc('day', l) + INTERVAL 6 HOUR THEN date_trunc('day', l) + INTERVAL 6 HOUR ELSE date_trunc('day', l) + INTERVAL 30 HOUR END - INTERVAL 9 HOUR AS daily,
  CASE WHEN date_trunc('day', l) + to_days(CAST((3 - isodow(l) + 7) % 7 AS INT)) + INTERVAL 10 HOUR > l THEN date_trunc('day', l) + to_days(CAST((3 - isodow(l) + 7) % 7 AS INT)) + INTERVAL 10 HOUR
  ELSE date_trunc('day', l) + to_days(CAST((3 - isodow(l) + 7) % 7 + 7 AS INT)) + INTERVAL 10 HOUR END - INTERVAL 9 HOUR AS weekly FROM (SELECT event_id, ts + INTERVAL 9 HOUR AS l FROM events)""")
def next_schedule(t, spark: SparkSession) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return t("events").select("event_id", scalars.next_daily(at, 6).cast("timestamp_ntz").alias("daily"), scalars.next_weekly(at, 2, 10).cast("timestamp_ntz").alias("weekly"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role <> 'system' AS shown, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 3 WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations),
 v AS (SELECT * FROM c WHERE shown),
 up(conv_id, turn, above, steps) AS (SELECT conv_id, turn, parent, 1 FROM v WHERE parent IS NOT NULL UNION ALL SELECT up.conv_id, up.turn, v.parent, steps + 1 FROM up JOIN v ON v.conv_id = up.conv_id AND v.turn = up.above WHERE v.parent IS NOT NULL AND steps < 40),
 loops AS (SELECT DISTINCT conv_id, turn FROM up WHERE steps >= 40),
 r AS (SELECT v.conv_id, v.turn, v.parent, p.turn IS NOT NULL AND l.turn IS NULL AS ok FROM v LEFT JOIN v p ON p.conv_id = v.conv_id AND p.turn = v.parent LEFT JOIN loops l ON l.conv_id = v.conv_id AND l.turn = v.turn WHERE v.parent IS NOT NULL),
 e AS (SELECT conv_id, 'has_comment' AS kind, conv_id AS source, turn AS target FROM v UNION ALL SELECT conv_id, 'reply_to', turn, parent FROM r WHERE ok)
 SELECT e.conv_id AS article_id, kind, source, target, coalesce(complete, true) AS complete FROM e LEFT JOIN (SELECT conv_id, bool_and(ok) AS complete FROM r GROUP BY conv_id) USING (conv_id)""")
def thread_edges(t, spark: SparkSession) -> DataFrame:
    """Turns as replies to the turn before; in every fifth conversation the second answers the fourth, which closes a circle."""
    status = F.when(F.col("role") == "system", "deleted").otherwise("indexed")
    parent = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.lit(3)).when(F.col("turn") > 0, F.col("turn") - 1)
    c = t("conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("comment_id"), parent.cast("long").alias("parent_id"), status.alias("status"))
    return threads.project(c)


@query("""SELECT conv_id AS article_id, turn AS comment_id, turn - h.h AS ancestor_id, CAST(h.h AS INT) AS hop FROM conversations, range(0, 4) h(h) WHERE turn - h.h >= 0""")
def thread_ancestors(t, spark: SparkSession) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("comment_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"))
    return threads.ancestors(c, c, 3)


@query("""SELECT n_nationkey AS k, CASE WHEN d <= 1 THEN 1.10 WHEN d = 2 THEN 1.05 WHEN d <= 4 THEN 1.0 WHEN d <= 9 THEN 0.95 WHEN d <= 20 THEN round(0.90 - (d - 10) * 0.05, 2) ELSE greatest(0.10, round(0.40 - (d - 20) * 0.05, 2)) END::DOUBLE AS rate
  FROM (SELECT n_nationkey, abs(n_nationkey * 2 - 10)::DOUBLE AS d FROM nation)""")
def level_penalty(t, spark: SparkSession) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("k"), scalars.level_rate(F.lit(210), F.col("n_nationkey") * 2 + 200).cast("double").alias("rate"))


#: Need of each level in the synthetic table of the two queries below.
_NEED = {n: 1000 + 10 * (n - 200) for n in range(200, 301)}


@query("""SELECT p_partkey, CAST(floor(1000 * CASE WHEN d <= 1 THEN 1.10 WHEN d = 2 THEN 1.05 WHEN d <= 4 THEN 1.0 WHEN d <= 9 THEN 0.95 WHEN d <= 20 THEN round(0.90 - (d - 10) * 0.05, 2) ELSE greatest(0.10, round(0.40 - (d - 20) * 0.05, 2)) END::DOUBLE * 1.5 * 100) AS BIGINT) AS per_hour
  FROM (SELECT p_partkey, abs(p_size - 20)::DOUBLE AS d FROM part)""")
def hunting_rate(t, spark: SparkSession) -> DataFrame:
    h = scalars.hunting(F.lit(220), F.col("p_size") + 200, F.lit(1000), F.lit(150.0), F.lit(100), F.lit(100000), F.lit(10.0))
    return t("part").select("p_partkey", h.alias("h")).select("p_partkey", F.col("h.per_hour").alias("per_hour"))


@query("""SELECT p_partkey, CAST(200 + p_size + p_size % 4 AS INT) AS level, CAST((p_size % 4) * (1000 + 10 * p_size) + 10 * (p_size % 4) * (p_size % 4 - 1) / 2 AS BIGINT) AS gained FROM part""")
def potion_levels(t, spark: SparkSession) -> DataFrame:
    p = scalars.potions(F.col("p_size") + 200, F.lit(25.0), F.col("p_size") % 4, _NEED, 260, 260)
    return t("part").select("p_partkey", p.alias("p")).select("p_partkey", F.col("p.level").alias("level"), F.col("p.gained").alias("gained"))
