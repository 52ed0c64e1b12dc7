"""Queries of evidence joins, run records, retrieval steps and evaluation, on the star schema, events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import links as li
from ..operators import retrieval as re_
from ..operators import telemetry as te
from ..queries import Tables, query

_RANKED = "SELECT o_custkey AS query_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


def _ranked(t: Tables) -> DataFrame:
    """Orders of each customer as ranked candidates; their priority is the source or class."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("query_id"), "o_orderkey", "o_orderpriority", F.row_number().over(w).alias("rank"))


# ---- joins


@query("""
    WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY 1),
         r AS (SELECT l_orderkey, unnest(p) AS p_partkey, unnest(c) AS s_suppkey, unnest(range(len(p))) AS place FROM l)
    SELECT l_orderkey, place, p_name, s_name FROM r JOIN part USING (p_partkey) JOIN supplier USING (s_suppkey)""")
def j2_parallel_arrays(t: Tables) -> DataFrame:
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    lists = t.lineitem.groupBy("l_orderkey").agg(line.alias("l")).select("l_orderkey", F.col("l.l_partkey").alias("p"), F.col("l.l_suppkey").alias("c"))
    out = li.arrays_joined(lists, "p", "c", t.part.select("p_partkey", "p_name"), t.supplier.select("s_suppkey", "s_name"), "p_partkey", "s_suppkey")
    return out.select("l_orderkey", F.col("place").cast("long").alias("place"), "p_name", "s_name")


@query("""
    WITH f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey AS l_orderkey, coalesce(c.l_partkey, f.first) AS l_partkey FROM orders LEFT JOIN c ON c.l_orderkey = o_orderkey LEFT JOIN f ON f.l_orderkey = o_orderkey""")
def j3_first_child(t: Tables) -> DataFrame:
    chosen = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"))
    return li.or_first_child(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), chosen, t.lineitem.withColumn("at", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "at", "l_partkey")


@query("SELECT p_partkey, prefix FROM part JOIN (SELECT DISTINCT substr(p_type, 1, 4) AS prefix FROM part UNION SELECT DISTINCT substr(p_type, 1, 7) FROM part) ON starts_with(p_type, prefix)")
def j7_prefix_join(t: Tables) -> DataFrame:
    prefixes = t.part.select(F.substring("p_type", 1, 4).alias("prefix")).union(t.part.select(F.substring("p_type", 1, 7))).distinct()
    return li.prefix_join(t.part.select("p_partkey", "p_type"), "p_type", prefixes, "prefix").select("p_partkey", "prefix")


@query("""
    WITH c AS (SELECT conv_id, turn * 2 - turn // 3 AS at, role FROM conversations)
    SELECT a.conv_id, a.at, b.role AS before, c.role AS after FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.at = a.at - 1 LEFT JOIN c c ON c.conv_id = a.conv_id AND c.at = a.at + 1""")
def j12_ordinal_neighbours(t: Tables) -> DataFrame:
    """Ordinals with gaps: a neighbour is the row whose ordinal is one less or more, not the next row."""
    rows = t.conversations.select("conv_id", (F.col("turn") * 2 - F.floor(F.col("turn") / 3)).alias("at"), "role")
    return li.with_neighbours(rows, "conv_id", "at", "role").select("conv_id", "at", "before", "after")


@query("""
    WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS r FROM orders GROUP BY 1, 2)
    SELECT a.o_custkey, a.v AS value_a, b.v AS value_b, a.r AS rank_a, b.r AS rank_b FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND a.r < b.r""")
def j15_conflicts(t: Tables) -> DataFrame:
    """Also v13: conflict signals of claims with one label."""
    return li.conflicts(t.orders, "o_custkey", "o_orderpriority", "o_orderkey")


@query(r"""
    WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM benchmark),
         m AS (SELECT item_id, count(DISTINCT doc_id) AS k, min(doc_id) AS p FROM a JOIN d ON contains(t, s) GROUP BY 1)
    SELECT item_id, coalesce(k, 0) AS n_parents, CASE WHEN k = 1 THEN p END AS parent FROM a LEFT JOIN m USING (item_id)""")
def j17_anchored(t: Tables) -> DataFrame:
    return li.anchored(t.benchmark, "text", t.documents, "doc_id", "text").select("item_id", "n_parents", "parent")


@query("""
    WITH f AS (SELECT n_nationkey AS fact, n_regionkey AS sheet, 'name' AS col, n_name AS val FROM nation UNION ALL SELECT n_nationkey + 100, n_regionkey, 'key', CAST(n_nationkey AS VARCHAR) FROM nation),
         r AS (SELECT n_regionkey AS sheet, n_nationkey AS row, unnest(['name', 'key']) AS col, unnest([n_name, CAST(n_nationkey AS VARCHAR)]) AS val FROM nation)
    SELECT fact, row FROM f JOIN r USING (sheet, col, val)""")
def j18_key_rows(t: Tables) -> DataFrame:
    n = t.nation
    facts = n.select(F.col("n_nationkey").alias("fact"), F.col("n_regionkey").alias("sheet"), F.lit("name").alias("col"), F.col("n_name").alias("val")).union(n.select(F.col("n_nationkey") + 100, "n_regionkey", F.lit("key"), F.col("n_nationkey").cast("string")))
    rows = n.select(F.col("n_regionkey").alias("sheet"), F.col("n_nationkey").alias("row"), F.create_map(F.lit("name"), "n_name", F.lit("key"), F.col("n_nationkey").cast("string")).alias("cells"))
    return li.key_rows(facts, rows, "sheet", "col", "val", "cells").select("fact", "row")


@query("""
    SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey % 10 = 1 THEN 'deleted' WHEN s_suppkey % 10 = 2 THEN 'not ready' WHEN s_nationkey <> c_nationkey THEN 'different' ELSE 'same' END AS state
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def j20_drift(t: Tables) -> DataFrame:
    status = F.when(F.col("s_suppkey") % 10 == 1, "deleted").when(F.col("s_suppkey") % 10 == 2, "queued").otherwise("ready_with_warnings")
    current = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), status.alias("status"))
    return li.drift(t.customer.select("c_custkey", "c_nationkey"), current, "c_custkey", "c_nationkey", "status")


@query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, bool_or(p_partkey IS NOT NULL) AS ok FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT l_orderkey, bool_or(ok) AS any_fact, bool_and(ok) AS all_facts FROM f GROUP BY 1""")
def j21_reachable(t: Tables) -> DataFrame:
    children = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return li.reachable(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey", children)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT user_id AS i, event_id // 40 AS k FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT a.i AS x, b.i AS y FROM e a JOIN e b USING (k)),
         r AS (SELECT x AS i, x AS grp FROM p UNION SELECT p.y, r.grp FROM r JOIN p ON p.x = r.i WHERE r.grp < p.y)
    SELECT i AS user_id, min(grp) AS grp FROM r GROUP BY 1""")
def e14_leakage_groups(t: Tables) -> DataFrame:
    members = t.events.where("event_type = 'error'").select("user_id", F.floor(F.col("event_id") / 40).alias("k"))
    return li.leakage_groups(members, "user_id", "k")


# ---- retrieval steps


@query(f"SELECT query_id, o_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY over, rank) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, o_orderpriority ORDER BY rank) > 2 AS over FROM ({_RANKED}))")
def w5_final_cap(t: Tables) -> DataFrame:
    """Also u6: the kept ones, then the overflow."""
    return re_.cap_final(_ranked(t), "o_orderpriority", "rank", 2).select("query_id", "o_orderkey", "final_rank")


@query(f"""
    WITH r AS ({_RANKED}), h AS (SELECT query_id, bool_or(o_orderpriority = '1-URGENT') FILTER (rank <= 3) AS have, min(rank) FILTER (o_orderpriority = '1-URGENT' AND rank > 3) AS best, count(*) AS n FROM r GROUP BY 1),
         m AS (SELECT r.*, coalesce(have, false) = false AND best IS NOT NULL AS move, best FROM r JOIN h USING (query_id))
    SELECT query_id, o_orderkey, CASE WHEN NOT move OR rank < 3 OR rank > best THEN rank WHEN rank = best THEN 3 ELSE rank + 1 END AS floor_rank, move AND rank = best AS promoted FROM m""")
def w6_class_floor(t: Tables) -> DataFrame:
    return re_.class_floor(_ranked(t), "o_orderkey", "o_orderpriority", "rank", ["1-URGENT"], 3)


@query(f"SELECT query_id, o_orderpriority, row_number() OVER (PARTITION BY query_id ORDER BY f, o_orderpriority) AS rank FROM (SELECT query_id, o_orderpriority, min(rank) AS f FROM ({_RANKED}) GROUP BY 1, 2)")
def w8_distinct_first(t: Tables) -> DataFrame:
    return re_.distinct_first(_ranked(t), "o_orderpriority", "rank")


@query(f"""
    WITH b AS (SELECT query_id, o_orderpriority, min(rank) AS r FROM ({_RANKED}) GROUP BY 1, 2)
    SELECT b.query_id, b.o_orderpriority, x.o_orderkey AS anchor, row_number() OVER (PARTITION BY b.query_id ORDER BY r, b.o_orderpriority) AS rank FROM b JOIN ({_RANKED}) x ON x.query_id = b.query_id AND x.rank = b.r""")
def w2_parents(t: Tables) -> DataFrame:
    return re_.to_parents(_ranked(t), "o_orderpriority", "o_orderkey")


@query(f"SELECT query_id, o_orderkey, round(1.0 / (60 + rank), 12) AS score, rank AS best_rank, rank AS fused_rank FROM ({_RANKED})")
def r14_single_lane(t: Tables) -> DataFrame:
    return re_.fuse({"one": _ranked(t)}, "o_orderkey")


@query(r"""
    WITH p AS (SELECT 1 AS phrase_id, 'apache license' AS s UNION ALL SELECT 2, 'of the'),
         d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
    SELECT doc_id, phrase_id FROM d, p WHERE contains(t, ' ' || s || ' ')""")
def r8_phrase_match(t: Tables) -> DataFrame:
    phrases = t.region.sparkSession.createDataFrame([(1, "Apache License"), (2, "of the")], "phrase_id int, text string")
    return re_.phrase_matches(t.documents, "doc_id", "text", phrases)


@query(f"""
    WITH c AS (SELECT query_id, o_orderkey, rank, CASE WHEN o_orderkey % 3 = 0 THEN ['short'] ELSE ['a' || o_orderkey, 'b' || o_orderkey] END AS a FROM ({_RANKED})),
         p AS (SELECT query_id, o_orderkey, rank, unnest(range(len(a))) AS place, unnest(a) AS passage FROM c)
    SELECT query_id, o_orderkey, place, passage FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, place) AS i FROM p) WHERE i <= 5""")
def r16_rerank_pairs(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    c = _ranked(t).withColumn("text", F.when(F.col("o_orderkey") % 3 == 0, "short").otherwise(F.repeat(F.lit("long "), 20))).withColumn("anchors", F.array(F.concat(F.lit("a"), key), F.concat(F.lit("b"), key), F.concat(F.lit("c"), key)))
    return re_.rerank_pairs(c, "o_orderkey", "text", "anchors", "rank", 20, budget=5).withColumn("place", F.col("place").cast("long"))


@query("""
    WITH b AS (SELECT l_orderkey AS query_id, l_suppkey AS parent, max(l_quantity) AS score, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS place FROM lineitem GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent) AS rank FROM b""")
def r17_best_pairs(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("parent"), F.col("l_linenumber").alias("place"), F.col("l_quantity").alias("score"))
    return re_.best_pairs(pairs, "parent", "place", "score")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ['b', 'a', 'c'] ELSE ['a', 'b', 'c'] END AS anchors FROM nation")
def r19_anchor_promotion(t: Tables) -> DataFrame:
    best = F.when(F.col("n_nationkey") % 2 == 0, "b").otherwise("z")
    return t.nation.select("n_nationkey", re_.anchors_promoted(F.array(*map(F.lit, "abc")), best).alias("anchors"))


@query(f"SELECT query_id, o_orderstatus, count(*) AS n FROM ({_RANKED}) x JOIN orders USING (o_orderkey) WHERE rank <= 5 GROUP BY 1, 2")
def r22_class_counts(t: Tables) -> DataFrame:
    return re_.class_counts(_ranked(t).where("rank <= 5"), t.orders, "o_orderkey", "o_orderstatus")


@query("""
    WITH r AS (SELECT doc_id, unnest(['WS/' || upper(source) || '@v1:P' || (doc_id + 1), 'WS/' || upper(source) || '@v1:P' || (doc_id + 2), 'ws/' || source || '@v1:p1', 'WS/' || upper(source) || '@v1:P0']) AS handle FROM documents WHERE doc_id % 4 > 0
               UNION ALL SELECT doc_id, 'WS/' || upper(source) || '@v1:P' || i FROM documents, generate_series(1, 9) AS g(i) WHERE doc_id % 4 = 0 AND doc_id % 8 = 0
               UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 8 = 4),
         p AS (SELECT 'WS/' || upper(source) || '@v1:P' || (doc_id + 1) AS handle, doc_id % 5 = 0 AS deleted FROM documents),
         f AS (SELECT r.*, count(*) OVER (PARTITION BY doc_id) AS n FROM r)
    SELECT doc_id, f.handle, CASE WHEN n > 8 THEN 'TOO_MANY' WHEN f.handle IS NULL OR f.handle LIKE 'ws/%' OR f.handle LIKE '%:P0' THEN 'MALFORMED' WHEN p.handle IS NULL THEN 'NOT_FOUND' WHEN deleted THEN 'SOURCE_DELETED' END AS reason FROM f LEFT JOIN p ON p.handle = f.handle""")
def r23_get_evidence(t: Tables) -> DataFrame:
    """Each document asks for its own handle and the next one's, and for malformed ones; every eighth for too many."""
    d, n = t.documents, F.col("doc_id")
    handle = lambda page: F.concat(F.lit("WS/"), F.upper("source"), F.lit("@v1:P"), page.cast("string"))
    some = F.array(handle(n + 1), handle(n + 2), F.concat(F.lit("ws/"), "source", F.lit("@v1:p1")), handle(F.lit(0)))
    asked = F.when(n % 4 > 0, some).when(n % 8 == 0, F.transform(F.sequence(F.lit(1), F.lit(9)), handle)).otherwise(F.array(F.lit(None).cast("string")))
    parents = d.select(handle(n + 1).alias("handle"), (n % 5 == 0).alias("deleted"))
    return re_.resolved(d.select("doc_id", F.explode(asked).alias("handle")), "doc_id", "handle", parents, "deleted")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN 'WS' END AS workspace, CASE WHEN o_orderkey % 7 > 0 THEN 'C' || o_custkey END AS source, CASE WHEN o_orderkey % 7 > 0 THEN CAST(1 + o_orderkey % 9 AS INT) END AS version,
           CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'AQ' || upper(substr(md5(o_orderkey::VARCHAR), 1, 12)) ELSE 'SH1.R' || o_orderkey END END AS locator FROM orders""")
def r25_handle_parts(t: Tables) -> DataFrame:
    """Handles of orders with rows or computed results as locators; every seventh has a letter that no unit has."""
    k = F.col("o_orderkey")
    locator = F.when(k % 7 == 0, F.concat(F.lit("X1.R"), k.cast("string"))).when(k % 5 == 0, F.concat(F.lit("AQ"), F.upper(F.substring(F.md5(k.cast("string").cast("binary")), 1, 12)))).otherwise(F.concat(F.lit("SH1.R"), k.cast("string")))
    handle = F.concat(F.lit("WS/C"), F.col("o_custkey").cast("string"), F.lit("@v"), (1 + k % 9).cast("string"), F.lit(":"), locator)
    return t.orders.select("o_orderkey", re_.handle_parts(handle).alias("h")).select("o_orderkey", "h.*")


@query("""
    SELECT d.doc_id, CASE WHEN text IS NULL OR d.doc_id % 7 = 0 THEN 'withdrawn' WHEN d.doc_id % 3 = 0 AND length(text) > 0 THEN 'stale' ELSE 'verified' END AS state FROM documents d""")
def r28_integrity(t: Tables) -> DataFrame:
    """Quotes of documents, with other blanks than the text or with words it lacks; an empty text is quoted by nothing."""
    wrong = F.when(F.length("text") > 0, F.concat(F.col("text"), F.lit("§ not there")))
    refs = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, wrong).otherwise(F.regexp_replace(F.substring("text", 1, 60), " ", "  ")).alias("quote"))
    out = re_.integrity(refs, t.documents.select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("deleted")), "doc_id", "quote", "text", "deleted")
    return out.select("doc_id", "state")


@query("SELECT unnest(['en', 'xx', 'yy']) AS lang EXCEPT SELECT lang FROM documents")
def r33_absent_classes(t: Tables) -> DataFrame:
    return re_.absent_classes(["en", "xx", "yy"], t.documents, "lang")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')")
def f22_confidentiality(t: Tables) -> DataFrame:
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return re_.up_to_level(t.orders, "o_orderpriority", levels, "3-MEDIUM").select("o_orderkey")


# ---- run records


@query("SELECT role, turn, count(*) AS n FROM conversations GROUP BY 1, 2")
def t8_dispositions(t: Tables) -> DataFrame:
    return te.counts_by(t.conversations, "role", "turn")


@query("SELECT unnest([event_type, 'k' || CAST(user_id % 3 AS VARCHAR)]) AS category, count(*) AS n FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def t9_failure_categories(t: Tables) -> DataFrame:
    made = F.to_json(F.struct(F.when(F.col("event_id") % 4 > 0, F.array("event_type", F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")))).alias("failures")))
    return te.failure_categories(t.events.select(made.alias("doc")), "doc", "$.failures")


@query("""
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(user_id, 0.5), 6) AS p50_candidates,
           round(avg(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM events GROUP BY 1""")
def t10_retrieval_timing(t: Tables) -> DataFrame:
    hit = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0)
    out = te.retrieval_timing(t.events, ["event_type"], F.col("value"), F.col("user_id"), hit)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p50_candidates")], F.round("hit_rate", 9).alias("hit_rate"))


@query("SELECT event_type AS mode, user_id % 2 = 0 AS ok, count(*) AS n FROM events GROUP BY 1, 2")
def t11_counts_by_mode(t: Tables) -> DataFrame:
    return te.counts_by(t.events, F.col("event_type").alias("mode"), (F.col("user_id") % 2 == 0).alias("ok"))


@query("""
    SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(avg(CAST(event_type = 'error' AS INT)), 9) AS error_rate, count(*) FILTER (event_id % 5 > 0) AS recorded,
           round(avg(value) FILTER (event_id % 5 > 0), 6) AS mean_tokens FROM events""")
def t12_summary(t: Tables) -> DataFrame:
    out = te.summary(t.events, F.col("event_type") == "error", F.when(F.col("event_id") % 5 > 0, F.col("value")))
    return out.withColumn("error_rate", F.round("error_rate", 9)).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("SELECT event_type, user_id % 3 AS stage, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1, 2")
def t16_medians(t: Tables) -> DataFrame:
    out = te.percentiles(t.events.withColumn("stage", F.col("user_id") % 3), ["event_type", "stage"], F.col("value"), {"median": 0.5})
    return out.withColumn("median", F.round("median", 6))


@query("""
    SELECT bin, count(*) AS n, round(avg(CAST(event_type = 'error' AS INT)), 9) AS rate
    FROM (SELECT event_type, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 12 / count(*) OVER ()) AS BIGINT) AS bin FROM events) GROUP BY 1""")
def t18_rate_per_bin(t: Tables) -> DataFrame:
    return te.rate_per_bin(t.events, ["ts", "event_id"], 12, F.col("event_type") == "error").withColumn("rate", F.round("rate", 9))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def t19_count_by_value(t: Tables) -> DataFrame:
    return te.counts_by(t.events, "user_id")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT max(ts) FROM events) AS last_event")
def t21_overview(t: Tables) -> DataFrame:
    return te.overview(documents=(t.documents, F.count(F.lit(1))), conversations=(t.conversations, F.count_distinct("conv_id")), last_event=(t.events, F.max("ts")))


@query("SELECT status, count(*) AS n FROM (SELECT arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) GROUP BY 1")
def t22_latest_status(t: Tables) -> DataFrame:
    last = te.latest(t.events.select("user_id", "ts", "event_id", F.col("event_type").alias("status")), "user_id", ["ts", "event_id"])
    return te.counts_by(last, "status")


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def t23_level_histogram(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return te.log_page(t.events, level, "warning", F.col("user_id") % 2 == 0, "event_id", 20)[1]


@query("SELECT event_id, date_trunc('minute', ts - INTERVAL 90 MINUTE) AS low FROM events")
def t24_window_start(t: Tables) -> DataFrame:
    return t.events.select("event_id", te.window_start(F.col("ts").cast("timestamp"), 90).cast("timestamp_ntz").alias("low"))


@query("""
    WITH n AS (SELECT *, event_type = 'view' AS noise FROM events), c AS (SELECT noise, count(*) AS k FROM n GROUP BY 1),
         r AS (SELECT event_id, noise, row_number() OVER (PARTITION BY noise ORDER BY event_id DESC) AS i FROM n)
    SELECT event_id, CASE WHEN r.noise THEN 'noise' ELSE 'log' END AS ring, greatest(k - CASE WHEN r.noise THEN 20 ELSE 50 END, 0) AS dropped FROM r JOIN c ON c.noise = r.noise WHERE i <= CASE WHEN r.noise THEN 20 ELSE 50 END""")
def u5_two_rings(t: Tables) -> DataFrame:
    """Also the noise ring and the drop count of x7."""
    return te.two_rings(t.events, "event_id", F.col("event_type") == "view", 50, 20).select("event_id", "ring", "dropped")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def w10_run_numbers(t: Tables) -> DataFrame:
    return te.numbered(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", (F.col("_i") + 1).alias("seq"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_type = 'view' AS go FROM events WHERE event_type IN ('view', 'purchase')),
    s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e WHERE go),
    c AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e WHERE NOT go),
    f AS (SELECT s.user_id, s.t, s.i, 1 + count(c.n) AS first FROM s LEFT JOIN c ON c.user_id = s.user_id AND c.t < s.t GROUP BY 1, 2, 3),
    w AS (SELECT user_id, t, i, first AS taken FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.t, f.i, greatest(w.taken + 1, f.first) FROM w JOIN f ON f.user_id = w.user_id AND f.i = w.i + 1)
    SELECT coalesce(w.user_id, c.user_id) AS user_id, coalesce(w.t, c.t) AS started, c.t AS completed FROM w FULL JOIN c ON c.user_id = w.user_id AND c.n = w.taken""")
def w14_timeline(t: Tables) -> DataFrame:
    """Views as starts and purchases as ends of a user's calls."""
    out = te.paired(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "event_type", "ts", "view", "purchase")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("completed").alias("completed"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE 'completed' END AS state FROM events GROUP BY 1")
def v15_precedence(t: Tables) -> DataFrame:
    states = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))  # the set of kinds is small
    return states.select("user_id", te.precedence(F.col("s"), ["error", "purchase"], "completed").alias("state"))


# ---- evaluation


@query("""
    SELECT 'lang' AS dimension, lang AS value, count(*) AS items, round(avg(quality), 9) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 2
    UNION ALL SELECT 'source', source, count(*), round(avg(quality), 9) FROM labels JOIN documents USING (doc_id) GROUP BY 2""")
def e8_breakdown(t: Tables) -> DataFrame:
    items = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return ev.breakdown(items, {"lang": "lang", "source": "source"}, "quality").withColumn("mean", F.round("mean", 9))


@query("""
    WITH b AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'a_only' WHEN quality = 0 AND toxic = 1 THEN 'b_only' WHEN quality = 0 AND toxic = 0 THEN 'both_miss' END AS bucket FROM labels)
    SELECT bucket, count(*) AS n, list_sort(list(doc_id ORDER BY doc_id)[1:6]) AS examples FROM b WHERE bucket IS NOT NULL GROUP BY 1""")
def e10_failure_buckets(t: Tables) -> DataFrame:
    return ev.failure_buckets(t.labels, "doc_id", F.col("quality") == 1, F.col("toxic") == 1)


@query(f"""
    WITH r AS ({_RANKED}), n AS (SELECT DISTINCT query_id FROM r WHERE o_orderpriority = '5-LOW'), x AS (SELECT query_id, min(rank) FILTER (o_orderpriority = '5-LOW') AS neg, min(rank) FILTER (o_orderpriority = '1-URGENT') AS pos FROM r GROUP BY 1)
    SELECT query_id, pos AS true_rank, neg AS best_distractor_rank, neg IS NOT NULL AND (pos IS NULL OR neg < pos) AS distractor_wins FROM n JOIN x USING (query_id)""")
def e11_outranked(t: Tables) -> DataFrame:
    r = _ranked(t)
    facts = lambda p: r.where(F.col("o_orderpriority") == p).select("query_id", "o_orderkey")
    return ev.outranked(r, "query_id", "o_orderkey", facts("1-URGENT"), facts("5-LOW"))


def _stems(column: str, distinct: bool = True) -> str:
    cut = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) > {len(e) + 3} THEN substr(w, 1, length(w) - {len(e)})" for e in ev.ENDINGS)
    words = ", ".join(f"'{w}'" for w in ev.PLAIN_WORDS)
    stems = f"list_transform(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+(?:[.%][a-z0-9]+)*%?'), lambda w: w NOT IN ({words})), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN w {cut} ELSE w END)"
    return f"list_distinct({stems})" if distinct else stems


@query(f"""
    WITH s AS (SELECT a.item_id, {_stems('a.text')} AS q, {_stems('b.text')} AS x FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
         o AS (SELECT item_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, x)) / len(q), 9) END AS share FROM s)
    SELECT item_id, share, CASE WHEN share >= 0.67 THEN 'high' WHEN share >= 0.34 THEN 'mid' ELSE 'low' END AS bin FROM o""")
def e12_lexical_overlap(t: Tables) -> DataFrame:
    other = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("anchor"))
    out = t.benchmark.join(other, "item_id").select("item_id", F.round(ev.overlap_share(F.col("text"), F.col("anchor")), 9).alias("share"))
    return out.withColumn("bin", ev.overlap_bin(F.col("share")))


@query(f"""
    WITH s AS (SELECT a.item_id, {_stems('a.text', False)} AS q, {_stems('b.text', False)} AS x FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
         q AS (SELECT item_id, unnest(q) AS w, generate_subscripts(q, 1) AS i FROM s), x AS (SELECT item_id, unnest(x) AS w, generate_subscripts(x, 1) AS j FROM s),
         d AS (SELECT item_id, i, i - j AS diag, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS island FROM q JOIN x USING (item_id, w)),
         r AS (SELECT item_id, max(n) AS longest FROM (SELECT item_id, count(*) AS n FROM d GROUP BY item_id, diag, island) GROUP BY 1)
    SELECT item_id, coalesce(longest, 0) AS longest FROM s LEFT JOIN r USING (item_id)""")
def e13_longest_run(t: Tables) -> DataFrame:
    """Longest common run of content stems of each benchmark item and the next; the SQL counts runs on diagonals."""
    other = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("anchor"))
    return ev.longest_shared_run(t.benchmark.join(other, "item_id"), "text", "anchor").select("item_id", "longest")


@query("SELECT count(*) AS n, round(avg(a.quality::DOUBLE - b.toxic), 9) AS mean, true AS inside FROM labels a JOIN labels b USING (doc_id) WHERE a.quality IS NOT NULL AND b.toxic IS NOT NULL")
def e6_paired_bootstrap(t: Tables) -> DataFrame:
    """Bootstrap of a paired difference: its pairs, its mean, and whether the drawn interval holds the mean."""
    a = t.labels.select("doc_id", F.col("quality").cast("double").alias("s"))
    out = ev.paired_difference(a, t.labels.select("doc_id", F.col("toxic").cast("double").alias("s")), "doc_id", "s", samples=2000)
    return out.select("n", F.round("mean", 9).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"))


@query("""
    WITH l AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS f, list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R')) AS w FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN len(w) > 0 THEN round(len(list_intersect(f, w)) / len(w), 9) END AS recall, CASE WHEN len(f) > 0 THEN round(len(list_intersect(f, coalesce(w, []))) / len(f), 9) END AS precision FROM l""")
def e26_id_scores(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("f"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("w"))
    out = ev.id_scores(sets, "l_orderkey", "f", "w")
    return out.select("l_orderkey", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query(f"""
    WITH p AS (SELECT query_id, o_orderpriority < '3' AS rel, sum(CAST(o_orderpriority < '3' AS INT)) OVER (PARTITION BY query_id ORDER BY rank) * 1.0 / rank AS p FROM ({_RANKED}))
    SELECT query_id, round(avg(p) FILTER (rel), 9) AS average_precision FROM p GROUP BY 1""")
def e26_average_precision(t: Tables) -> DataFrame:
    out = ev.average_precision(_ranked(t).withColumn("rel", F.col("o_orderpriority") < "3"), "query_id", "rank", "rel")
    return out.withColumn("average_precision", F.round("average_precision", 9))


@query("""
    SELECT lang, count(*) AS n, round(avg(toxic) FILTER (quality = 0), 9) AS false_positive_rate, round(avg(1 - toxic) FILTER (quality = 1), 9) AS false_negative_rate
    FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def e27_verifier_rates(t: Tables) -> DataFrame:
    items = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    out = ev.verifier_rates(items, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("lang", "n", F.round("false_positive_rate", 9).alias("false_positive_rate"), F.round("false_negative_rate", 9).alias("false_negative_rate"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(value + value * 2, 6) END AS total FROM events")
def e24_stage_sums(t: Tables) -> DataFrame:
    timings = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("syn_a"), "value", F.lit("syn_b"), F.col("value") * 2, F.lit("x"), "value")).otherwise(F.create_map(F.lit("x"), "value"))
    return t.events.select("event_id", F.round(ev.prefixed_sum(timings, "syn_"), 6).alias("total"))


@query("SELECT o_orderpriority, bool_and(o_totalprice > 0) AS paid, bool_and(o_orderstatus <> 'P') AS settled, bool_and(o_totalprice > 0) AND bool_and(o_orderstatus <> 'P') AS passed FROM orders GROUP BY 1")
def e22_gates(t: Tables) -> DataFrame:
    return ev.gates(t.orders, ["o_orderpriority"], {"paid": F.col("o_totalprice") > 0, "settled": F.col("o_orderstatus") != "P"})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 'new' WHEN n_nationkey % 5 = 2 THEN 'changed' END AS state FROM nation WHERE n_nationkey % 5 IN (1, 2)")
def e29_gold_freeze(t: Tables) -> DataFrame:
    own = F.sha2(F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"))).cast("binary"), 256)
    expected = t.nation.where("n_nationkey % 5 <> 1").select("n_nationkey", own.alias("digest"))
    return ev.frozen(t.nation, "n_nationkey", ["n_name"], expected)


