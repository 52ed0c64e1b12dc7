"""Queries of telemetry, joins, windows and set operations on events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import links as li
from ..operators import telemetry as te
from ..queries import Tables, query

def _k() -> Column:
    """The number under k of the events' properties."""
    return cells.json_number(F.col("props"), "$.k")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total, count(json_extract(props, '$.k')) AS n, CAST(0 AS BIGINT) AS wrong FROM events GROUP BY 1")
def t1_json_number(t: Tables) -> DataFrame:
    wrong = cells.json_number(F.lit('{"k": "x"}'), "$.k")
    return t.events.groupBy("event_type").agg(F.sum(_k()).alias("total"), F.count(_k()).alias("n"), F.count(wrong).alias("wrong"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY 1")
def t2_percentiles(t: Tables) -> DataFrame:
    out = te.percentiles(t.events, ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95})
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query("SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS bought, count(DISTINCT user_id) AS users FROM events")
def t3_main_pass(t: Tables) -> DataFrame:
    return t.events.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_distinct("user_id").alias("users"))


@query("""
    WITH s AS (SELECT event_id, 'a' AS stage, value AS ms FROM events UNION ALL SELECT event_id, 'b', value * 2 FROM events)
    SELECT stage, round(quantile_cont(ms, 0.5), 6) AS p50, count(ms) AS n FROM s GROUP BY 1""")
def t4_stage_latency(t: Tables) -> DataFrame:
    wide = t.events.select("event_id", F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    return te.percentiles(te.stages(wide, ["event_id"], ["a", "b"]), ["stage"], F.col("ms"), {"p50": 0.5}).select("stage", F.round("p50", 6).alias("p50"), "n")


@query("""
    SELECT event_type, count(*) AS calls, count(*) FILTER (user_id % 3 = 0) AS ok, count(*) FILTER (user_id % 3 = 1) AS error, count(*) FILTER (user_id % 3 = 2) AS denied, count(*) FILTER (event_id % 7 = 0) AS redacted,
           round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def t5_tool_table(t: Tables) -> DataFrame:
    """Events as calls of tools, with a status by user."""
    status = F.element_at(F.array(F.lit("ok"), F.lit("error"), F.lit("denied")), (F.col("user_id") % 3 + 1).cast("int"))
    out = te.tool_table(t.events.withColumn("status", status), "event_type", "status", ["ok", "error", "denied"], F.col("value"), F.col("event_id") % 7 == 0)
    return out.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("""
    WITH r AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN user_id END AS ti, CASE WHEN event_id % 4 > 1 THEN event_id % 90 END AS tout, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS c FROM events)
    SELECT count(*) AS runs, count(*) FILTER (ti IS NOT NULL OR tout IS NOT NULL) AS with_usage, sum(coalesce(ti, 0))::BIGINT AS tokens_in, sum(coalesce(tout, 0))::BIGINT AS tokens_out, sum(c)::BIGINT AS model_calls, count(c) AS with_calls,
           round(avg((event_type = 'error')::INT), 9) AS rate_degraded, round(avg((event_type = 'purchase')::INT), 9) AS rate_completed, round(sum(coalesce(ti, 0)) / count(*) FILTER (ti IS NOT NULL OR tout IS NOT NULL), 9) AS mean_in,
           round(sum(c) / count(c), 9) AS mean_calls, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, count(value) AS timed,
           CAST(round_even((sum(coalesce(ti, 0)) * 3.0::DECIMAL(10,4) + sum(coalesce(tout, 0)) * 15.0::DECIMAL(10,4)) / 1000000, 6) AS DOUBLE) AS cost FROM r""")
def t12_run_summary(t: Tables) -> DataFrame:
    """Events as runs, a quarter of them without usage."""
    e, k = t.events, F.col("event_id")
    ti, to, calls = F.when(k % 4 > 0, F.col("user_id")), F.when(k % 4 > 1, k % 90), F.when(k % 5 > 0, k % 3)
    out = te.run_summary(e, F.col("value"), ti, to, calls, {"degraded": F.col("event_type") == "error"}, {"completed": F.col("event_type") == "purchase"}, 3.0, 15.0)
    rounded = {c: F.round(c, 9) for c in ("rate_degraded", "rate_completed", "mean_in", "mean_calls")} | {c: F.round(c, 6) for c in ("p50_ms", "p95_ms")}
    return out.drop("mean_out").withColumns(rounded).withColumn("cost", F.col("cost").cast("double"))


def _documents(t: Tables) -> DataFrame:
    k = F.col("event_id")
    doc = F.to_json(
        F.struct(
            F.struct(F.col("value").alias("total_ms"), F.when(k % 3 == 0, (F.col("value") / 2).cast("string")).alias("plan_ms"), (F.col("value") / 4).alias("search_ms")).alias("timings"),
            F.when(k % 4 > 0, F.struct(F.col("user_id").alias("input"), (k % 90).alias("output"))).alias("usage"), F.col("event_type").alias("mode"), F.lit("hidden").alias("secret"),
        )
    )
    return t.events.select("event_id", "ts", "user_id", doc.alias("doc"))


@query("""
    SELECT event_id, round(value, 1) AS total_ms, NULL::DOUBLE AS plan_ms, round(value / 4, 1) AS search_ms, CASE WHEN event_id % 4 > 0 THEN user_id END AS tokens_in, CASE WHEN event_id % 4 > 0 THEN event_id % 90 END AS tokens_out FROM events""")
def t15_series_points(t: Tables) -> DataFrame:
    """Points of all runs; a time that is a text in the document reads as none."""
    out = te.series_points(_documents(t), "event_id", "ts", "doc", ["plan_ms", "search_ms"], ["$.usage.input", "$.usage.output"], 3.0, 15.0)
    return out.select("event_id", "total_ms", "plan_ms", "search_ms", "tokens_in", "tokens_out")


@query("""
    WITH s AS (SELECT event_id // 10 * 10 AS run, '[' || string_agg('{"event_type":"' || event_type || '","user_id":' || user_id || '}', ',' ORDER BY event_id) || ']' AS steps FROM events WHERE event_id % 10 > 0 GROUP BY 1)
    SELECT event_id, '{"mode":"' || event_type || '"}' AS detail, coalesce(steps, '[]') AS steps FROM events LEFT JOIN s ON run = event_id WHERE event_id % 10 = 0""")
def t14_run_details(t: Tables) -> DataFrame:
    """Every tenth event as a run with the nine after it as its steps; only the mode of its document is told."""
    steps = t.events.where("event_id % 10 > 0").select((F.floor(F.col("event_id") / 10) * 10).alias("event_id"), F.col("event_id").alias("at"), "event_type", "user_id")
    return te.run_details(_documents(t).where("event_id % 10 = 0"), "event_id", "doc", ["mode"], steps, "at", ["event_type", "user_id"])


@query("SELECT event_id, event_type AS kind, substr('user ' || user_id || ' of a long story', 1, 12) AS note, 2 AS n FROM events")
def x13_safe_fields(t: Tables) -> DataFrame:
    """Log fields by an allow-list, values clipped to twelve characters."""
    note = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" of a long story"))
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), note, F.lit("token"), F.lit("secret"), F.lit("empty"), F.lit(None).cast("string"))
    kept = te.safe_fields(fields, ["kind", "note", "empty"], 12)
    return t.events.select("event_id", kept["kind"].alias("kind"), kept["note"].alias("note"), F.size(kept).alias("n"))


@query("SELECT unnest([event_type, lang]) AS value, count(*) AS n FROM events, (SELECT 'x' AS lang) GROUP BY 1")
def t6_flag_frequencies(t: Tables) -> DataFrame:
    return te.frequencies(t.events.select(F.array("event_type", F.lit("x")).alias("flags")), "flags")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS reason, count(*) AS n FROM events GROUP BY 1")
def t7_reason_frequencies(t: Tables) -> DataFrame:
    return t.events.groupBy(_k().cast("long").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def j4_latest_row(t: Tables) -> DataFrame:
    return te.latest(t.conversations.select("conv_id", "turn", "role"), "conv_id", ["turn"])


@query("""
    WITH page AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 20)
    SELECT p.conv_id, p.turns, (SELECT arg_min(text, turn) FROM conversations c WHERE c.conv_id = p.conv_id AND role = 'user') AS first_question FROM page p""")
def p10_conversation_page(t: Tables) -> DataFrame:
    """The page first, then the first question of its conversations only."""
    page = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turns")).orderBy(F.desc("conv_id")).limit(20)
    asked = t.conversations.where("role = 'user'").join(F.broadcast(page.select("conv_id")), "conv_id", "left_semi")
    return page.join(te.first(asked.select("conv_id", "turn", "text"), "conv_id", ["turn"]), "conv_id", "left").select("conv_id", "turns", F.col("text").alias("first_question"))


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j1_join_chain(t: Tables) -> DataFrame:
    """Large to small over keys; Spark broadcasts the small sides where their sizes allow."""
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return li.chain(per, (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")).select("n_name", "r_name", "n")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j5_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j6_anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT user_id, count(*) AS n FROM events WHERE starts_with(event_type, 'p') OR starts_with(CAST(event_id AS VARCHAR), '12') GROUP BY 1")
def j7_prefix_match(t: Tables) -> DataFrame:
    handles = F.array(F.col("event_type"), F.col("event_id").cast("string"))
    hit = F.startswith(F.element_at(handles, 1), F.lit("p")) | F.startswith(F.element_at(handles, 2), F.lit("12"))
    return t.events.where(hit).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, regexp_extract(p_brand, '(\\d+)', 1) AS code FROM part WHERE regexp_extract(p_brand, '(\\d+)', 1) IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def j8_handle_decomposition(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).alias("code"))
    return parts.join(t.nation.select(F.col("n_nationkey").cast("string").alias("code")), "code", "left_semi").select("p_partkey", "code")


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def j12_neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("""
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'b' WHEN b.id IS NULL THEN 'a' ELSE 'both' END AS side
    FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R') b ON a.id = b.id""")
def j13_paired_alignment(t: Tables) -> DataFrame:
    """Items of two runs, paired or not: one grouping instead of a full outer join."""
    flags = t.lineitem.where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    return flags.select("id", F.when(~F.col("b"), "a").when(~F.col("a"), "b").otherwise("both").alias("side"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u1_union_distinct(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("F", "O")).select("o_custkey").distinct()


@query("(SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u3_symmetric_difference(t: Tables) -> DataFrame:
    """One grouping by key instead of two set differences."""
    sides = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return sides.where(F.col("a") != F.col("b")).select("o_custkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u4_intersection(t: Tables) -> DataFrame:
    sides = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return sides.where("a AND b").select("o_custkey")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS kind FROM events")
def u7_upsert(t: Tables) -> DataFrame:
    base = t.events.select("event_id", F.col("event_type").alias("kind"))
    return te.upsert(base, base.where("event_id % 2 = 0").withColumn("kind", F.lit("new")), "event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def w3_top_k_per_class(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@query("""
    SELECT bin, count(*) AS n, round(avg(value), 6) AS mean
    FROM (SELECT value, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) * 7 / count(*) OVER ()) AS BIGINT) AS bin FROM events) GROUP BY 1""")
def w9_equal_bins(t: Tables) -> DataFrame:
    return te.equal_bins(t.events, ["event_id"], 7, F.col("value")).withColumn("mean", F.round("mean", 6))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def w11_next_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 90 THEN 'slow' WHEN event_type = 'purchase' THEN 'won' ELSE 'other' END AS outcome FROM events")
def t17_outcome(t: Tables) -> DataFrame:
    rules = [("failed", F.col("event_type") == "error"), ("slow", F.col("value") > 90), ("won", F.col("event_type") == "purchase")]
    return t.events.select("event_id", te.outcome(rules, "other").alias("outcome"))


@query("SELECT event_type, CAST(round_even(CAST(count(*) * 3.0000 + 2 * count(*) * 15.0000 AS DECIMAL(38,10)) / 1000000, 6) AS DOUBLE) AS cost FROM events GROUP BY 1")
def t13_cost(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", te.cost(F.col("n"), 2 * F.col("n"), 3.0, 15.0).cast("double").alias("cost"))


@query("""
    WITH m AS (SELECT CAST(max(ts) AS DATE) AS d FROM events), x AS (SELECT date_diff('day', CAST(ts AS DATE), d) AS k FROM events, m)
    SELECT CASE WHEN k <= 0 THEN 'today' WHEN k = 1 THEN 'yesterday' WHEN k <= 7 THEN 'week' WHEN k <= 30 THEN 'month' ELSE 'older' END AS bucket, count(*) AS n FROM x GROUP BY 1""")
def t20_recency(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.crossJoin(F.broadcast(now)).groupBy(te.recency(F.col("ts"), F.col("now")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def f20_log_severity(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return t.events.where(te.at_least(level, "warning")).select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def x7_ring(t: Tables) -> DataFrame:
    return te.ring(t.events, "event_id", 100).select("event_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(t: Tables) -> DataFrame:
    """Extension: tumbling windows in event time (the streaming form is in streaming.events)."""
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
