"""Queries of results and their presentation: listing, pages, formats, series, counts and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import presentation as pr
from ..operators import telemetry as te
from ..queries import Tables, query


@query("""
    SELECT encode(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id) AS raw, base64(encode(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id)) AS cursor, ts, event_id AS key FROM events""")
def p9_cursor(t: Tables) -> DataFrame:
    """Cursors of all events, and what they are read back as."""
    made = t.events.select(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_id").cast("binary").alias("raw"), pr.cursor_of(F.col("ts"), F.col("event_id")).alias("cursor"))
    ts, key = pr.cursor_parts(F.col("cursor"))
    return made.select("raw", "cursor", ts.cast("timestamp_ntz").alias("ts"), key.alias("key"))


@query("""
    SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def p11_result_listing(t: Tables) -> DataFrame:
    runs = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    before = F.struct("o_orderdate", "o_orderkey") < F.struct(F.lit("1997-01-01").cast("timestamp"), F.lit(0).cast("long"))
    return pr.result_page(orders, runs, "o_custkey", "o_orderdate", "o_orderkey", 20, [F.col("o_orderstatus") == "F", before]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("SELECT event_id, value, (SELECT count(*) > 50 FROM events) AS truncated FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def p12_newest_series(t: Tables) -> DataFrame:
    return pr.newest_series(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], 50).select("event_id", "value", "truncated")


@query("""
    WITH a AS (SELECT item_id, text, instr(text, ' ') AS s FROM benchmark), b AS (SELECT item_id, text, s, s + 5 AS e, greatest(0, s - 10) AS lo, least(length(text), s + 15) AS hi FROM a)
    SELECT item_id, substr(text, lo + 1, hi - lo) AS text, s - lo AS mark_start, least(e, hi) - lo AS mark_end, lo > 0 AS truncated_left, hi < length(text) AS truncated_right FROM b""")
def p13_snippet(t: Tables) -> DataFrame:
    at = F.instr("text", " ")
    return t.benchmark.select("item_id", pr.snippet(F.col("text"), at, at + 5, 10).alias("s")).select("item_id", "s.*")


@query("""
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER w AS i, sum(length(text) + 1) OVER w + 1 AS size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
         k AS (SELECT *, i <= 5 AND size <= 900 AS kept FROM r), f AS (SELECT conv_id, NOT bool_and(kept) AS truncated FROM k GROUP BY 1)
    SELECT conv_id, turn, truncated FROM k JOIN f USING (conv_id) WHERE kept""")
def p15_output_cap(t: Tables) -> DataFrame:
    return pr.capped_output(t.conversations.where("conv_id IS NOT NULL"), "conv_id", "turn", "text", 5, 900).select("conv_id", "turn", "truncated")


@query("SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 8")
def p16_top_bars(t: Tables) -> DataFrame:
    return pr.by_metric(te.counts_by(t.part, "p_brand"), "n", "p_brand", descending=True, limit=8)


@query("SELECT c_custkey, row_number() OVER (ORDER BY v ASC NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)")
def p17_metric_order(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    ordered = te.numbered(rows.withColumn("_none", F.col("v").isNull()), [], ["_none", "v", "c_custkey"])
    return ordered.select("c_custkey", (F.col("_i") + 1).alias("place"))


@query("""
    WITH g AS (SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS big FROM orders GROUP BY 1)
    SELECT status, 'n' AS metric, CAST(n AS BIGINT) AS value FROM g UNION ALL SELECT status, 'big', big FROM g UNION ALL SELECT status, 'difference', n - big FROM g""")
def a25_flattened(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big"))
    return pr.flatten(g, ["status"], ["n", "big"], ("n", "big"))


@query("SELECT CASE WHEN count(*) = 1 THEN max(n_name) END AS n_name FROM nation WHERE n_nationkey = 3")
def a29_unique_pick(t: Tables) -> DataFrame:
    return pr.unique_pick(t.nation, F.col("n_nationkey") == 3, "n_name")


@query("SELECT o_orderkey, '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || CASE WHEN o_totalprice = floor(o_totalprice) THEN '' ELSE '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS shown, format('{:,}', o_orderkey) AS key FROM orders")
def a32_display(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", pr.display(F.col("o_totalprice").cast("decimal(18,2)"), "usd").alias("shown"), pr.display(F.col("o_orderkey"), "count").alias("key"))


@query("""
    WITH x AS (SELECT CASE WHEN event_id % 7 > 0 THEN least(value / 100, 1.0) END AS x FROM events)
    SELECT round(avg(x), 9) AS mean, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.25), 9) AS p25, round(quantile_cont(x, 0.75), 9) AS p75, min(x) AS min, max(x) AS max, count(x) AS n, count(*) - count(x) AS n_nan,
           [count(*) FILTER (least(floor(x * 10), 9) = i) FOR i IN range(0, 10)] AS histogram FROM x""".replace("[count(*) FILTER (least(floor(x * 10), 9) = i) FOR i IN range(0, 10)]", "[" + ", ".join(f"count(*) FILTER (least(floor(x * 10), 9) = {i})" for i in range(10)) + "]"))
def a35_score_summary(t: Tables) -> DataFrame:
    score = F.when(F.col("event_id") % 7 > 0, F.least(F.col("value") / 100, F.lit(1.0)))
    out = pr.score_summary(t.events, score)
    return out.select(*[F.round(c, 9).alias(c) for c in ("mean", "median", "p25", "p75")], "min", "max", "n", "n_nan", "histogram")


@query("SELECT o_orderpriority, total FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority < '4' THEN count(*) END AS total FROM orders GROUP BY 1) WHERE total IS NOT NULL")
def a37_line_series(t: Tables) -> DataFrame:
    per = te.counts_by(t.orders, "o_orderpriority").select("o_orderpriority", F.when(F.col("o_orderpriority") < "4", F.col("n")).alias("total"))
    return pr.line_series(per, "total", ["o_orderpriority"])


@query("""
    SELECT * FROM (SELECT 'n_name' AS "column", count(DISTINCT n_name) AS n_values FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'one', 1) WHERE n_values > 1""")
def a39_varying_columns(t: Tables) -> DataFrame:
    return pr.varying_columns(t.nation.withColumn("one", F.lit(1)), ["n_name", "n_regionkey", "one"])


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def a40_callouts(t: Tables) -> DataFrame:
    return pr.first_of(t.part.select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], ["p_partkey"])


@query("SELECT event_type, count(*) AS n, list_position(['purchase', 'error', 'view', 'none'], event_type) AS position FROM events WHERE event_type IN ('purchase', 'error', 'view', 'none') GROUP BY 1")
def a41_ordered_counts(t: Tables) -> DataFrame:
    return pr.ordered_counts(t.events, "event_type", ["purchase", "error", "view", "none"])


@query("SELECT CAST(sum(p_size) AS BIGINT) AS p_size, count(*) FILTER (p_retailprice > 1000) AS dear, count(*) FILTER (p_size < 10) AS small FROM part")
def a42_totals(t: Tables) -> DataFrame:
    return pr.totals(t.part, ["p_size"], {"dear": F.col("p_retailprice") > 1000, "small": F.col("p_size") < 10})


@query("SELECT o_orderpriority, count(*) AS sources, count(*) FILTER (o_orderstatus = 'F') AS ready, CAST(coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS passages FROM orders GROUP BY 1")
def a43_status_counts(t: Tables) -> DataFrame:
    return pr.status_counts(t.orders, ["o_orderpriority"], "o_orderstatus", "F", "o_custkey")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_size) >= 2 AS comparable FROM part")
def a44_comparable(t: Tables) -> DataFrame:
    return pr.comparable(t.part, "p_brand", "p_size").select("p_partkey", "comparable")


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def a45_distinct_values(t: Tables) -> DataFrame:
    return pr.values_of(t.part, "p_type")


@query("""
    WITH s AS (SELECT event_id, sum(ms) AS s, max(total) AS total FROM (SELECT event_id, value AS ms, value * 2 + event_id % 2 AS total FROM events UNION ALL SELECT event_id, value * 0.5, NULL FROM events) GROUP BY 1),
         r AS (SELECT event_id, 'a' AS stage, value AS ms FROM events UNION ALL SELECT event_id, 'b', value * 0.5 FROM events UNION ALL SELECT event_id, 'other', total - s FROM s WHERE total - s >= 1)
    SELECT event_id, stage, round(ms, 6) AS ms, round(CASE WHEN greatest(total, s) > 0 THEN ms / greatest(total, s) * 100 ELSE 0 END, 6) AS pct FROM r JOIN s USING (event_id)""")
def w13_segments(t: Tables) -> DataFrame:
    wide = t.events.select("event_id", (F.col("value") * 2 + F.col("event_id") % 2).alias("total"), F.col("value").alias("a"), (F.col("value") * 0.5).alias("b"))
    out = pr.segments(wide.unpivot(["event_id", "total"], ["a", "b"], "stage", "ms"), "event_id", "stage", "ms", "total")
    return out.select("event_id", "stage", F.round("ms", 6).alias("ms"), F.round("pct", 6).alias("pct"))


@query("""
    WITH k AS (SELECT *, CASE WHEN user_id % 5 > 0 THEN user_id END AS g FROM events)
    SELECT event_id FROM (SELECT event_id, g, row_number() OVER (PARTITION BY g, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM k) WHERE g IS NULL OR rn = 1""")
def w15_without_repeats(t: Tables) -> DataFrame:
    rows = t.events.select(F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("g"), "event_type", "ts", "event_id")
    return pr.without_repeats(rows, "g", ["event_type"], ["ts", "event_id"]).select("event_id")


@query("SELECT o_custkey, o_orderkey, coalesce(o_orderkey = max(o_orderkey) FILTER (o_orderstatus <> 'P') OVER (PARTITION BY o_custkey), false) AS current FROM orders")
def w17_versions(t: Tables) -> DataFrame:
    return pr.versions(t.orders, "o_custkey", "o_orderkey", F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey", "current")
