"""Queries of the analytics engine on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import analytics as an
from ..queries import Tables, query
from .spec import Schema

LINES = Schema.of(l_returnflag="categorical", l_linestatus="categorical", l_quantity="numeric", l_extendedprice="numeric", l_discount="numeric", l_linenumber="numeric")
ORDERS = Schema.of(o_orderpriority="categorical", o_orderstatus="categorical", o_totalprice="numeric", day="date", month="date", o_orderkey="numeric")


def _orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


def _dec(c: str) -> str:
    return f"CAST({c} AS DECIMAL(28,10))"


def _mean(c: str, dp: int) -> str:
    return f"CAST(round_even(CAST(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DECIMAL(38,10)) / count({c}) AS DECIMAL(38,10)), {dp}) AS DOUBLE)"


@query(f"""
    SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS value_0, count(*) AS denominator_0, CAST(NULL AS BIGINT) AS numerator_0,
           {_mean('l_quantity', 2)} AS value_1, count(*) AS denominator_1, CAST(NULL AS BIGINT) AS numerator_1,
           CAST(round_even(CAST(100 AS DECIMAL(38,10)) * count(*) FILTER (l_discount >= 0.05) / count(l_discount), 1) AS DOUBLE) AS value_2,
           count(*) AS denominator_2, count(*) FILTER (l_discount >= 0.05) AS numerator_2, CAST([] AS VARCHAR[]) AS warnings, false AS cap_exceeded
    FROM lineitem GROUP BY l_returnflag""")
def a1_grouped_aggregate(t: Tables) -> DataFrame:
    """Lines by return flag: count, mean quantity, share with a discount of 5 % or more, ordered by the share."""
    spec = {"metrics": [{"fn": "count"}, {"fn": "mean", "column": "l_quantity"}, {"fn": "share", "condition": {"column": "l_discount", "op": "gte", "value": 0.05}}], "group_by": ["l_returnflag"], "order_by": "value", "order_metric": 2, "descending": True}
    return an.aggregate(t.lineitem, LINES.aggregate(spec))


@query("SELECT CAST(count(*) AS DOUBLE) AS value_0, count(*) AS denominator_0, CAST(count(nullif(l_returnflag,'N')) AS DOUBLE) AS value_1, count(nullif(l_returnflag,'N')) AS denominator_1 FROM lineitem")
def a2_count(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'N')"))
    return an.aggregate(df, LINES.aggregate({"metrics": [{"fn": "count"}, {"fn": "count", "column": "l_returnflag"}]})).select("value_0", "denominator_0", "value_1", "denominator_1")


@query("SELECT l_linestatus, CAST(count(DISTINCT l_quantity) AS DOUBLE) AS value_0, count(l_quantity) AS denominator_0 FROM lineitem GROUP BY 1")
def a3_count_distinct(t: Tables) -> DataFrame:
    """Distinct quantities by canonical form: 2023 and "2023.0" are one."""
    df = t.lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise(F.col("l_quantity").cast("int").cast("string")))
    return an.aggregate(df, LINES.aggregate({"metrics": [{"fn": "count_distinct", "column": "l_quantity"}], "group_by": ["l_linestatus"]})).select("l_linestatus", "value_0", "denominator_0")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value_0 FROM lineitem GROUP BY 1, 2")
def a4_sum(t: Tables) -> DataFrame:
    return an.aggregate(t.lineitem, LINES.aggregate({"metrics": [{"fn": "sum", "column": "l_extendedprice"}], "group_by": ["l_returnflag", "l_linestatus"]})).select("l_returnflag", "l_linestatus", "value_0")


@query(f"SELECT o_orderstatus, {_mean('o_totalprice', 2)} AS value_0 FROM orders GROUP BY 1")
def a5_mean(t: Tables) -> DataFrame:
    return an.aggregate(_orders(t), ORDERS.aggregate({"metrics": [{"fn": "mean", "column": "o_totalprice"}], "group_by": ["o_orderstatus"]})).select("o_orderstatus", "value_0")


@query("""
    WITH r AS (SELECT o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
         s AS (SELECT o_orderpriority, CAST(sum(x) FILTER (rn = (n + 1) // 2) + sum(x) FILTER (rn = (n + 2) // 2) AS BIGINT) AS cents FROM r GROUP BY 1)
    SELECT o_orderpriority, (cents // 2 + CASE WHEN cents % 2 = 1 AND cents // 2 % 2 = 1 THEN 1 ELSE 0 END) / 100 AS value_0 FROM s""")
def a6_median(t: Tables) -> DataFrame:
    return an.aggregate(_orders(t), ORDERS.aggregate({"metrics": [{"fn": "median", "column": "o_totalprice"}], "group_by": ["o_orderpriority"]})).select("o_orderpriority", "value_0")


@query("SELECT o_orderstatus, CAST(CAST(min(o_totalprice) AS DECIMAL(18,2)) AS DOUBLE) AS value_0, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) AS DOUBLE) AS value_1 FROM orders GROUP BY 1")
def a7_min_max(t: Tables) -> DataFrame:
    return an.aggregate(_orders(t), ORDERS.aggregate({"metrics": [{"fn": "min", "column": "o_totalprice"}, {"fn": "max", "column": "o_totalprice"}], "group_by": ["o_orderstatus"]})).select("o_orderstatus", "value_0", "value_1")


@query("SELECT o_orderstatus, min(strftime(o_orderdate, '%Y-%m-%d')) AS value_0, max(strftime(o_orderdate, '%Y-%m-%d')) AS value_1 FROM orders GROUP BY 1")
def a8_min_max_date(t: Tables) -> DataFrame:
    return an.aggregate(_orders(t), ORDERS.aggregate({"metrics": [{"fn": "min", "column": "day"}, {"fn": "max", "column": "day"}], "group_by": ["o_orderstatus"]})).select("o_orderstatus", "value_0", "value_1")


@query("""
    SELECT o_orderpriority, CAST(round_even(CAST(100 AS DECIMAL(38,10)) * count(*) FILTER (s = 'F') / nullif(count(s), 0), 1) AS DOUBLE) AS value_0, count(*) FILTER (s = 'F') AS numerator_0, count(s) AS denominator_0,
           CASE WHEN count(s) < count(*) THEN ['NULLS_EXCLUDED'] ELSE CAST([] AS VARCHAR[]) END AS warnings
    FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY 1""")
def a9_share(t: Tables) -> DataFrame:
    df = _orders(t).withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    spec = {"metrics": [{"fn": "share", "condition": {"column": "o_orderstatus", "op": "eq", "value": "F"}}], "group_by": ["o_orderpriority"]}
    return an.aggregate(df, ORDERS.aggregate(spec)).select("o_orderpriority", "value_0", "numerator_0", "denominator_0", "warnings")


@query("SELECT CAST(NULL AS DOUBLE) AS value_0, CAST(0 AS BIGINT) AS denominator_0, ['EMPTY_SELECTION', 'ZERO_DENOMINATOR'] AS warnings")
def a10_warnings(t: Tables) -> DataFrame:
    spec = {"metrics": [{"fn": "sum", "column": "o_totalprice"}], "filters": [{"column": "o_orderstatus", "op": "eq", "value": "none"}]}
    return an.aggregate(_orders(t), ORDERS.aggregate(spec)).select("value_0", "denominator_0", "warnings")


@query("SELECT CAST(min(l_linenumber) AS VARCHAR) AS l_linenumber, CAST(count(*) AS DOUBLE) AS value_0 FROM lineitem GROUP BY lineitem.l_linenumber")
def a11_group_identity(t: Tables) -> DataFrame:
    """Numbers written as 1, "1.0" and "1.00" are one group; its label is the one that sorts first."""
    df = t.lineitem.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))).otherwise(F.col("l_linenumber").cast("string")))
    return an.aggregate(df, LINES.aggregate({"metrics": [{"fn": "count"}], "group_by": ["l_linenumber"]})).select("l_linenumber", "value_0")


@query(f"""
    WITH s AS (SELECT {_mean('l_quantity', 2)} AS v, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,10)) / count(*) AS e, count(*) AS n, l_returnflag FROM lineitem GROUP BY l_returnflag)
    SELECT a.v AS value_a, b.v AS value_b, a.n AS denominator_a, b.n AS denominator_b, CAST(round_even(CAST(a.e AS DECIMAL(38,10)) - CAST(b.e AS DECIMAL(38,10)), 2) AS DOUBLE) AS difference, a.n + b.n AS denominator
    FROM s a, s b WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def a12_group_compare(t: Tables) -> DataFrame:
    return an.compare(t.lineitem, LINES.compare({"metric": {"fn": "mean", "column": "l_quantity"}, "compare_column": "l_returnflag", "group_a": "A", "group_b": "R"}))


@query("""
    WITH c AS (SELECT o_orderpriority AS v, count(*) AS c, min(o_orderkey) AS f FROM orders GROUP BY 1)
    SELECT 'o_orderpriority' AS "column", 'categorical' AS kind, 'context' AS role, CAST(sum(c) AS BIGINT) AS non_empty, count(*) AS "distinct", string_agg(v, '|' ORDER BY c DESC, f) AS levels FROM c
    UNION ALL SELECT 'o_totalprice', 'numeric', 'numeric', count(*), count(DISTINCT o_totalprice), NULL FROM orders
    UNION ALL SELECT 'day', 'date', 'date', count(*), count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')), NULL FROM orders
    UNION ALL SELECT 'notice', 'categorical', 'constant', count(*), 1, 'synthetic data' FROM orders
    UNION ALL SELECT 'code', 'text', 'identifier', count(*), count(*), NULL FROM orders""")
def a0_column_profile(t: Tables) -> DataFrame:
    df = _orders(t).withColumn("notice", F.lit("synthetic data")).withColumn("code", F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")))
    return an.profile(df, ["o_orderpriority", "o_totalprice", "day", "notice", "code"], "o_orderkey").withColumn("levels", F.array_join("levels", "|"))


@query("""
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(least(9, floor((o_totalprice - lo) / ((hi - lo) / 10))) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def a33_histogram(t: Tables) -> DataFrame:
    return an.histogram(t.orders, "o_totalprice", 10).select("bin", "n")


@query("""
    WITH s AS (SELECT o_orderpriority AS g, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1)
    SELECT g AS o_orderpriority, CAST(round_even(CAST(100 * v AS DECIMAL(38,10)) / sum(v) OVER (), 3) AS DOUBLE) AS share,
           CAST(round_even(CAST(100 * coalesce(sum(v) OVER (ORDER BY v DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38,10)) / sum(v) OVER (), 3) AS DOUBLE) AS start FROM s""")
def a34_composition(t: Tables) -> DataFrame:
    return an.composition(t.orders, "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)"))


@query("""
    WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH') GROUP BY 1, 2),
         c AS (SELECT DISTINCT p FROM g), r AS (SELECT DISTINCT s FROM g)
    SELECT r.s AS series, c.p AS category, row_number() OVER (PARTITION BY c.p ORDER BY r.s) AS series_at, row_number() OVER (PARTITION BY r.s ORDER BY c.p) AS category_at, n AS value FROM c CROSS JOIN r LEFT JOIN g ON g.p = c.p AND g.s = r.s""")
def a36_grouped_series(t: Tables) -> DataFrame:
    """Counts by priority and status: the status, with fewer values, makes the series; one cell is empty."""
    by = t.orders.where("NOT (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    placed = by.withColumn("at", F.row_number().over(Window.orderBy("o_orderpriority", "o_orderstatus")))  # at most some dozens of rows
    return an.grouped_series(placed, "o_orderpriority", "o_orderstatus", "n")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a36_pivot(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus").count().na.fill(0)


@query("""
    WITH s AS (SELECT o_orderstatus AS g, count(*) AS c FROM orders GROUP BY 1)
    SELECT g AS o_orderstatus, CASE WHEN g = 'P' THEN 'unavailable' WHEN g = 'F' THEN 'computed' ELSE 'mismatch' END AS state FROM s""")
def a26_pinned_results(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("value"))
    pinned = counts.withColumn("value", F.when(F.col("o_orderstatus") == "F", F.col("value")).otherwise(F.lit(-1)))
    return an.compare_pinned(counts.where("o_orderstatus <> 'P'"), pinned, ["o_orderstatus"])


@query("""
    WITH m AS (SELECT strftime(o_orderdate, '%Y') AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1)
    SELECT a.y, CAST(round_even(CAST(100 * (a.v - b.v) AS DECIMAL(38,10)) / b.v, 1) AS DOUBLE) AS pct_change FROM m a JOIN m b ON CAST(a.y AS INT) = CAST(b.y AS INT) + 1""")
def a28_derived_change(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    b = m.select((F.col("yr") + 1).alias("yr"), F.col("v").alias("w"))
    return m.join(b, "yr").select(F.col("yr").cast("string").alias("y"), cells.half_even((100 * (F.col("v") - F.col("w")) / F.col("w")).cast("decimal(38,10)"), 1).alias("pct_change"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS contradicting, count(*) FILTER (c_acctbal >= 0) AS supporting FROM customer GROUP BY 1")
def a31_support_counts(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("contradicting"), F.count_if(F.col("c_acctbal") >= 0).alias("supporting"))


def _filter_count(name: str, spec: list[dict], where: str) -> None:
    def run(t: Tables) -> DataFrame:
        df = _orders(t).withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
        return an.aggregate(df, ORDERS.aggregate({"metrics": [{"fn": "count"}], "filters": spec})).select(F.col("denominator_0").alias("n"))

    run.__name__ = name
    query(f"SELECT count(*) AS n FROM (SELECT *, nullif(o_orderstatus, 'P') AS s, strftime(o_orderdate, '%Y-%m') AS m FROM orders) WHERE {where}")(run)


_filter_count("f0_conjunction", [{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 1000}], "s = 'F' AND o_totalprice > 1000")
_filter_count("f1_eq", [{"column": "o_orderstatus", "op": "eq", "value": "F"}], "s = 'F'")
_filter_count("f2_ne", [{"column": "o_orderstatus", "op": "ne", "value": "F"}], "s <> 'F'")
_filter_count("f3_in", [{"column": "o_orderpriority", "op": "in", "values": ["1-URGENT", "2-HIGH"]}], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter_count("f4_not_in", [{"column": "o_orderstatus", "op": "not_in", "values": ["F"]}], "s NOT IN ('F')")
_filter_count("f5_gt", [{"column": "o_totalprice", "op": "gt", "value": 100000}], "o_totalprice > 100000")
_filter_count("f6_gte", [{"column": "o_orderkey", "op": "gte", "value": 100}], "o_orderkey >= 100")
_filter_count("f7_lt", [{"column": "o_totalprice", "op": "lt", "value": 100000}], "o_totalprice < 100000")
_filter_count("f8_lte", [{"column": "o_orderkey", "op": "lte", "value": 100}], "o_orderkey <= 100")
_filter_count("f9_between", [{"column": "o_totalprice", "op": "between", "values": [1000, 50000]}], "o_totalprice BETWEEN 1000 AND 50000")
_filter_count("f10_is_null", [{"column": "o_orderstatus", "op": "is_null"}], "s IS NULL")
_filter_count("f11_not_null", [{"column": "o_orderstatus", "op": "not_null"}], "s IS NOT NULL")
_filter_count("f13_period_gte", [{"column": "month", "op": "gte", "value": "1995-03-01"}], "m >= '1995-03'")
_filter_count("f13_period_between", [{"column": "month", "op": "between", "values": ["1994-01", "1995-06-15"]}], "m BETWEEN '1994-01' AND '1995-05'")
_filter_count("f13_period_lt", [{"column": "day", "op": "lt", "value": "1995-03"}], "strftime(o_orderdate, '%Y-%m-%d') < '1995-03-01'")
_filter_count("f16_canonical_equality", [{"column": "o_orderkey", "op": "eq", "value": "7.0"}], "o_orderkey = 7")


@query("SELECT count(*) AS n FROM customer WHERE contains(lower(c_name), '#0000001')")
def f21_literal_contains(t: Tables) -> DataFrame:
    return t.customer.where(cells.contains_literal(F.col("c_name"), "#0000001")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def p1_list_rows(t: Tables) -> DataFrame:
    schema = Schema.of(k="text", o_orderpriority="categorical", o_totalprice="numeric", o_orderstatus="categorical")
    plan = schema.listing({"filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}], "columns": ["k", "o_orderpriority"], "order_by": "o_totalprice", "descending": True, "limit": 10})
    return an.list_rows(t.orders.withColumn("k", F.col("o_orderkey").cast("string")), plan, "o_orderkey")


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 159) || '…' ELSE text END AS shown FROM documents")
def p4_clipped_cells(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cells.clipped(F.col("text")).alias("shown"))


@query("SELECT o_custkey AS label, CAST(count(*) AS DOUBLE) AS value_0 FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def p6_order_by_value(t: Tables) -> DataFrame:
    schema = Schema.of(o_custkey="numeric")
    out = an.aggregate(t.orders, schema.aggregate({"metrics": [{"fn": "count"}], "group_by": ["o_custkey"], "order_by": "value", "descending": True}))
    return out.select(F.col("o_custkey").cast("long").alias("label"), "value_0")


@query("SELECT o_custkey AS label, true AS cap_exceeded, 'GROUPS_TRUNCATED' AS warnings FROM (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 50)")
def p7_group_cap(t: Tables) -> DataFrame:
    out = an.aggregate(t.orders, Schema.of(o_custkey="numeric").aggregate({"metrics": [{"fn": "count"}], "group_by": ["o_custkey"]}))
    return out.select(F.col("o_custkey").cast("long").alias("label"), "cap_exceeded", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events WHERE event_id = 500) ORDER BY ts DESC, event_id DESC LIMIT 21)")
def p8_keyset_page(t: Tables) -> DataFrame:
    """A page before a cursor, with one row more to tell whether there is another page."""
    cursor = t.events.where("event_id = 500").select(F.struct("ts", "event_id").alias("c"))
    rows = t.events.crossJoin(F.broadcast(cursor)).where(F.struct("ts", "event_id") < F.col("c"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(21).select("event_id")


@query("""
    WITH s AS (SELECT o_orderkey, sum(length('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}')) OVER (ORDER BY o_orderkey) AS total FROM orders)
    SELECT o_orderkey, (SELECT max(total) > 30000 FROM s) AS truncated FROM s WHERE total <= 30000""")
def p14_bounded_result(t: Tables) -> DataFrame:
    return an.bounded(t.orders.select("o_orderkey", "o_orderpriority"), 30_000, ["o_orderkey"]).select("o_orderkey", "truncated")
