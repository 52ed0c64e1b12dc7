"""Queries of the catalogue, of row units, spans and blocks, on the star schema, documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue as ca
from ..operators import packing as pk
from ..operators import retrieval as re_
from ..queries import Tables, query


def _versions(t: Tables) -> DataFrame:
    """Orders of a customer as versions of a source."""
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "ready_degraded").otherwise("queued")
    return t.orders.select("o_custkey", "o_orderkey", status.alias("status"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def s8_newest_versions(t: Tables) -> DataFrame:
    sources = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return ca.newest_versions(sources, t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, l_linenumber FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F'")
def s4_visible_children(t: Tables) -> DataFrame:
    children = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return ca.visible_children(children, t.orders.where("o_orderstatus = 'F'"), "o_orderkey", "l_returnflag", ["A", "N", "R"], "N", "l_linestatus", ["F"]).select("o_orderkey", "l_linenumber")


@query("""
    WITH v AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1)
    SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS parents FROM v JOIN customer ON c_custkey = o_custkey""")
def s9_catalogue(t: Tables) -> DataFrame:
    sources = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return ca.catalogue(sources, _versions(t), t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_custkey", "o_orderkey", "status")


@query("SELECT n_name || ':' || n_regionkey AS dataset, n_nationkey FROM nation WHERE n_name || ':' || n_regionkey = (SELECT min(n_name || ':' || n_regionkey) FROM nation)")
def a23_described(t: Tables) -> DataFrame:
    """Also s5: the ids of the catalogue."""
    tables = ca.dataset_ids(t.nation, "n_name", "n_regionkey")
    first = tables.agg(F.min("dataset")).first()[0]
    return ca.described(tables, first, "n_nationkey").select("dataset", "n_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey = (SELECT max(l_partkey) FROM lineitem)")
def s7_rows_of_table(t: Tables) -> DataFrame:
    """Rows of the dataset with the largest number; its size is that of the profile of all datasets."""
    profile = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_rows"))
    wanted, size = profile.agg(F.max(F.struct("l_partkey", "n_rows")).alias("m")).select("m.*").first()
    return ca.rows_of(t.lineitem, "l_partkey", wanted, size).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND event_type = 'error'")
def f19_run_filter(t: Tables) -> DataFrame:
    since, until = t.events.agg(F.min("ts") + F.expr("INTERVAL 1 DAY"), F.min("ts") + F.expr("INTERVAL 3 DAY")).first()
    return ca.run_filter(t.events, "ts", since, until, {"event_type": "error", "user_id": None}).select("event_id")


@query("SELECT l_partkey AS use, l_returnflag, list_sort(list(DISTINCT l_orderkey)) AS users FROM lineitem GROUP BY 1, 2")
def a30_used_by(t: Tables) -> DataFrame:
    users = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_partkey").alias("uses"))
    return ca.used_by(users, "l_orderkey", "l_returnflag", "uses")


@query("""
    SELECT p_partkey, CASE WHEN p_size > 10 THEN 'p_size: ' || p_size || '; ' ELSE '' END || 'p_name: ' || p_name || '; p_brand: ' || p_brand AS text,
           'Parts > 1 | p_partkey=' || p_partkey || ', p_brand=' || p_brand || ' | p_name: ' || p_name AS retrieval,
           CASE WHEN p_size > 10 THEN length('p_size: ' || p_size || '; ') ELSE 0 END + 8 AS char_start, CASE WHEN p_size > 10 THEN length('p_size: ' || p_size || '; ') ELSE 0 END + 8 + length(p_name) AS char_end FROM part""")
def i6_row_units(t: Tables) -> DataFrame:
    rows = t.part.withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size")))
    out = ca.row_units(rows, "p_partkey", "Parts > 1", ["p_size", "p_name", "p_brand"], ["p_partkey"], ["p_brand"], "p_name")
    return out.withColumns({c: F.col(c).cast("long") for c in ("char_start", "char_end")})


@query("""
    WITH s AS (SELECT string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS l FROM orders)
    SELECT 'orders' AS sheet, 'Table ''orders'' in Sales: ' || (SELECT count(*) FROM orders) || ' data rows. Columns: o_orderkey (identifier); o_orderstatus (categorical: ' || l || '); o_comment (free text).' AS summary FROM s""")
def i7_table_summary(t: Tables) -> DataFrame:
    levels = t.orders.agg(F.array_sort(F.collect_set("o_orderstatus")).alias("levels"), F.count(F.lit(1)).alias("n_rows")).withColumn("sheet", F.lit("orders"))
    role = lambda at, name, kind, own: levels.select("sheet", F.lit(at).alias("at"), F.lit(name).alias("name"), F.lit(kind).alias("role"), (F.col("levels") if own else F.expr("cast(array() as array<string>)")).alias("levels"))
    profile = role(0, "o_orderkey", "identifier", False).union(role(1, "o_orderstatus", "context", True)).union(role(2, "o_comment", "free_text", False))
    return ca.table_summary(profile, "sheet", "name", "role", "levels", "at", levels.select("sheet", "n_rows"), "Sales")


@query("SELECT doc_id, source || CASE WHEN lang = 'en' THEN '' ELSE ' > ' || lang END || chr(10) || text AS sent FROM documents WHERE source <> '' AND lang <> ''")
def i9_embedding_input(t: Tables) -> DataFrame:
    docs = t.documents.where("source <> '' AND lang <> ''")
    heading = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return docs.select("doc_id", ca.embedding_input(F.col("source"), heading, F.col("text")).alias("sent")).where("sent IS NOT NULL")


@query(r"""
    WITH b AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS k, length(text) // 2 AS s, length(text) // 2 + 5 AS e FROM documents WHERE text IS NOT NULL),
         w AS (SELECT *, CAST(floor(40 * n / greatest(k, 1)) AS BIGINT) AS width FROM b), l AS (SELECT *, greatest(0, (s + e) // 2 - width // 2) AS l0 FROM w), r AS (SELECT *, least(n, l0 + width) AS r0 FROM l),
         c AS (SELECT *, least(greatest(0, r0 - width), s) AS a, greatest(r0, e) AS z FROM r),
         o AS (SELECT *, a - length(regexp_extract(substr(text, 1, a), '\S*$')) AS lo, z + length(regexp_extract(substr(text, z + 1), '^\S*')) AS hi FROM c)
    SELECT doc_id, CASE WHEN k <= 40 THEN text ELSE regexp_replace(regexp_replace(substr(text, lo + 1, hi - lo), '^\s+', ''), '\s+$', '') END AS shown, CASE WHEN k > 40 THEN lo END AS lo, CASE WHEN k > 40 THEN hi END AS hi FROM o""")
def r26_anchor_window(t: Tables) -> DataFrame:
    docs = t.documents.where("text IS NOT NULL").withColumn("k", F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).withColumn("s", F.floor(F.length("text") / 2).cast("int"))
    w = docs.select("doc_id", ca.anchor_window(F.col("text"), F.col("k"), F.col("s"), F.col("s") + 5, 40).alias("w"))
    return w.select("doc_id", F.col("w.window").alias("shown"), F.col("w.lo").cast("long").alias("lo"), F.col("w.hi").cast("long").alias("hi"))


@query(r"""
    WITH d AS (SELECT doc_id, text, regexp_replace(substr(text, 21, 40), '^\s+|\s+$', '', 'g') AS quote FROM documents)
    SELECT doc_id, instr(text, quote) - 1 AS char_start, instr(text, quote) - 1 + length(quote) AS char_end FROM d WHERE quote <> '' AND doc_id % 2 = 0
    UNION ALL SELECT doc_id, NULL, NULL FROM d WHERE quote <> '' AND doc_id % 2 <> 0""")
def r27_quote_span(t: Tables) -> DataFrame:
    """Quotes with other white space than their documents; those of odd ids have a word that no document has."""
    odd = F.when(F.col("doc_id") % 2 == 0, "").otherwise(" zq\\Ezq")
    docs = t.documents.withColumn("quote", F.regexp_replace(F.substring("text", 21, 40), r"\A\s+|\s+\z", "")).where("quote <> ''")
    quote = F.concat(F.lit(" \n"), F.regexp_replace("quote", r"\s+", " \t"), odd)
    span = docs.select("doc_id", ca.quote_span(F.col("text"), quote).alias("s"))
    return span.select("doc_id", F.col("s.char_start").cast("long").alias("char_start"), F.col("s.char_end").cast("long").alias("char_end"))


@query("SELECT user_id, greatest(max(event_id) - 5, CASE WHEN count(*) >= 20 THEN min(event_id) ELSE max(event_id) END) AS cursor FROM events GROUP BY 1")
def x12_next_cursor(t: Tables) -> DataFrame:
    polls = t.events.groupBy("user_id").agg(F.max("event_id").alias("latest"), F.min("event_id").alias("seen"), F.count(F.lit(1)).alias("n"))
    return polls.select("user_id", ca.next_cursor(F.col("latest") - 5, F.col("seen"), F.col("latest"), F.col("n"), 20).alias("cursor"))


@query("SELECT conv_id, turn, list(turn * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def x11_recent_questions(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn").distinct().withColumn("q", F.col("turn") * 10)
    return ca.recent(turns, "conv_id", "turn", "q").select("conv_id", "turn", "recent")


@query(r"""
    WITH RECURSIVE u AS (SELECT doc_id, unnest(range(len(p))) AS i, len(regexp_extract_all(unnest(p), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS p FROM documents)),
         g AS (SELECT doc_id, i, n AS used, 0 AS block FROM u WHERE i = 0
               UNION ALL SELECT u.doc_id, u.i, CASE WHEN used > 0 AND used + n > 50 THEN n ELSE used + n END, block + CASE WHEN used > 0 AND used + n > 50 THEN 1 ELSE 0 END FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i + 1)
    SELECT doc_id, block, max(used) AS n_tokens FROM g GROUP BY 1, 2""")
def i4_blocks(t: Tables) -> DataFrame:
    """Words as units of blocks of 50 tokens."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    units = t.documents.select("doc_id", F.transform(words, pk.n_tokens).alias("sizes"))
    return pk.block_sizes(units, "doc_id", "sizes", 50).withColumnRenamed("size", "n_tokens")


@query("SELECT query_id, doc_id FROM (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(regexp_extract(text, '\\S+\\s+\\S+$')), '[\\p{L}\\p{N}]+')) AS w FROM documents WHERE doc_id % 50 = 0) JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS d FROM documents) ON list_has_all(d, list_filter(w, lambda x: x NOT IN (STOP))) AND len(list_filter(w, lambda x: x NOT IN (STOP))) > 0".replace("STOP", ", ".join(f"'{w}'" for w in re_.STOPWORDS)))
def r10_all_terms(t: Tables) -> DataFrame:
    """The last two words of the documents whose id is divisible by 50 as queries."""
    queries = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", r"\S+\s+\S+$", 0).alias("text"))
    return re_.all_terms_lane(queries, t.documents, "doc_id", "text")


@query("""
    SELECT query_id, o_orderkey, place FROM (SELECT query_id, o_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY o_orderpriority = '1-URGENT', rank) AS place
    FROM (SELECT o_custkey AS query_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)) WHERE place <= 8""")
def r32_fallback_list(t: Tables) -> DataFrame:
    from .record_queries import _ranked

    return re_.fallback_list(_ranked(t), F.col("o_orderpriority") == "1-URGENT", "rank").select("query_id", "o_orderkey", "place")
