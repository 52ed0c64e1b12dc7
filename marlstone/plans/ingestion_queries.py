"""Queries of ingestion on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingestion as ing
from ..operators import layout
from ..queries import Tables, query
from ..sources import tabular


@query("""
    WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(ceil((n - 32) / 160.0) AS BIGINT)) END AS windows FROM n""")
def i5_overlapping_windows(t: Tables) -> DataFrame:
    spans = ing.token_spans(t.documents, "doc_id", "text")
    counts = ing.windows(spans, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"))
    return t.documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("windows", F.lit(0)).cast("long").alias("windows"))


@query("""
    WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents WHERE doc_id % 10 < 3)
    SELECT doc_id, greatest(1, CAST(ceil((n - 32) / 160.0) AS BIGINT)) AS bad FROM n WHERE n > 0""")
def i8_span_contract(t: Tables) -> DataFrame:
    """Windows of all documents, spoiled in three of ten: beyond the end, empty, or before the begin; those and no others are told."""
    spans = ing.windows(ing.token_spans(t.documents, "doc_id", "text"), "doc_id")
    k = F.col("doc_id") % 10
    spoiled = spans.withColumn("char_end", F.when(k == 0, F.col("char_end") + 10_000_000).when(k == 1, F.col("char_start")).otherwise(F.col("char_end"))).withColumn("char_start", F.when(k == 2, F.col("char_start") - 10_000_000).otherwise(F.col("char_start")))
    return ing.bad_spans(spoiled, t.documents, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("bad"))


@query("SELECT min(doc_id) AS upload_id, sha256(text) AS digest FROM documents GROUP BY text HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def s15_fresh_uploads(t: Tables) -> DataFrame:
    """Upload registration: contents that live versions lack, once each."""
    live = t.documents.where("source = 'src0'").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return ing.fresh_uploads(t.documents.select(F.col("doc_id").alias("upload_id"), "text"), live, "text").select("upload_id", "digest")


@query("SELECT doc_id, len(string_split_regex(trim(regexp_replace(text, '[ \\t]*\\n\\s*\\n', chr(1), 'g')), chr(1))) AS blocks FROM documents WHERE length(trim(text)) > 0")
def s11b_plain_sections(t: Tables) -> DataFrame:
    blocks = tabular.sections(t.documents, "doc_id", "text", markdown=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))
    return blocks


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def i14_purge(t: Tables) -> DataFrame:
    gone = t.documents.where("source IN ('src1', 'src2')").select("source").distinct()
    return ing.purge(t.documents, gone, ["source"]).select("doc_id")


@query("SELECT o_custkey AS source, max(o_orderkey) AS version FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def i13_activation(t: Tables) -> DataFrame:
    """The newest ready version of each source becomes current."""
    versions = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    sources = versions.select("source").distinct().withColumn("current_version", F.lit(None).cast("long"))
    return ing.activate(sources, versions.where("o_orderstatus IN ('F', 'O')")).where("current_version IS NOT NULL").select("source", F.col("current_version").alias("version"))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def i12_health_sample(t: Tables) -> DataFrame:
    return ing.health_sample(t.documents, "doc_id", 25).select("doc_id")


@query("SELECT count(DISTINCT sha256('m' || chr(0) || text)) - (SELECT count(DISTINCT text) FROM documents WHERE lang = 'en') AS n FROM documents")
def i11_missing_embeddings(t: Tables) -> DataFrame:
    d = t.documents
    cache = d.where("lang = 'en'").select(F.sha2(F.concat_ws("\u0000", F.lit("m"), F.col("text")), 256).alias("digest"))
    return ing.missing_embeddings(d, cache, "m", "text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, substr(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', '-', 'g'), '-'), 1, 32) AS code FROM part")
def i16_source_code(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ing.source_code(F.concat(F.col("p_name"), F.lit(".csv"))).alias("code"))


_LINES = """
    t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
    l AS (SELECT doc_id, line // 30 AS page, line, CASE WHEN line % 5 = 2 THEN '- ' ELSE '' END || trim(raw) AS text, CASE WHEN line % 17 = 0 THEN 18.0 WHEN line % 11 = 4 THEN 13.0 WHEN line % 29 = 9 THEN 7.0 ELSE 10.0 END AS size, line * 12.0 + line // 3 * 6.0 AS top, line * 12.0 + line // 3 * 6.0 + 11.0 AS bottom FROM t)"""


@query(f"""
    WITH {_LINES}, x AS (SELECT * FROM l WHERE trim(text) <> ''),
    z AS (SELECT doc_id, size, sum(length(text)) AS n, min(line) AS first FROM x GROUP BY 1, 2), b AS (SELECT doc_id, arg_min(size, (-n, first)) AS body FROM z GROUP BY 1),
    k AS (SELECT x.*, body, size - body >= 2 AND length(text) <= 160 AS head, size - body >= 5 AND length(text) <= 160 AS big, starts_with(text, '- ') AND NOT (size - body >= 2 AND length(text) <= 160) AS item FROM x JOIN b USING (doc_id) WHERE size - body > -2),
    g AS (SELECT *, lag(bottom) OVER p AS low, lag(head) OVER p AS after FROM k WINDOW p AS (PARTITION BY doc_id, page ORDER BY line)),
    s AS (SELECT *, NOT head AND (item OR low IS NULL OR after OR top - low > 0.45 * body) AS starts FROM g),
    u AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, page ORDER BY line) AS unit, sum(head::INT) OVER (PARTITION BY doc_id, page ORDER BY line) AS block,
                 max(CASE WHEN head THEN line END) OVER w AS hl, max(CASE WHEN big THEN line END) OVER w AS tl, min(CASE WHEN head AND NOT big THEN line END) OVER w AS sl FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    v AS (SELECT doc_id, page, block, unit, min(line) AS first, max(hl) AS hl, max(tl) AS tl, max(sl) AS sl, bool_or(item AND starts) AS is_item, string_agg(CASE WHEN item THEN trim(substr(text, 3)) ELSE text END, ' ' ORDER BY line) AS text FROM u WHERE NOT head GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, is_item AND NOT coalesce(lag(is_item) OVER (PARTITION BY doc_id, page, block ORDER BY first), false) AS fresh FROM v)
    SELECT r.doc_id, r.page, row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY first) AS unit, CASE WHEN is_item THEN 'item' ELSE 'paragraph' END AS kind, CASE WHEN is_item THEN sum(fresh::INT) OVER (PARTITION BY r.doc_id ORDER BY first) END AS list_run,
           CASE WHEN hl IS NULL THEN '' WHEN hl = tl OR coalesce(tl, CASE WHEN sl < hl THEN sl END) IS NULL THEN h.text ELSE o.text || ' > ' || h.text END AS heading_path, r.text
    FROM r LEFT JOIN l h ON h.doc_id = r.doc_id AND h.line = hl LEFT JOIN l o ON o.doc_id = r.doc_id AND o.line = coalesce(tl, sl)""")
def i17_layout(t: Tables) -> DataFrame:
    """Lines of documents as laid-out pages, their sizes and gaps by line number."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    n = F.col("line")
    top = n * 12.0 + F.floor(n / 3) * 6.0
    size = F.when(n % 17 == 0, 18.0).when(n % 11 == 4, 13.0).when(n % 29 == 9, 7.0).otherwise(10.0)
    text = F.concat(F.when(n % 5 == 2, "- ").otherwise(""), F.trim("raw"))
    made = lines.select("doc_id", F.floor(n / 30).alias("page"), "line", text.alias("text"), size.alias("size"), top.alias("top"), (top + 11.0).alias("bottom"))
    return layout.layout(made, "doc_id").withColumn("heading_path", F.array_join("heading_path", " > "))


@query("""
    WITH h AS (SELECT o_custkey, list('WS/C' || (o_orderkey % 50) || '@v' || (1 + o_orderkey % 3) || ':P1' ORDER BY o_orderkey) AS handles FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN len(list_filter(handles, lambda x: regexp_matches(x, '^WS/C[0-4]@v2:'))) > 0 THEN '[source deleted]' ELSE 'told ' || o_custkey END AS text FROM h""")
def i14_redacted(t: Tables) -> DataFrame:
    """Answers of customers that cite a purged version of one of five sources lose their text."""
    handle = F.concat(F.lit("WS/C"), (F.col("o_orderkey") % 50).cast("string"), F.lit("@v"), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit(":P1"))
    told = t.orders.groupBy("o_custkey").agg(F.collect_set(handle).alias("handles")).withColumn("text", F.concat(F.lit("told "), F.col("o_custkey").cast("string")))
    gone = t.orders.select(F.concat(F.lit("C"), (F.col("o_orderkey") % 5).cast("string")).alias("source"), F.lit(2).alias("version")).distinct()
    return ing.redact(told, "o_custkey", "handles", gone, "text").select("o_custkey", "text")


@query("""
    WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_transform(k, lambda x, i: CASE WHEN p[i] IN ('1-URGENT', '5-LOW') THEN x || '|' || p[i] || '||true' ELSE x || '|' || p[i] || '|order ' || x || '|false' END), ';') AS cards FROM c""")
def i15_cards(t: Tables) -> DataFrame:
    """Citation cards of customers in the order of their orders; those of two sources become tombstones."""
    k = F.col("o_orderkey").cast("string")
    card = F.struct(F.col("o_orderkey").alias("at"), F.struct(k.alias("handle"), F.col("o_orderpriority").alias("source_code"), F.concat(F.lit("order "), k).alias("title")).alias("card"))
    cards = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(card)), lambda c: c["card"]).alias("cards"))
    left = ing.tombstoned(F.col("cards"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    text = F.transform(left, lambda c: F.concat(c["handle"], F.lit("|"), c["source_code"], F.lit("|"), F.coalesce(c["title"], F.lit("")), F.lit("|"), c["purged"].cast("string")))
    return cards.select("o_custkey", F.array_join(text, ";").alias("cards"))
