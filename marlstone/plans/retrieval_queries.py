"""Queries of retrieval: benchmark items are the queries, documents and embeddings the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.stemming import STOP_WORDS, stem_sql
from ..operators import evidence, lexical
from ..operators import retrieval as re_
from ..operators import search as se
from ..queries import Tables, query

_WORDS = r"[\p{L}\p{N}]+"
#: Lexemes of texts with their places in SQL: t has (id, text) of both sides, voc stems each word once.
_STEMMED = f"""
    docs AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS text FROM documents),
    quer AS (SELECT item_id AS query_id, lower(left(nfc_normalize(text || ' "' || regexp_extract(text, '\\S+\\s+\\S+\\s+\\S+$') || '"'), 1000)) AS text FROM benchmark),
    dtok AS (SELECT id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS at_ FROM (SELECT id, regexp_extract_all(text, '{_WORDS}') AS w FROM docs)),
    qtok AS (SELECT query_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS at_ FROM (SELECT query_id, regexp_extract_all(text, '{_WORDS}') AS w FROM quer)),
    voc AS MATERIALIZED (SELECT w, CASE WHEN NOT regexp_full_match(w, '\\p{{L}}+') THEN w WHEN w IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) THEN NULL ELSE {stem_sql("w")} END AS lexeme
                         FROM (SELECT w FROM dtok UNION SELECT w FROM qtok)),
    place AS MATERIALIZED (SELECT id, lexeme, at_ FROM dtok JOIN voc USING (w) WHERE lexeme IS NOT NULL),
    p AS MATERIALIZED (SELECT id AS doc_id, lexeme, count(*) AS n_at FROM place GROUP BY 1, 2),
    len AS (SELECT doc_id, sum(n_at) AS n_places FROM p GROUP BY 1),
    q AS MATERIALIZED (SELECT DISTINCT query_id, lexeme FROM qtok JOIN voc USING (w) WHERE lexeme IS NOT NULL),
    f AS (SELECT lexeme, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)"""
_LEXICAL = f"""{_STEMMED},
    tt AS (SELECT query_id, lexeme, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, coalesce(df, 0) / n <= 0.9 AS rare FROM q LEFT JOIN f USING (lexeme), n),
    ph AS (SELECT query_id, j, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT query_id, j, regexp_extract_all(ps[j], '{_WORDS}') AS w FROM (SELECT query_id, list_distinct(regexp_extract_all(text, '"([^"]{{2,200}})"', 1)) AS ps FROM quer), generate_series(1, len(ps)) AS g(j))),
    pl AS (SELECT query_id, j, k, lexeme, count(*) OVER (PARTITION BY query_id, j) AS size FROM ph JOIN voc USING (w) WHERE lexeme IS NOT NULL),
    pq AS (SELECT query_id, id AS doc_id, count(DISTINCT j) AS phrases FROM (SELECT query_id, j, id, at_ - k AS shift FROM pl JOIN place USING (lexeme) GROUP BY query_id, j, size, id, at_ - k HAVING count(*) = size) GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, round(sum(idf) + 2 * coalesce(any_value(phrases), 0), 9) AS score, sum(n_at) AS places FROM (SELECT *, max(rare) OVER (PARTITION BY query_id) AS anyr FROM tt) x JOIN p USING (lexeme) LEFT JOIN pq USING (query_id, doc_id) WHERE rare OR NOT anyr GROUP BY 1, 2),
    lex AS (SELECT query_id, doc_id, score, round(0.1 * places / ln(n_places + 1), 9) AS tiebreak, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(0.1 * places / ln(n_places + 1), 9) DESC, doc_id) AS rank FROM s JOIN len USING (doc_id))"""
_DENSE = """
    qv AS (SELECT item_id AS query_id, embedding AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
    ds AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, qv),
    den AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""


def _queries(t: Tables) -> DataFrame:
    """All benchmark items as queries, their last three words once more as a quoted phrase."""
    text = F.concat(F.col("text"), F.lit(' "'), F.regexp_extract("text", r"\S+\s+\S+\s+\S+$", 0), F.lit('"'))
    return t.benchmark.select(F.col("item_id").alias("query_id"), text.alias("text"))


def _index(t: Tables) -> lexical.LexicalIndex:
    return lexical.index_of(t.documents, "doc_id", "text")


def _lexical(t: Tables, k: int) -> DataFrame:
    return lexical.lexical_lane(_queries(t), _index(t), k)


def _dense(t: Tables, k: int) -> DataFrame:
    """Benchmark items that have a vector against all vectors, taken as those of the documents of the same number."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return re_.dense_lane(queries, vectors, "doc_id", "embedding", k)


@query(f"WITH {_STEMMED} SELECT query_id, string_agg(lexeme, ' ' ORDER BY lexeme) AS lexemes FROM q GROUP BY 1")
def r3_query_lexemes(t: Tables) -> DataFrame:
    got = lexical.analysed(lexical.normalised_queries(_queries(t)), ["query_id"], "text")
    return got.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("lexeme")), " ").alias("lexemes"))


@query(f"WITH {_STEMMED} SELECT lexeme, df FROM f")
def r4_document_frequencies(t: Tables) -> DataFrame:
    return _index(t).frequencies()


@query(f"WITH {_STEMMED} SELECT lexeme, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM f, n")
def r5_idf(t: Tables) -> DataFrame:
    index = _index(t)
    return index.frequencies().crossJoin(F.broadcast(index.size())).select("lexeme", F.round(cells.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"WITH {_LEXICAL} SELECT query_id, doc_id, round(score, 6) AS score, round(tiebreak, 6) AS tiebreak, rank FROM lex WHERE rank <= 10")
def r7_lexical_lane(t: Tables) -> DataFrame:
    return _lexical(t, 10).withColumns({"score": F.round("score", 6), "tiebreak": F.round("tiebreak", 6)})


@query(f"""
    WITH {_STEMMED}, want AS (SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS m FROM (SELECT DISTINCT query_id, lexeme FROM (SELECT *, max(at_) OVER (PARTITION BY query_id) AS last FROM qtok) JOIN voc USING (w) WHERE at_ > last - 3 AND lexeme IS NOT NULL)),
    h AS MATERIALIZED (SELECT query_id, id AS doc_id, m, lexeme, at_ FROM want JOIN place USING (lexeme)),
    g AS (SELECT query_id, doc_id FROM h GROUP BY query_id, doc_id, m HAVING count(DISTINCT lexeme) = m),
    e AS MATERIALIZED (SELECT h.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY at_) AS no FROM h SEMI JOIN g USING (query_id, doc_id)),
    z AS (SELECT e.query_id, e.doc_id, e.at_ AS e, e.no AS last_no, w.lexeme, e.m FROM e JOIN (SELECT DISTINCT query_id, lexeme FROM want) w USING (query_id)),
    l AS (SELECT z.query_id, z.doc_id, z.e, any_value(z.last_no) AS last_no, min(e.at_) AS b, min(e.no) AS first_no FROM z ASOF JOIN e ON z.query_id = e.query_id AND z.doc_id = e.doc_id AND z.lexeme = e.lexeme AND z.e >= e.at_ GROUP BY z.query_id, z.doc_id, z.e, z.m HAVING count(*) = z.m),
    x AS (SELECT query_id, doc_id, b, e, last_no - first_no + 1 AS entries FROM l QUALIFY coalesce(b > lag(b) OVER (PARTITION BY query_id, doc_id ORDER BY e), true)),
    d AS (SELECT query_id, doc_id, round(sum(0.1 / (1 + (e - b) - (entries - 1))) / ln(any_value(n_places) + 1), 9) AS density FROM x JOIN len USING (doc_id) GROUP BY 1, 2)
    SELECT query_id, doc_id, round(density, 6) AS density, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, doc_id) AS rank FROM d) WHERE rank <= 10""")
def r9_cover_density(t: Tables) -> DataFrame:
    """The last three words of all benchmark items, all of them wanted, by minimal covers."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"\S+\s+\S+\s+\S+$", 0).alias("text"))
    return lexical.all_lexemes_lane(queries, _index(t), 10).withColumn("density", F.round("density", 6))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
         s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def r11_dense_lane(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return re_.dense_lane(q, t.embeddings, "vec_id", "embedding", 10)


@query(f"""
    WITH {_LEXICAL}, {_DENSE},
    u AS (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank FROM den WHERE rank <= 30),
    r AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM u GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 9) AS score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS fused_rank FROM r""")
def r13_rank_fusion(t: Tables) -> DataFrame:
    fused = re_.fuse({"lexical": _lexical(t, 30), "dense": _dense(t, 30)}, "doc_id")
    return fused.withColumn("score", F.round("score", 9))


@query(f"""
    WITH {_LEXICAL}, c AS (SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS over FROM lex JOIN documents USING (doc_id) WHERE rank <= 40)
    SELECT query_id, doc_id, pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, rank) AS pool_rank FROM c) WHERE pool_rank <= 24""")
def w4_pool_cap(t: Tables) -> DataFrame:
    ranked = _lexical(t, 40).join(t.documents.select("doc_id", "source"), "doc_id")
    return re_.cap_per_source(ranked, "source", "rank", 2, 24).select("query_id", "doc_id", F.col("pool_rank"))


@query(f"""
    WITH RECURSIVE {_LEXICAL}, c AS MATERIALIZED (SELECT query_id, doc_id, rank, (n_chars + 3) // 4 AS tokens FROM lex JOIN documents USING (doc_id) WHERE rank <= 24),
    walk AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, 0::BIGINT AS used, 0::BIGINT AS items, false AS kept FROM c GROUP BY 1
             UNION ALL SELECT c.query_id, c.rank, c.doc_id, used + CASE WHEN items < 12 AND used + tokens <= 1500 THEN tokens ELSE 0 END, items + CASE WHEN items < 12 AND used + tokens <= 1500 THEN 1 ELSE 0 END, items < 12 AND used + tokens <= 1500 FROM walk w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1)
    SELECT query_id, doc_id, items - 1 AS pack_rank FROM walk WHERE kept""")
def w7_evidence_pack(t: Tables) -> DataFrame:
    ranked = _lexical(t, 24).join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("tokens", F.ceil(F.col("n_chars") / 4))
    return re_.evidence_pack(ranked, "doc_id", "rank", "tokens", most_tokens=1500)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'apache license') AND contains(lower(text), 'the')")
def r20_keyword_search(t: Tables) -> DataFrame:
    return re_.keyword_search(t.documents, ["Apache  License", "the", "apache license"], "text", "all").select("doc_id", "source")


@query("SELECT item_id, trim(regexp_replace('  ' || text || '\t x\n', '\\s+', ' ', 'g')) AS flat FROM benchmark")
def i1_collapsed(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", cells.collapsed(F.concat(F.lit("  "), "text", F.lit("\t x\n"))).alias("flat"))


_SEARCH = f"""
    WITH {_LEXICAL}, {_DENSE},
    u AS (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM den WHERE rank <= 40),
    r AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM u GROUP BY 1, 2),
    fu AS (SELECT r.*, source, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS fused_rank FROM r JOIN documents USING (doc_id)),
    po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, fused_rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY fused_rank) > 4 AS over FROM fu)),
    od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 24 THEN place ELSE 1000 + fused_rank END) AS pos FROM po),
    cp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over3, pos) AS fin FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) > 3 AS over3 FROM od)),
    fl AS (SELECT *, fin <= 10 AS head, list_position(['de', 'es'], lang) AS want, row_number() OVER (PARTITION BY query_id, lang ORDER BY fin) AS nth FROM cp),
    mk AS (SELECT *, head AND NOT (coalesce(want, 0) > 0 AND nth = 1) AS spare, NOT head AND coalesce(want, 0) > 0 AND nth = 1 AS fresh FROM fl),
    mv AS (SELECT *, least(sum(spare::INT) OVER (PARTITION BY query_id), sum(fresh::INT) OVER (PARTITION BY query_id)) AS moves, row_number() OVER (PARTITION BY query_id, spare ORDER BY fin DESC) AS s_no, row_number() OVER (PARTITION BY query_id, fresh ORDER BY want) AS f_no FROM mk)"""


@query(f"""{_SEARCH}
    SELECT query_id, doc_id, place <= 24 AS in_pool, fresh AND f_no <= moves AS promoted,
           row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN head AND NOT (spare AND s_no <= moves) THEN 0 WHEN fresh AND f_no <= moves THEN 1 ELSE 2 END, CASE WHEN fresh AND f_no <= moves THEN want ELSE fin END) AS rank
    FROM mv""")
def r15_search(t: Tables) -> DataFrame:
    """All benchmark items through lanes, fusion, pool, source caps and a floor for two languages."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = se.search(_queries(t).join(own, "query_id", "left"), t.documents, "doc_id", "source", "lang", se.SearchConfig(wanted_classes=("de", "es")), _index(t), vectors)
    return found.ranked.select("query_id", "doc_id", "in_pool", "promoted", "rank")


@query()
def r18_reranked(t: Tables) -> DataFrame:
    """The same with a scorer that counts shared words; the scorer is Python, so there is no SQL and the tests compare with plain sorting."""
    found = se.search(_queries(t), t.documents, "doc_id", "source", "lang", se.SearchConfig(use_dense=False, rerank=True), _index(t), scorer=se.overlap_scorer)
    return found.ranked.where("in_pool").select("query_id", "doc_id", "rerank_score", "rank")


def _units(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as units of their source, in the order of their ids, with two children each."""
    n = F.length(F.coalesce("text", F.lit("")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    units = t.documents.select("doc_id", "source", (F.col("doc_id") % 3 + 1).cast("int").alias("version"), place.alias("ordinal"), F.col("text"), n.alias("n"))
    units = units.withColumn("handle", F.concat(F.lit("WS/"), F.upper("source"), F.lit("@v"), F.col("version").cast("string"), F.lit(":P"), (F.col("doc_id") + 1).cast("string")))
    half = F.floor(F.col("n") / 2)
    spans = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("c1").alias("child"), F.lit(0).cast("long").alias("char_start"), half.alias("char_end")), F.struct(F.lit(2).alias("ordinal"), F.lit("c2").alias("child"), half.alias("char_start"), F.col("n").cast("long").alias("char_end")))
    return units, units.select("handle", "text", F.explode(spans).alias("c")).select("handle", "c.*", F.substr("text", (F.col("c.char_start") + 1).cast("int"), (F.col("c.char_end") - F.col("c.char_start")).cast("int")).alias("text"))


@query("""
    WITH u AS (SELECT doc_id, source, doc_id % 3 + 1 AS version, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, coalesce(text, '') AS text FROM documents),
         h AS (SELECT *, lag(text) OVER w AS p, lag(ordinal) OVER w AS po, lead(text) OVER w AS n, lead(ordinal) OVER w AS no FROM u WINDOW w AS (PARTITION BY source, version ORDER BY ordinal)),
         l AS (SELECT source, max(version) AS latest FROM u GROUP BY 1)
    SELECT doc_id, CASE WHEN version = 1 AND source < 'src2' THEN 'deleted' ELSE 'found' END AS state, CASE WHEN version = 1 AND source < 'src2' THEN NULL ELSE length(text) END AS n,
           CASE WHEN NOT (version = 1 AND source < 'src2') AND po = ordinal - 1 AND p <> '' THEN right(p, 200) END AS previous_excerpt, CASE WHEN NOT (version = 1 AND source < 'src2') AND no = ordinal + 1 AND n <> '' THEN left(n, 200) END AS next_excerpt,
           CASE WHEN NOT (version = 1 AND source < 'src2') THEN CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END END AS highlight, CASE WHEN NOT (version = 1 AND source < 'src2') THEN version = latest END AS is_latest
    FROM h JOIN l USING (source)""")
def r24_resolved(t: Tables) -> DataFrame:
    """The unit of every document by its handle, with its neighbours and one child marked; first versions of some sources are purged."""
    units, children = _units(t)
    versions = units.select("source", "version").distinct().withColumn("status", F.when((F.col("version") == 1) & (F.col("source") < "src2"), "purged").otherwise("ready"))
    upper = lambda df: df.withColumn("source", F.upper("source"))
    asked = units.select("doc_id", "handle", F.when(F.col("doc_id") % 2 == 0, "c1").otherwise("c2").alias("child"))
    own = units.withColumn("text", F.coalesce("text", F.lit("")))
    got = evidence.resolve(asked, "handle", upper(own), children, upper(versions), "child")
    return got.select("doc_id", "state", F.length("text").cast("long").alias("n"), "previous_excerpt", "next_excerpt", "highlight", "is_latest")


_TERMS = ["the", "licence", "apache  License"]


@query("""
    SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(text), 'the') OR contains(lower(text), 'licence') GROUP BY 1""")
def r20_counts_by_source(t: Tables) -> DataFrame:
    return evidence.counts_by_source(evidence.keyword_hits(_units(t)[0], _TERMS, "any"))


@query("""
    WITH u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, lower(coalesce(text, '')) AS low, 'WS/' || upper(source) || '@v' || (doc_id % 3 + 1) || ':P' || (doc_id + 1) AS handle FROM documents),
         m AS (SELECT *, contains(low, 'the')::INT + contains(low, 'licence')::INT + contains(low, 'apache license')::INT AS n_terms, substr(low, 1, length(low) // 2) AS one, substr(low, length(low) // 2 + 1) AS two FROM u),
         a AS (SELECT *, CASE WHEN contains(one, 'the') OR contains(one, 'licence') OR contains(one, 'apache license') THEN 'c1' WHEN contains(two, 'the') OR contains(two, 'licence') OR contains(two, 'apache license') THEN 'c2' ELSE 'c1' END AS anchor FROM m WHERE n_terms > 0)
    SELECT row_number() OVER (ORDER BY n_terms DESC, source, ordinal, handle) AS place, handle, source, n_terms, anchor FROM a QUALIFY place <= 50""")
def r20_first_hits(t: Tables) -> DataFrame:
    units, children = _units(t)
    return evidence.first_hits(evidence.keyword_hits(units, _TERMS, "any"), children, _TERMS, 50)


@query("""
    WITH i AS (SELECT l_partkey, l_linenumber AS rank, l_suppkey AS step, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
         g AS (SELECT l_partkey, min(rank) AS best_rank, min(step) AS first_step, min(seq) AS seq FROM i GROUP BY 1)
    SELECT l_partkey, best_rank, first_step FROM (SELECT *, row_number() OVER (ORDER BY best_rank, first_step, seq, l_partkey) AS place FROM g)""")
def w12_pool_order(t: Tables) -> DataFrame:
    """Parts as items of a pool: best line number, first supplier."""
    items = t.lineitem.select("l_partkey", F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("step"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return evidence.pool_order(items, "l_partkey").drop("place")
