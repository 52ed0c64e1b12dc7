"""Queries of keyed state: the alias gate over conversations cut into deltas, and runs as they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.steps import shared_path
from ..queries import Tables, query
from ..streaming import keyed
from ..streaming.queue import JobQueue, drain

_ALIASES = ["E1", "E2", "E3", "R1"]
#: Texts of conversations as answers with markers: of evidence that is there, that is not, and malformed ones.
_ANSWERS = r"""
    a AS (SELECT conv_id * 10000 + turn AS answer_id, regexp_replace(coalesce(text, ''), '\. ', ' [E' || (turn + 1) || ']. ', 'g') || ' [R' || (conv_id % 3) || '][E' || conv_id || '] [E1[E' || (conv_id % 7 + 20) || ']] [E' AS answer FROM conversations),
    t AS (SELECT answer_id, regexp_extract_all(answer, '\[[ER][0-9]{0,4}\]|[^\[]+|\[') AS pieces FROM a),
    p AS (SELECT answer_id, pieces, i, pieces[i] AS x, length(pieces[i]) > 1 AND starts_with(pieces[i], '[') AS mark, substr(pieces[i], 2, length(pieces[i]) - 2) AS alias FROM t, generate_series(1, len(pieces)) AS g(i)),
    k AS (SELECT *, mark AND alias IN ('E1', 'E2', 'E3', 'R1') AS known, coalesce(i > 1 AND pieces[i - 1] = '[' OR i > 2 AND regexp_full_match(pieces[i - 1], '[ER][0-9]{0,5}') AND pieces[i - 2] = '[', false) AS begun FROM p)"""


def _answers(t: Tables) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"\. "), F.concat(F.lit(" [E"), (turn + 1).cast("string"), F.lit("]. ")))
    end = F.concat(F.lit(" [R"), (conv % 3).cast("string"), F.lit("][E"), conv.cast("string"), F.lit("] [E1[E"), (conv % 7 + 20).cast("string"), F.lit("]] [E"))
    return t.conversations.select((conv * 10000 + turn).alias("answer_id"), F.concat(body, end).alias("answer"), F.array(*map(F.lit, _ALIASES)).alias("aliases"))


@query(f"""
    WITH {_ANSWERS},
    e AS (SELECT answer_id, i, 0 AS j, CASE WHEN NOT mark OR known THEN 'text' WHEN length(alias) BETWEEN 2 AND 3 THEN 'unknown' ELSE 'malformed' END AS kind, x AS value FROM k
          UNION ALL SELECT answer_id, i, -1, 'citation', alias FROM k WHERE known AND list_position(pieces, x) = i
          UNION ALL SELECT answer_id, i, 1, 'text', ' ' FROM k WHERE mark AND NOT known AND begun),
    r AS (SELECT *, sum((kind <> 'text')::INT) OVER (PARTITION BY answer_id ORDER BY i, j) AS run FROM e),
    s AS (SELECT answer_id, run, kind, string_agg(value, '' ORDER BY i, j) AS value FROM r GROUP BY 1, 2, 3)
    SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY run, kind = 'text') - 1 AS place, kind, value FROM s""")
def x10_alias_gate(t: Tables) -> DataFrame:
    """Every answer in deltas of seven characters through the gate's keyed state; the SQL reads the whole answers."""
    cut = _answers(t).select("answer_id", "aliases", F.regexp_extract_all("answer", F.lit(r"(?s)(.{1,7})"), F.lit(1)).alias("parts"))
    deltas = cut.select("answer_id", "aliases", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "delta")).withColumn("last", F.col("seq") == F.col("n") - 1)
    return keyed.joined_texts(keyed.gate_deltas(deltas, "answer_id"), "answer_id")


@query(f"""
    WITH {_ANSWERS}
    SELECT answer_id, string_agg(CASE WHEN NOT mark OR known THEN x WHEN begun THEN ' ' ELSE '' END, '' ORDER BY i) AS shown, count(*) FILTER (mark AND NOT known) AS n_removed,
           array_to_string(list_distinct(list_sort(list(alias) FILTER (known))), ',') AS cited
    FROM k GROUP BY 1""".replace("array_to_string(list_distinct(list_sort(list(alias) FILTER (known))), ',')", "coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias) FILTER (known), '')"))
def x10_gated_text(t: Tables) -> DataFrame:
    got = keyed.gate_text(_answers(t), "answer", "aliases")
    return got.select("answer_id", "shown", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.array_sort("cited"), ",").alias("cited"))


_SLOT, _DEADLINE = 3_600_000, 15 * 86_400_000
_RUNS = f"""
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'token' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'step' END ELSE 'step' END AS type, event_id::VARCHAR || ' ' AS payload, epoch_us(ts) // 1000 AS at_ms FROM events),
    b AS (SELECT *, min(at_ms) OVER (PARTITION BY user_id) + {_DEADLINE} AS due, min(CASE WHEN type = 'done' THEN seq END) OVER (PARTITION BY user_id) AS stop FROM e),
    live AS (SELECT * FROM b WHERE at_ms < due AND (stop IS NULL OR seq <= stop)),
    walk AS (SELECT user_id, seq, type, payload, at_ms, CASE WHEN type = 'token' THEN at_ms END AS since, seq AS part FROM live WHERE seq = 0
             UNION ALL SELECT l.user_id, l.seq, l.type, l.payload, l.at_ms, CASE WHEN l.type <> 'token' THEN NULL WHEN w.since IS NOT NULL AND l.at_ms < w.since + {_SLOT} THEN w.since ELSE l.at_ms END,
                              CASE WHEN l.type = 'token' AND w.since IS NOT NULL AND l.at_ms < w.since + {_SLOT} THEN w.part ELSE l.seq END FROM walk w JOIN live l ON l.user_id = w.user_id AND l.seq = w.seq + 1),
    g AS (SELECT user_id, part, type, string_agg(payload, '' ORDER BY seq) AS payload, min(at_ms) AS at_ms, count(*) AS n_joined FROM walk GROUP BY 1, 2, 3),
    o AS (SELECT user_id, any_value(due) AS due FROM live GROUP BY 1 HAVING count(*) FILTER (type = 'done') = 0),
    u AS (SELECT user_id, part, type, payload, at_ms, n_joined FROM g UNION ALL SELECT user_id, 1099511627776, 'done', '{{"termination_state": "interrupted", "flags": ["RUN_INTERRUPTED"]}}', due, 1 FROM o)"""


def _runs(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "token").when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "done").otherwise("step")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", (F.row_number().over(w) - 1).alias("seq"), kind.alias("type"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("payload"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"{_RUNS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY part) - 1 AS seq, type, payload, at_ms, n_joined FROM u")
def x3_stored_runs(t: Tables) -> DataFrame:
    """Events of users as runs: tokens of an hour joined, one end for each run, orphans interrupted at their deadline."""
    return keyed.run_log(_runs(t), "user_id", _SLOT, _DEADLINE).select("user_id", "seq", "type", "payload", F.unix_millis("ts").alias("at_ms"), "n_joined")


@query(f"{_RUNS} SELECT user_id, at_ms FROM u WHERE type = 'done' AND contains(payload, 'interrupted')")
def x5_interrupted(t: Tables) -> DataFrame:
    got = keyed.run_log(_runs(t), "user_id", _SLOT, _DEADLINE).where("type = 'done' AND contains(payload, 'interrupted')")
    return got.select("user_id", F.unix_millis("ts").alias("at_ms"))


@query("""
    WITH v AS (SELECT doc_id AS version_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents WHERE doc_id % 7 <> 3)
    SELECT version_id, CASE WHEN len(words) = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN len(words) > 0 THEN len(words) END AS n_words FROM v""")
def x9_job_queue(t: Tables) -> DataFrame:
    """All documents as versions sent three times over in small files, some of them not queued; each is processed once.

    A message names its version; the work reads the texts.
    """
    spark, docs = t.documents.sparkSession, t.documents
    home = shared_path(spark, "queue")
    sent = docs.select(F.col("doc_id").alias("version_id"), F.when(F.col("doc_id") % 7 == 3, "ready").otherwise("queued").alias("status"))
    sent.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).repartition(6).write.parquet(f"{home}/in")
    counted = docs.select(F.col("doc_id").alias("version_id"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))

    def work(todo: DataFrame) -> DataFrame:
        return todo.select("version_id").join(counted, "version_id").where("n_words > 0").withColumn("status", F.lit("ready"))

    ledger = JobQueue(f"{home}/ledger", ["version_id"])
    stream = spark.readStream.schema("version_id long, status string, copy int").option("maxFilesPerTrigger", 3).parquet(f"{home}/in")
    drain(stream, ledger, work, f"{home}/checkpoint").awaitTermination()
    return ledger.states(spark).join(ledger.results(spark).select("version_id", "n_words"), "version_id", "left").select("version_id", "status", "n_words")
