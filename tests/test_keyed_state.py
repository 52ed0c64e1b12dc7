"""Keyed state in streams: any cut of a text gives the same events; runs end once, also after a restart."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import keyed

ALIASES = ["E1", "E12", "R1"]
PARTS = ["[", "]", "E", "R", "1", "12", "9", "[E1]", "[E12]", "[R1]", "[E99]", "[E123]", "[E12345]", "[E]", "[e1]", "word ", "é", "🙂", "\n", "[[WS/A@v1:P1]]", "x"]


def plain_gate(text, aliases=ALIASES):
    """Events of a whole text, one character after the other."""
    events, shown, cited, i = [], "", [], 0
    kept = ""  # all that was shown so far, markers too

    def flush():
        nonlocal shown
        if shown:
            events.append(("text", shown))
        shown = ""

    while i < len(text):
        m = re.compile(r"\[[ER]([0-9]{0,4})\]", re.A).match(text, i)
        if not m:
            shown, kept, i = shown + text[i], kept + text[i], i + 1
            continue
        alias, i = m[0][1:-1], m.end()
        if alias in aliases:
            if alias not in cited:
                flush()
                cited.append(alias)
                events.append(("citation", alias))
            shown, kept = shown + m[0], kept + m[0]
            continue
        flush()
        events.append(("unknown" if len(m[1]) in (1, 2) else "malformed", m[0]))
        if re.search(r"\[(?:[ER][0-9]*)?\Z", kept[-7:]):
            shown, kept = " ", kept + " "
    flush()
    return events


def deltas_of(rng, key, text):
    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.choice([0, 1, 3, 12])))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    return [(key, i, p, i == len(parts) - 1, ALIASES) for i, p in enumerate(parts)]


SCHEMA = "k string, seq int, delta string, last boolean, aliases array<string>"


def events_by_key(df):
    got = {}
    for r in keyed.joined_texts(df, "k").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.kind, r.value))
    return got


@pytest.fixture(scope="module")
def answers():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 8, 25]))) for _ in range(60)]
    return texts + ["[E1[E99]]", "[E12345[E99]6]", "[[E99][E98]E1]", "x [E99].", "[E1", "[", "no marks", "[E1][E1] [R1]", "a[E9]E1]"]


def test_any_cut_gives_the_events_of_the_whole(spark, answers):
    rng = random.Random(8)
    rows = [d for c in range(3) for i, t in enumerate(answers) for d in deltas_of(rng, f"{i}-{c}", t)]
    rng.shuffle(rows)
    rows += rng.sample(rows, 20)  # sent twice
    got = events_by_key(keyed.gate_deltas(spark.createDataFrame(rows, SCHEMA), "k"))
    for i, t in enumerate(answers):
        for c in range(3):
            assert got.get(f"{i}-{c}", []) == plain_gate(t), t


def test_whole_texts_by_expressions(spark, answers):
    df = spark.createDataFrame([(t, ALIASES) for t in [*answers, None, ""]], "t string, a array<string>")
    for r in keyed.gate_text(df, "t", "a").collect():
        events = plain_gate(r.t or "")
        assert r.shown == "".join(v for k, v in events if k == "text"), r.t
        assert r.removed == [v for k, v in events if k in ("unknown", "malformed")]
        assert r.cited == [v for k, v in events if k == "citation"]


def test_held_text_is_short():
    memory = {"held": "", "tail": "", "cited": [], "aliases": ["E1"], "place": 0, "next": 0, "ended": False}
    gate = keyed.AliasGate()
    for x in "some [E1234 more [E12] text [R99999] [":
        list(gate.step(memory, (x, False, None), None))
        assert len(memory["held"]) <= 6


def test_gate_in_a_stream_with_restart(spark, answers, tmp_path):
    """Deltas come in files out of order; the stream stops in the middle and goes on from its checkpoint."""
    rng = random.Random(21)
    rows = [d for i, t in enumerate(answers) for d in deltas_of(rng, f"{i}", t)]
    rng.shuffle(rows)
    half = len(rows) // 2
    keyed.keep_state(spark)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        q = keyed.gate_deltas(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        assert q.exception() is None

    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = events_by_key(spark.read.parquet(str(tmp_path / "out")))
    for i, t in enumerate(answers):
        assert got.get(f"{i}", []) == plain_gate(t), t


RUNS = "run_id long, seq long, type string, payload string, ms long"


def log_of(spark, rows):
    return spark.createDataFrame(rows, RUNS).select("run_id", "seq", "type", "payload", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"))


def stored(df):
    rows = df.select("run_id", "seq", "type", "payload", (F.unix_millis("ts") - 1_700_000_000_000).alias("ms"), "n_joined").collect()
    return sorted(tuple(r) for r in rows)


def plain_log(rows, slot, deadline):
    out = []
    for run in sorted({r[0] for r in rows}):
        own = {r[1]: r for r in rows if r[0] == run}
        due, text, since, n, k = None, None, None, 0, 0

        def put(type_, payload, ms, n):
            nonlocal k
            out.append((run, k, type_, payload, ms, n))
            k += 1

        def flush():
            nonlocal text, since, n
            if text is not None:
                put("token", text, since, n)
            text, since, n = None, None, 0

        ended, i = False, 0
        while i in own and not ended:
            _, _, type_, payload, ms = own[i]
            due = ms + deadline if due is None else due
            if ms >= due:
                break
            if type_ == "token":
                if since is not None and ms >= since + slot:
                    flush()
                since = ms if since is None else since
                text, n = (text or "") + payload, n + 1
            else:
                flush()
                put(type_, payload, ms, 1)
                ended = type_ == "done"
            i += 1
        if not ended and due is not None:
            flush()
            put("done", '{"termination_state": "interrupted", "flags": ["RUN_INTERRUPTED"]}', due, 1)
    return sorted(out)


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(13)
    rows = []
    for run in range(40):
        ms = rng.randrange(1000)
        for seq in range(rng.choice([1, 2, 6, 15])):
            type_ = rng.choice(["token", "token", "token", "step", "done"])
            rows.append((run, seq, type_, f"{seq},", ms))
            ms += rng.choice([0, 5, 30, 60, 99, 100, 101, 250])
        if run % 5 == 0:
            rows.append((run, seq + 2, "token", "behind a gap", ms))
    return rows


def test_runs_over_a_table(spark, runs):
    rng = random.Random(2)
    more = runs + rng.sample(runs, 10)
    rng.shuffle(more)
    assert stored(keyed.run_log(log_of(spark, more), deadline_millis=700)) == plain_log(runs, 100, 700)
    assert keyed.run_log(log_of(spark, [])).count() == 0


def test_deadlines_by_now(spark):
    rows = [(1, 0, "start", "", 0), (2, 0, "start", "", 500), (3, 0, "start", "", 0), (3, 1, "done", "", 5)]
    got = stored(keyed.run_log(log_of(spark, rows), deadline_millis=1000, now_millis=1_700_000_000_000 + 1200))
    assert [(r[0], r[2], r[4]) for r in got] == [(1, "start", 0), (1, "done", 1000), (2, "start", 500), (3, "start", 0), (3, "done", 5)]


def test_runs_in_a_stream_with_restart(spark, tmp_path):
    """Timers join tokens and end an orphan once, though the stream is stopped between its last event and its deadline."""
    keyed.keep_state(spark)
    # the last file of each part moves the watermark on
    parts = [
        [(1, 0, "start", "", 0), (1, 1, "token", "a", 10), (1, 2, "token", "b", 60), (2, 0, "start", "", 0), (2, 1, "token", "x", 20), (2, 2, "done", "", 40), (9, 0, "start", "", 200)],
        [(9, 1, "step", "", 30_000)],
        [(1, 3, "token", "late for its run", 40_000), (2, 3, "done", "", 41_000), (9, 2, "step", "", 42_000)],
        [(9, 3, "done", "", 90_000)],
    ]

    def run():
        stream = spark.readStream.schema("run_id long, seq long, type string, payload string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = keyed.run_log(stream, slot_millis=100, deadline_millis=5000, late="1 second")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        assert q.exception() is None

    for part in parts:
        log_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = [r for r in stored(spark.read.parquet(str(tmp_path / "out"))) if r[0] != 9]
    stop = '{"termination_state": "interrupted", "flags": ["RUN_INTERRUPTED"]}'
    assert got == [(1, 0, "start", "", 0, 1), (1, 1, "token", "ab", 10, 2), (1, 2, "done", stop, 5000, 1), (2, 0, "start", "", 0, 1), (2, 1, "token", "x", 20, 1), (2, 2, "done", "", 40, 1)]
    shutil.rmtree(tmp_path / "in")


def test_queue_takes_each_version_once(spark, tmp_path):
    """A batch sent twice, one cut after its results and one cut before its commit: each version has one result."""
    from marlstone.streaming.queue import JobQueue

    queue, worked = JobQueue(str(tmp_path / "q"), ["version", "attempt"]), []

    def batch(*rows):
        return spark.createDataFrame([(v, a, s, "x") for v, a, s in rows], "version long, attempt int, status string, text string")

    def work(todo):
        rows = todo.collect()
        worked.append(sorted((r.version, r.attempt) for r in rows))
        return todo.where("version <> 5").select("version", "attempt", F.lit("ready").alias("status"))

    def broken(todo):
        raise RuntimeError("the worker was lost")

    run = queue.step(work)
    first = batch((1, 0, "queued"), (1, 0, "queued"), (2, 0, "queued"), (3, 0, "ready"))
    run(first, 0)
    run(first, 0)
    assert worked == [[(1, 0), (2, 0)]]
    second = batch((2, 0, "queued"), (4, 0, "queued"), (5, 0, "queued"), (1, 1, "queued"))
    with pytest.raises(RuntimeError):
        queue.step(broken)(second, 1)
    queue._write(batch((4, 0, "ready")).select("version", "attempt", "status"), "results", 1)  # half of the results, no commit
    assert sorted(r.version for r in queue.results(spark).collect()) == [1, 2]
    run(second, 1)
    run(batch((4, 0, "queued"), (6, 0, "queued")), 2)
    assert worked[1:] == [[(1, 1), (4, 0), (5, 0)], [(6, 0)]]
    assert sorted((r.version, r.attempt) for r in queue.results(spark).collect()) == [(1, 0), (1, 1), (2, 0), (4, 0), (6, 0)]
    assert sorted((r.version, r.attempt, r.batch_id, r.status) for r in queue.states(spark).collect()) == [(1, 0, 0, "ready"), (1, 1, 1, "ready"), (2, 0, 0, "ready"), (4, 0, 1, "ready"), (5, 0, 1, "failed"), (6, 0, 2, "ready")]


def test_queue_in_a_stream_with_restart(spark, tmp_path):
    from marlstone.streaming.queue import JobQueue, drain

    queue, calls = JobQueue(str(tmp_path / "q"), ["version"]), []

    def work(todo):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return todo.select("version", F.lit("ready").alias("status"))

    def run():
        stream = spark.readStream.schema("version long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = drain(stream, queue, work, str(tmp_path / "cp"))
        try:
            q.awaitTermination(120)
        except Exception:  # the second batch is cut; the next run sends it again
            return False
        return q.exception() is None

    spark.createDataFrame([(i % 20, "queued") for i in range(60)], "version long, status string").repartition(4).write.parquet(str(tmp_path / "in"))
    assert not run()
    assert run()
    assert sorted(r.version for r in queue.results(spark).collect()) == list(range(20))
