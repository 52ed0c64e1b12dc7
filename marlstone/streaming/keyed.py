"""Keyed state over streams of events: rows of a key in order, each once, whatever the batches they come in.

The processors run in a stream and, with the same steps, over a table. In a stream, state is a small value for each key and
the rows that came before their turn, both in the state store, so a restart goes on where the last batch ended. Over a table
the rows of a key are sorted and follow each other, so its memory is that of the task and ends with the key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Number of a row that closes a key of a table: timers due by its time go off, as none do over a table by themselves.
END = 1 << 62
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Have the session keep state of several kinds for a key, which needs the RocksDB provider and, over tables too, the manager of streams."""
    _ = spark.streams.active
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)


class InOrder(StatefulProcessor):
    """Rows of a key by dense numbers from ``first``: a number seen before is dropped, one too early waits in the state.

    Subclasses give the columns of a row (``ROW``), a start value, step(memory, row, clock) and, where there are
    timers, expired(memory, when). A step returns rows for the output; memory is a dict that JSON can hold. After
    memory["ended"] nothing more is taken, so a key ends once, however late a second end comes.
    """

    ROW: list[str] = []
    OUT: list[str] = []
    first = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "memory string")
        self.waiting = handle.getMapState("waiting", "seq long", "row string")

    def start(self) -> dict:
        return {}

    def step(self, memory: dict, row: tuple, clock: Clock) -> Iterator[tuple]:
        raise NotImplementedError

    def expired(self, memory: dict, when: int, clock: Clock) -> Iterator[tuple]:
        return iter(())

    def _memory(self) -> dict:
        return json.loads(self.at.get()[0]) if self.at.exists() else {"next": self.first, "ended": False, **self.start()}

    def _take(self, memory: dict, row: tuple, clock: Clock) -> Iterator[tuple]:
        memory["next"] += 1
        if not memory["ended"]:
            yield from self.step(memory, row, clock)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *self.OUT])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, clock, out, until = self._memory(), Clock(self.handle), [], None
        for frame in rows:
            frame = frame.sort_values("seq")
            for seq, *row in zip(frame["seq"].tolist(), *(frame[c].tolist() for c in self.ROW), strict=True):
                if seq == END:
                    until = int(row[-1])
                    continue
                if seq < memory["next"] or memory["ended"]:
                    continue
                if seq > memory["next"]:
                    self.waiting.updateValue((seq,), (json.dumps(row, default=list),))
                    continue
                out += self._take(memory, tuple(row), clock)
                while self.waiting.containsKey((memory["next"],)):
                    early = self.waiting.getValue((memory["next"],))
                    self.waiting.removeKey((memory["next"],))
                    out += self._take(memory, tuple(json.loads(early[0])), clock)
            if len(out) > 10_000:
                yield self._frame(key, out)
                out = []
        if until is not None:
            out += self.expired(memory, until, clock)
        self.at.update((json.dumps(memory),))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        memory, clock = self._memory(), Clock(self.handle)
        out = list(self.expired(memory, expiredTimerInfo.getExpiryTimeInMs(), clock))
        self.at.update((json.dumps(memory),))
        yield self._frame(key, out)

    def close(self) -> None:
        pass


class Clock:
    """Timers of a key, in milliseconds of event time."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._handle = handle

    def at(self, millis: int) -> None:
        self._handle.registerTimer(int(millis))

    def off(self, millis: int | None) -> None:
        if millis is not None:
            self._handle.deleteTimer(int(millis))


class NoClock:
    """Timers of a table: none goes off by itself."""

    def at(self, millis: int) -> None:
        pass

    def off(self, millis: int | None) -> None:
        pass


#: Rows that a task gathers before it hands them on.
MOST_EVENTS = 20_000


def over_table(processor: InOrder, rows: DataFrame, schema: str) -> DataFrame:
    """The processor over a table of (key, seq, its columns): keys one after another, rows of a key by seq, each once.

    What follows a missing number is not taken, as in a stream where that number never comes.
    """
    first, columns = processor.first, ["key", "seq", *processor.ROW]
    dealt = rows.select(*columns).repartition("key").sortWithinPartitions("key", "seq")
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock, out, began, key, until = NoClock(), [], False, None, None
        memory: dict = {}

        def made() -> pa.RecordBatch:
            held = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, kinds, strict=True)], kinds.names)

        for batch in batches:
            for k, seq, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or k != key:
                    if until is not None:
                        out += [(key, *x) for x in processor.expired(memory, until, clock)]
                    began, key, until, memory = True, k, None, {"next": first, "ended": False, **processor.start()}
                if seq == END:
                    until = int(row[-1])
                elif seq == memory["next"] and not memory["ended"]:
                    out += [(key, *x) for x in processor._take(memory, tuple(row), clock)]
            if len(out) >= MOST_EVENTS:
                yield made()
                out = []
        if until is not None:
            out += [(key, *x) for x in processor.expired(memory, until, clock)]
        yield made()

    return dealt.mapInArrow(run, schema)


# The form of a marker, what may still become one, and the end of a text that a removal must not complete.
MARK = r"\[[ER][0-9]{0,4}\]"
UNDECIDED = r"\[(?:[ER][0-9]{0,4})?\Z"
BEGUN = r"\[(?:[ER][0-9]{0,5})?\Z"
MOST_DIGITS = 2


class AliasGate(InOrder):
    """Deltas of an answer as events (kind, value): text, citation at the first use of an alias, unknown and malformed markers.

    Text is held back while its end may become a marker, six characters at most. Markers that are no alias of the answer
    are cut; where that would complete another marker a blank comes in between.
    """

    ROW = ["delta", "last", "aliases"]
    OUT = ["place", "kind", "value"]

    def start(self) -> dict:
        return {"held": "", "tail": "", "cited": [], "aliases": None, "place": 0}

    def step(self, memory: dict, row: tuple, clock: Clock) -> Iterator[tuple]:
        delta, last, aliases = row
        if memory["aliases"] is None:
            memory["aliases"] = list(aliases) if aliases is not None else []
        text = memory["held"] + (delta or "")
        last = bool(last)
        open_ = None if last else re.search(UNDECIDED, text)
        cut = open_.start() if open_ else len(text)
        memory["held"] = text[cut:]
        memory["ended"] = last
        for kind, value in _events(text[:cut], memory):
            yield memory["place"], kind, value
            memory["place"] += 1


def _events(text: str, memory: dict) -> Iterator[tuple[str, str]]:
    """Events of decided text; memory has the end of the text since the last marker and the aliases cited so far."""
    shown, at = "", 0
    for mark in re.finditer(MARK, text):
        before = text[at : mark.start()]
        shown, memory["tail"], at = shown + before, (memory["tail"] + before)[-7:], mark.end()
        alias = mark[0][1:-1]
        known = alias in memory["aliases"]
        if known and alias in memory["cited"]:
            shown += mark[0]
        else:
            if shown:
                yield "text", shown
            shown = ""
            if known:
                memory["cited"].append(alias)
                yield "citation", alias
                shown = mark[0]
            else:
                yield ("unknown" if 1 < len(alias) <= 1 + MOST_DIGITS else "malformed"), mark[0]
                shown = " " if re.search(BEGUN, memory["tail"]) else ""
        memory["tail"] = ""
    memory["tail"] = (memory["tail"] + text[at:])[-7:]
    if shown + text[at:]:
        yield "text", shown + text[at:]


def joined_texts(events: DataFrame, key: str) -> DataFrame:
    """Events of the gate with neighbouring texts as one, numbered anew: the same for every cut of a text into deltas."""
    w = Window.partitionBy(key).orderBy("place")
    marked = events.withColumn("_run", F.sum((F.col("kind") != "text").cast("int")).over(w))
    one = marked.groupBy(key, "_run", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "").alias("value"))
    again = Window.partitionBy(key).orderBy("_run", F.col("kind") == "text")
    return one.select(key, (F.row_number().over(again) - 1).cast("long").alias("place"), "kind", "value")


def gate_text(df: DataFrame, text: str, aliases: str) -> DataFrame:
    """df with ``shown``, the text without unknown and malformed markers, ``removed``, those markers, and ``cited``, the aliases in use.

    The form of the gate for whole texts, by expressions on the pieces of each text; a null text is empty.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({MARK}|[^\\[]+|\\[)"), F.lit(1))
    is_mark = lambda x: F.startswith(x, F.lit("[")) & (F.length(x) > 1)
    alias = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    known = lambda x: F.coalesce(F.array_contains(F.col(aliases), alias(x)), F.lit(False))

    def show(x: Column, i: Column) -> Column:
        one, two = (F.get(F.col("_pieces"), i - k) for k in (1, 2))
        begun = (one == "[") | (one.rlike(r"^[ER][0-9]{0,5}\z") & (two == "["))
        return F.when(~is_mark(x) | known(x), x).when(F.coalesce(begun, F.lit(False)), " ").otherwise("")

    out = df.withColumn("_pieces", pieces)
    marks = F.filter("_pieces", is_mark)
    return out.withColumns(
        {
            "shown": F.array_join(F.transform("_pieces", show), ""),
            "removed": F.filter(marks, lambda x: ~known(x)),
            "cited": F.transform(F.array_distinct(F.filter(marks, known)), alias),
        }
    ).drop("_pieces")


def gate_deltas(deltas: DataFrame, key: str) -> DataFrame:
    """key, place, kind, value of deltas (key, seq from 0, delta, last, aliases); a stream or a table.

    aliases are those of the first delta. Null deltas are empty; without a last delta the held end is not given out.
    """
    schema = f"key {dict(deltas.dtypes)[key]}, place long, kind string, value string"
    if not deltas.isStreaming:
        rows = deltas.selectExpr(f"`{key}` AS key", "CAST(seq AS long) AS seq", "delta", "last", "CASE WHEN seq = 0 THEN aliases END AS aliases")
        return over_table(AliasGate(), rows, schema).withColumnRenamed("key", key)
    keep_state(deltas.sparkSession)
    rows = deltas.selectExpr(f"`{key}` AS key", "CAST(seq AS long) AS seq", "delta", "last", "aliases")
    return rows.groupBy("key").transformWithStateInPandas(AliasGate(), schema, "Append", "None").withColumnRenamed("key", key)


class RunLog(InOrder):
    """Events of runs as they are stored: tokens joined, one end for each run, orphans interrupted.

    Tokens that follow each other are joined while they come within ``slot`` milliseconds of the first one; any other
    event gives them out first, and a timer does where nothing more comes. A run whose ``done`` has not come ``deadline``
    milliseconds after its first event gets one that says interrupted, and nothing after it.
    """

    ROW = ["type", "payload", "at"]
    OUT = ["seq", "type", "payload", "at", "n_joined"]

    def __init__(self, slot: int, deadline: int):
        self.slot, self.deadline = slot, deadline

    def start(self) -> dict:
        return {"out": 0, "text": None, "since": None, "n": 0, "due": None}

    def _put(self, memory: dict, type_: str, payload: str | None, at: int, n: int) -> tuple:
        memory["out"] += 1
        return memory["out"] - 1, type_, payload, at, n

    def _flush(self, memory: dict, clock: Clock) -> Iterator[tuple]:
        if memory["text"] is not None:
            clock.off(memory["since"] + self.slot)
            yield self._put(memory, "token", memory["text"], memory["since"], memory["n"])
            memory.update(text=None, since=None, n=0)

    def step(self, memory: dict, row: tuple, clock: Clock) -> Iterator[tuple]:
        type_, payload, at = row
        if memory["due"] is None:
            memory["due"] = at + self.deadline
            clock.at(memory["due"])
        if at >= memory["due"]:
            yield from self.expired(memory, memory["due"], clock)
            return
        if type_ == "token":
            if memory["since"] is not None and at >= memory["since"] + self.slot:
                yield from self._flush(memory, clock)
            if memory["since"] is None:
                memory["since"] = at
                clock.at(at + self.slot)
            memory["text"] = (memory["text"] or "") + (payload or "")
            memory["n"] += 1
            return
        yield from self._flush(memory, clock)
        yield self._put(memory, type_, payload, at, 1)
        if type_ == "done":
            clock.off(memory["due"])
            memory["ended"] = True

    def expired(self, memory: dict, when: int, clock: Clock) -> Iterator[tuple]:
        if memory["ended"]:
            return
        if memory["due"] is not None and when >= memory["due"]:
            yield from self._flush(memory, clock)
            yield self._put(memory, "done", json.dumps({"termination_state": "interrupted", "flags": ["RUN_INTERRUPTED"]}), memory["due"], 1)
            memory["ended"] = True
        elif memory["since"] is not None and when >= memory["since"] + self.slot:
            yield from self._flush(memory, clock)


def run_log(events: DataFrame, key: str = "run_id", slot_millis: int = 100, deadline_millis: int = 150_000, late: str = "10 minutes", now_millis: int | None = None) -> DataFrame:
    """key, seq, type, payload, ts, n_joined of the events (key, seq from 0, type, payload, ts) as RunLog stores them.

    seq is dense again; events behind a missing number wait for it. In a stream, timers go by the watermark: what comes later
    than ``late`` is left out by the engine. Over a table the timers due by ``now`` (null: all) go off at the end.
    """
    schema = f"key {dict(events.dtypes)[key]}, seq long, type string, payload string, at long, n_joined long"
    rows = events.withWatermark("ts", late).selectExpr(f"`{key}` AS key", "CAST(seq AS long) AS seq", "type", "payload", "unix_millis(ts) AS at", "ts")
    if not events.isStreaming:
        close = rows.select("key").distinct().selectExpr("key", f"{END}L AS seq", "CAST(NULL AS string) AS type", "CAST(NULL AS string) AS payload", f"{END if now_millis is None else now_millis}L AS at", "CAST(NULL AS timestamp) AS ts")
        out = over_table(RunLog(slot_millis, deadline_millis), rows.unionByName(close), schema)
    else:
        keep_state(events.sparkSession)
        out = rows.groupBy("key").transformWithStateInPandas(RunLog(slot_millis, deadline_millis), schema, "Append", "EventTime")
    return out.selectExpr(f"key AS `{key}`", "seq", "type", "payload", "timestamp_millis(at) AS ts", "n_joined")
