"""Event log of runs as streams: replay, terminal guard, token coalescing, windows and the reaper of orphaned runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of an event: run, dense number in the run, type, payload and time.
EVENT = T.StructType(
    [T.StructField("run_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampType())]
)


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Stream of the events under a folder of Parquet files; its checkpoint is the cursor of a reader."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(log: DataFrame, run_id: int, after: int = -1) -> DataFrame:
    """Events of a run after a number, in order."""
    return log.where((F.col("run_id") == run_id) & (F.col("seq") > after)).orderBy("seq")


def append_once(events: DataFrame, path: str, checkpoint: str) -> object:
    """Append a stream of events to the log; each (run, seq) and each terminal ``done`` once, whatever is sent again."""
    once = events.withWatermark("ts", "1 hour").withColumn("_key", F.when(F.col("type") == "done", F.lit(-1)).otherwise(F.col("seq")))
    once = once.dropDuplicatesWithinWatermark(["run_id", "_key"]).drop("_key")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gaps(log: DataFrame) -> DataFrame:
    """run_id, missing: runs whose numbers are not dense, and runs that go on after ``done``."""
    per = log.groupBy("run_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("n"), F.max(F.when(F.col("type") == "done", F.col("seq"))).alias("end"))
    missing = F.col("hi") - F.col("lo") + 1 - F.col("n")
    return per.where((missing > 0) | (F.col("end") < F.col("hi"))).select("run_id", missing.alias("missing"), (F.coalesce(F.col("hi") - F.col("end"), F.lit(0))).alias("after_done"))


def coalesce_tokens(log: DataFrame, millis: int = 100) -> DataFrame:
    """Token events that follow each other in a run within a time slot as one, in order; other events stay as they are.

    A stretch of tokens ends where another event comes, which a running count of those events marks.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("seq")
    other = F.sum((F.col("type") != "token").cast("int")).over(w)
    slot = F.when(F.col("type") == "token", F.floor(F.unix_millis("ts") / millis))
    marked = log.withColumn("_part", other).withColumn("_slot", slot)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: F.coalesce(x["payload"], F.lit("")))
    return marked.groupBy("run_id", "type", "_part", "_slot").agg(F.min("seq").alias("seq"), F.array_join(parts, "").alias("payload"), F.count(F.lit(1)).alias("n")).drop("_part", "_slot")


def tumbling(events: DataFrame, size: str, late: str, by: str = "type") -> DataFrame:
    """Counts of event-time windows; rows later than the watermark are left out by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count(F.lit(1)).alias("n"))


def overdue(runs: DataFrame, now, deadline_seconds: int, margin_seconds: int = 30) -> DataFrame:
    """Runs that are still running after their deadline and a margin (batch form of the reaper)."""
    return runs.where((F.col("status") == "running") & (F.col("started") < now - F.make_dt_interval(secs=F.lit(float(deadline_seconds + margin_seconds)))))


def reaper(deadline_seconds: int) -> Callable:
    """Function for applyInPandasWithState: one ``interrupted`` event for each run without ``done`` at its deadline.

    State is the last number seen and whether the run has ended; a run ends once.
    """

    def run(key, frames, state):
        (run_id,) = key
        last, ended = state.get if state.exists else (-1, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield pd.DataFrame({"run_id": [run_id], "seq": [last + 1], "type": ["interrupted"]})
            return
        for frame in frames:
            last = max(last, int(frame["seq"].max()))
            ended = ended or bool((frame["type"] == "done").any())
        state.update((last, ended))
        state.setTimeoutDuration(deadline_seconds * 1000)

    return run


def reap(events: DataFrame, deadline_seconds: int) -> DataFrame:
    """Stream of the ``interrupted`` events that the reaper makes, by processing time."""
    return events.groupBy("run_id").applyInPandasWithState(reaper(deadline_seconds), "run_id long, seq long, type string", "last long, ended boolean", "append", "ProcessingTimeTimeout")
