"""Job queue of versions: each queued version is processed once, whatever is sent twice or cut in the middle.

A batch of a stream writes its results, then the keys it worked on, then one row that commits the batch. What a batch
wrote before it was cut is written over when the engine sends it again, as its folders go by the batch's number; what
stands without a commit is read by nobody.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUED, FAILED = "queued", "failed"


class JobQueue:
    """Ledger of a queue below a shared folder. key: the columns that name a version (and its attempt, if it may come again)."""

    def __init__(self, folder: str, key: list[str]):
        self.folder, self.key = folder.rstrip("/"), key

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch_id}")

    def committed(self, spark: SparkSession, batch_id: int) -> bool:
        commits = self._read(spark, "commits")
        return commits is not None and not commits.where(F.col("batch_id") == batch_id).isEmpty()

    def _whole(self, spark: SparkSession, name: str) -> DataFrame | None:
        """Rows of committed batches."""
        rows, commits = self._read(spark, name), self._read(spark, "commits")
        return None if rows is None or commits is None else rows.join(commits.select("batch_id").distinct(), "batch_id", "left_semi")

    def waiting(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch that are queued and that no committed batch has, one for each key (the first in the order of all columns)."""
        rest = sorted(c for c in batch.columns if c not in self.key)
        queued = batch.where(F.col("status") == QUEUED)
        one = queued.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("_row")).select(*self.key, "_row.*").select(*batch.columns)
        seen = self._whole(batch.sparkSession, "keys")
        return one if seen is None else one.join(seen.select(*self.key), self.key, "left_anti")

    def step(self, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """Function for foreachBatch. work takes waiting versions and returns rows of results with the key and a status.

        Versions that work returns nothing for have failed. A batch whose commit stands is passed over.
        """

        def run(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            if self.committed(spark, batch_id):
                return
            self._write(self.waiting(batch).select(*self.key), "keys", batch_id)
            mine = spark.read.parquet(f"{self.folder}/keys/{batch_id}").drop("batch_id")
            todo = self.waiting(batch).join(mine, self.key, "left_semi")
            self._write(work(todo), "results", batch_id)
            done = spark.read.parquet(f"{self.folder}/keys/{batch_id}")
            self._write(done.agg(F.count(F.lit(1)).alias("n_keys")).coalesce(1), "commits", batch_id)

        return run

    def results(self, spark: SparkSession) -> DataFrame:
        """Results of committed batches: one row or more for each version that was processed."""
        got = self._whole(spark, "results")
        if got is None:
            raise ValueError("no batch of this queue is committed")
        return got

    def states(self, spark: SparkSession) -> DataFrame:
        """key, batch_id, status of every version taken: that of its results, failed where it has none."""
        keys, results = self._whole(spark, "keys"), self.results(spark)
        status = results.groupBy(*self.key).agg(F.max("status").alias("status"))
        return keys.join(status, self.key, "left").select(*self.key, "batch_id", F.coalesce("status", F.lit(FAILED)).alias("status"))


def drain(queue: DataFrame, ledger: JobQueue, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> object:
    """Process what a stream of queued versions holds now; the checkpoint and the ledger carry on at the next call."""
    return queue.writeStream.foreachBatch(ledger.step(work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
