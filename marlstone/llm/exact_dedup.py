"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are computed once and written. Misra-Gries summaries of the partitions name digests
that may be frequent; the exact counts of the best ``counters`` of them are taken in one pass, and those that hold more
than ``1 / counters`` of the rows are the winners. Winners are at most ``counters`` rows, so they are broadcast and
their copies are resolved on the map side. The other digests, none of them frequent, take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: White space that counts as one blank, as in ``[\x20\x09-\x0D]+``.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def misra_gries(items: Iterator[str], counters: int) -> dict[str, int]:
    """Summary with at most ``counters`` entries; every item with more than n / (counters + 1) occurrences is in it."""
    held: dict[str, int] = {}
    for x in items:
        if x in held:
            held[x] += 1
        elif len(held) < counters:
            held[x] = 1
        else:
            held = {k: v - 1 for k, v in held.items() if v > 1}
    return held


def frequent_digests(digests: DataFrame, counters: int) -> DataFrame:
    """digest, group_size, keep_id of the digests that hold more than 1 / counters of all rows; at most counters rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((d for b in batches for d in b.column("digest").to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    candidates = (
        digests.select("digest")
        .mapInArrow(summarise, "digest string, low long")
        .groupBy("digest")
        .agg(F.sum("low").alias("low"))
        .where(F.col("low") > 1)
        .orderBy(F.desc("low"), "digest")
        .limit(counters)
        .select("digest")
    )
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
    total = digests.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("group_size") * counters > F.col("n_rows")).select("digest", "group_size", "keep_id")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one blank; null counts as the empty text, and
    empty texts are equal to each other. The row with the smallest key stays. Rows that repeat the kept key with the
    same text all stay (they are one document). Null keys come last: where a group has no other, keep_id is null and
    all its rows stay. Other columns of docs, whatever their names, are not read. An empty table gives no rows.
    """
    base = docs.select(docs[key].cast("long").alias("doc_id"), F.sha2(normalised(docs[text]).cast("binary"), 256).alias("digest"))
    digests = materialise(base, "digests")
    heavy = materialise(frequent_digests(digests, counters), "heavy-digests")
    easy = digests.join(F.broadcast(heavy), "digest")
    same = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("keep_id", F.min("doc_id").over(same))
    )
    both = easy.select("doc_id", "keep_id", "group_size", "digest").unionByName(rest.select("doc_id", "keep_id", "group_size", "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that repeat the text of a row with a smaller key; columns as given.

    Rows go by key and text: of two texts under one key each is judged by itself. Rows with a null key go where a row with
    a key has their text, else all of them stay. Null and empty texts are equal; an empty table stays empty.
    """
    gone = exact_dedup(docs, text, key).where(~F.col("kept") & (F.col("doc_id").isNotNull() | F.col("keep_id").isNotNull()))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_digest")).distinct()
    digest = F.sha2(normalised(docs[text]).cast("binary"), 256)
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["_gone"]) & (digest == gone["_digest"]), "left_anti")
