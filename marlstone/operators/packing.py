"""Blocks of a document: units too long are cut at sentences or tokens, then units fill blocks in their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TOKEN = r"\w+|[^\w\s]"
MOST = 800


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?U)({TOKEN})"), F.lit(1)))


class _Fold:
    """Sizes to blocks of ``most`` in order, units of a document after each other; it goes on from batch to batch."""

    def __init__(self, most: int):
        self.most, self.block, self.used, self.last = most, 0, 0, None

    def of(self, sizes: list[int], begins: list[bool], runs: list | None = None, wholes: list | None = None) -> list[int]:
        most, block, used, last, out = self.most, self.block, self.used, self.last, []
        for i, (n, begin) in enumerate(zip(sizes, begins, strict=True)):
            if begin:
                block, used, last = 0, 0, None
            need = n
            if runs is not None:
                if runs[i] is not None and runs[i] != last and wholes[i] <= most:
                    need = max(n, wholes[i])
                last = runs[i]
            if used and used + need > most:
                block, used = block + 1, 0
            used += n
            out.append(block)
        self.block, self.used, self.last = block, used, last
        return out


def filled(df: DataFrame, by: list[str], order: list[str], size: str, most: int, run: str | None = None) -> DataFrame:
    """df with block: rows of each ``by`` fill blocks of ``most`` in order; a row larger than that has a block of its own.

    With ``run``, a run of equal values that would fit a whole block but not the rest of this one begins a new block.
    The rows of a document follow each other, sorted, through one task; the fold holds one batch of them and the last block.
    """
    sized = df.withColumn("_fold_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    if run:
        sized = sized.withColumn("_fold_run", F.col(run).cast("long")).withColumn("_fold_whole", F.when(F.col("_fold_run").isNotNull(), F.sum("_fold_size").over(Window.partitionBy(*by, "_fold_run"))))
    sized = sized.repartition(*by).sortWithinPartitions(*by, *order)
    n = len(df.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = _Fold(most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            begins = [k != b for k, b in zip(keys, [before, *keys[:-1]], strict=True)]
            before = keys[-1]
            blocks = state.of(batch.column("_fold_size").to_pylist(), begins, *((batch.column(c).to_pylist() for c in ("_fold_run", "_fold_whole")) if run else ()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(blocks, pa.int32())], [*batch.schema.names[:n], "block"])

    return sized.mapInArrow(fold, StructType([*df.schema.fields, StructField("block", IntegerType())]))


def block_sizes(df: DataFrame, key: str, sizes: str, most: int) -> DataFrame:
    """key, block, size of documents whose units are an array of sizes in order: the same blocks, without dealing out the units."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row, flat = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()
            blocks = np.array(_Fold(most).of(flat.to_pylist(), np.diff(row, prepend=-1).astype(bool).tolist()), np.int64)
            begin = (np.diff(row, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0)
            totals = np.add.reduceat(flat.to_numpy(zero_copy_only=False), np.flatnonzero(begin)) if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[begin])), pa.array(blocks[begin], pa.int32()), pa.array(totals, pa.int64())], [key, "block", "size"])

    units = df.select(key, F.transform(sizes, lambda x: F.coalesce(x, F.lit(0)).cast("long")).alias("_sizes"))
    return units.mapInArrow(fold, f"`{key}` {dict(df.dtypes)[key]}, block int, size long")


def pieces(units: DataFrame, key: str, ordinal: str, text: str, most: int = MOST) -> DataFrame:
    """units with piece, text of at most ``most`` tokens each: sentences together as far as they fit, longer ones cut at tokens.

    Units that fit stay as they are. Null or empty texts have no piece.
    """
    marked = units.where(F.length(text) > 0).withColumn("_n", n_tokens(F.col(text)))
    fit = marked.where(F.col("_n") <= most).withColumn("piece", F.lit(0)).drop("_n")
    sentence = F.posexplode(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")).alias("_s", "_part")
    long = marked.where(F.col("_n") > most).select(key, ordinal, sentence)
    part = r"(?U)\A\s*(?:(?:" + TOKEN + r")\s*){1," + str(most) + r"}"
    step = F.transform(F.regexp_extract_all("_part", F.lit(part.replace(r"\A", r"\G", 1)), F.lit(0)), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", ""))
    cut = long.select(key, ordinal, "_s", F.posexplode(step).alias("_c", "_part")).withColumn("_size", n_tokens(F.col("_part")))
    packed = filled(cut, [key, ordinal], ["_s", "_c"], "_size", most).groupBy(key, ordinal, "block").agg(F.array_sort(F.collect_list(F.struct("_s", "_c", "_part"))).alias("_l"))
    packed = packed.select(key, ordinal, F.col("block").alias("piece"), F.array_join("_l._part", " ").alias(text))
    return fit.drop(text).join(units.select(key, ordinal, text), [key, ordinal]).unionByName(packed.join(units.drop(text), [key, ordinal]))


def blocks(units: DataFrame, key: str, ordinal: str, text: str, run: str | None = None, most: int = MOST) -> DataFrame:
    """key, block, text, n_tokens, list_group of a document's units in order.

    Items of a list (``run`` is not null) are written with a mark; a list that stands in several blocks gives them its
    number as list_group, the smallest where there are several.
    """
    items = F.col(run).isNotNull() if run else F.lit(False)
    parts = pieces(units, key, ordinal, text, most - 1 if run else most).withColumn("_text", F.when(items, F.concat(F.lit("- "), F.col(text))).otherwise(F.col(text)))
    parts = filled(parts.withColumn("_n", n_tokens(F.col("_text"))), [key], [ordinal, "piece"], "_n", most, run)
    if run:
        over = Window.partitionBy(key, run)
        parts = parts.withColumn("_split", F.when(F.col(run).isNotNull() & (F.min("block").over(over) < F.max("block").over(over)), F.col(run)))
    else:
        parts = parts.withColumn("_split", F.lit(None).cast("int"))
    line = F.array_sort(F.collect_list(F.struct(ordinal, "piece", "_text")))
    out = parts.groupBy(key, "block").agg(line.alias("_l"), F.sum("_n").alias("n_tokens"), F.min("_split").alias("list_group"))
    return out.select(key, "block", F.array_join("_l._text", "\n").alias("text"), "n_tokens", "list_group")
