"""Running totals within groups of any size, and joins with a hot key.

A window over a group puts the group into one task. Here rows are dealt by range of group and order, so a large group
lies in several tasks that follow each other; each task makes its own running totals, and what stands before a task's
first group is added as one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def running(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and running exclusive-ors (of longs) up to and with each row of its group, in the given order.

    The group must not be null. Rows that tie in the order follow each other in any way, so the order should tell apart
    all rows that differ.
    """
    fold = {**{k: (F.sum, v) for k, v in (sums or {}).items()}, **{k: (F.bit_xor, v) for k, v in (xors or {}).items()}}
    placed = materialise(df.repartitionByRange(F.col(group), *order).withColumn("_task", F.spark_partition_id()), "ordered")
    own = Window.partitionBy("_task", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_task").agg(*(f(v).alias(f"_{k}") for k, (f, v) in fold.items()))
    # only the first group of a task can have begun in an earlier one, so this has a row for each task at most
    begun = totals.select(group, "_task", *(f(f"_{k}").over(before).alias(f"_{k}") for k, (f, _) in fold.items())).where(F.col(f"_{next(iter(fold))}").isNotNull())
    with_own = placed.select("*", *(f(v).over(own).alias(k) for k, (f, v) in fold.items()))
    out = with_own.join(F.broadcast(begun), [group, "_task"], "left")
    for k in fold:
        zero = F.coalesce(f"_{k}", F.lit(0))
        out = out.withColumn(k, F.col(k) + zero if k in (sums or {}) else F.col(k).bitwiseXOR(zero))
    return out.drop("_task", *(f"_{k}" for k in fold))


def hot_join(many: DataFrame, one: DataFrame, on: list[str], size: str, parts: int = 1000) -> DataFrame:
    """Inner join of many rows with one row for each key, where ``size`` of that row is its number of rows in ``many``.

    Keys with more than 1 / parts of all rows, fewer than ``parts`` of them, are broadcast; the others are shuffled.
    """
    total = one.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * parts > total
    heavy = F.broadcast(one.where(hot))
    rest = many.join(F.broadcast(one.where(hot).select(*on)), on, "left_anti").join(one.where(~hot), on)
    return many.join(heavy, on).unionByName(rest)
