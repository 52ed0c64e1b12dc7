"""Running totals and exact quantiles that put no group into one task.

Rows are dealt by ranges of group and order, so a large group lies in tasks that follow each other. Each task makes totals of
its own; what stands before the first group of a task is one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import settled


def running_totals(df: DataFrame, by: list[str], order: list[Column], name: str, value: Column) -> DataFrame:
    """df with the sum of a value over the rows of its group up to and with each row.

    Rows that tie in the order follow each other in any way. Null is a group like others.
    """
    key = F.struct(*(F.col(b) for b in by)) if by else F.lit(0)
    keyed = df.withColumn("_key", key)
    dealt = settled(keyed.repartitionByRange(*([F.col("_key")] if by else []), *order).withColumn("_task", F.spark_partition_id()))
    own = Window.partitionBy("_task", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_key", "_task").agg(F.sum(value).alias("_sum"))
    # only the first group of a task can have begun in an earlier one
    begun = totals.select(F.col("_key").alias("_k"), F.col("_task").alias("_t"), F.sum("_sum").over(before).alias("_before")).where("_before IS NOT NULL")
    summed = dealt.withColumn(name, F.sum(value).over(own)).join(F.broadcast(begun), (F.col("_task") == F.col("_t")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    return summed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_key", "_task", "_k", "_t", "_before")


def values_at(df: DataFrame, by: list[str], value: Column, places: dict[str, Column]) -> DataFrame:
    """by, _n and the value at given places (from 0, by ``_n``, the number of values) of the sorted values of each group; nulls are none.

    Values are counted first, so what is sorted is one row for each distinct value.
    """
    counted = df.select(*by, value.alias("_x")).where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counted, by, [F.col("_x")], "_to", F.col("_c"))
    size = placed.groupBy(*by).agg(F.sum("_c").alias("_n"))
    both = placed.crossJoin(F.broadcast(size)) if not by else _with_size(placed, size, by)
    inside = lambda at: (at >= F.col("_to") - F.col("_c")) & (at < F.col("_to"))
    return both.groupBy(*by, "_n").agg(*(F.max(F.when(inside(at), F.col("_x"))).alias(name) for name, at in places.items()))


def _with_size(placed: DataFrame, size: DataFrame, by: list[str]) -> DataFrame:
    named = size.select("_n", *(F.col(b).alias(f"_s{i}") for i, b in enumerate(by)))
    same = [F.col(b).eqNullSafe(F.col(f"_s{i}")) for i, b in enumerate(by)]
    return placed.join(named, same).drop(*(f"_s{i}" for i in range(len(by))))


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """by, a linearly interpolated quantile for each share, and n, the number of values. Groups without values have nulls and 0."""
    x, last = value.cast("double"), F.col("_n") - 1
    places = {}
    for name, p in shares.items():
        places |= {f"_lo_{name}": F.floor(last * p), f"_hi_{name}": F.ceil(last * p)}
    got = values_at(df, by, x, places)

    def between(name: str, p: float) -> Column:
        low, high, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), last * p - F.floor(last * p)
        return (low + (high - low) * part).alias(name)

    known = got.select(*by, *(between(n, p) for n, p in shares.items()), F.col("_n").alias("n"))
    if not by:
        none = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
        return none.join(known.withColumn("_one", F.lit(1)), "_one", "left").drop("_one").withColumn("n", F.coalesce("n", F.lit(0)))
    named = known.select(*(F.col(b).alias(f"_s{i}") for i, b in enumerate(by)), *shares, "n")
    groups = df.select(*by).distinct()
    return groups.join(named, [F.col(b).eqNullSafe(F.col(f"_s{i}")) for i, b in enumerate(by)], "left").select(*by, *shares, F.coalesce("n", F.lit(0)).alias("n"))
