"""Results for presentation: flattening, formatting, snippets, series, bounded outputs and counts in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimal places of a unit; other units have 2.
PLACES = {"percent": 1, "score": 2, "ratio": 3}


def flatten(results: DataFrame, keys: list[str], metrics: list[str], difference: tuple[str, str] | None = None) -> DataFrame:
    """keys, metric, value: a row for each metric of a result row, and one more for the difference of two metrics."""
    long = results.unpivot(keys, metrics, "metric", "value")
    if difference is None:
        return long
    a, b = (F.col(c) for c in difference)
    return long.unionByName(results.select(*keys, F.lit("difference").alias("metric"), (a - b).alias("value")))


def unique_pick(df: DataFrame, where: Column, value: str) -> DataFrame:
    """One row with value: that of the only row that meets the condition, null when none or several do."""
    return df.where(where).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias(value))


def display(value: Column, unit: str, signed: bool = False) -> Column:
    """Text of a number by its unit: percent, usd, count, score, ratio or another; thousands are grouped."""
    exact = value.cast("decimal(28,10)")
    whole = exact == F.floor(exact)
    if unit == "usd":
        body = F.concat(F.lit("$"), F.when(whole, F.format_number(exact, 0)).otherwise(F.format_number(exact, 2)))
    elif unit == "count":
        body = F.when(whole, F.format_number(exact, 0)).otherwise(F.regexp_replace(exact.cast("string"), r"0+$", ""))
    else:
        body = F.concat(F.format_number(exact, PLACES.get(unit, 2)), F.lit("%" if unit == "percent" else ""))
    return F.concat(F.when(exact > 0, "+").otherwise(""), body) if signed else body


def score_summary(df: DataFrame, score: Column, bins: int = 10) -> DataFrame:
    """mean, median, p25, p75, min, max of scores from 0 to 1, n, n_nan of the undefined ones, and histogram (bin counts; 1 is
    in the last bin). One pass; a bin is a conditional count.
    """
    x = F.when(~F.isnan(score), score.cast("double"))
    at = F.least(F.floor(x * bins), F.lit(bins - 1))
    counts = F.array(*[F.count_if(at == i) for i in range(bins)])
    return df.agg(
        F.avg(x).alias("mean"), *[F.percentile(x, p).alias(n) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))],
        F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_nan"), counts.alias("histogram"),
    )


def line_series(results: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Points of a line: rows with a value, in their order."""
    return results.where(F.col(value).isNotNull()).orderBy(*order)


def varying_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values of the columns with more than one value (null is one), by one pass."""
    counts = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_values").where("n_values > 1")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Distinct by some columns, the first row of each kept: a partial minimum, no sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def ordered_counts(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """value, n, position of the named values in their fixed order; those without rows are left out."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(value))
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).where(F.col(value).isin(names)).withColumn("position", place.cast("long")).orderBy("position")


def totals(df: DataFrame, sums: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row: sums of columns and counts of rows for which a condition holds."""
    return df.agg(*[F.sum(c).alias(c) for c in sums], *[F.count_if(c).alias(n) for n, c in flags.items()])


def status_counts(df: DataFrame, by: list[str], status: str, ready: str, passages: str) -> DataFrame:
    """by, sources, ready, passages: passages count only for sources that are ready."""
    ok = F.col(status) == ready
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), F.count_if(ok).alias("ready"), F.coalesce(F.sum(F.when(ok, F.col(passages))), F.lit(0)).alias("passages"))


def comparable(metrics: DataFrame, unit: str, measure: str, least: int = 2) -> DataFrame:
    """metrics with comparable: whether ``least`` of them have its unit and measure. Groups are counted, then joined."""
    sizes = metrics.groupBy(unit, measure).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least)
    return metrics.join(sizes, [unit, measure], "left").withColumn("comparable", F.col("_k").isNotNull()).drop("_k")


def values_of(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are there, sorted."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def cursor_of(created: Column, key: Column) -> Column:
    """Opaque cursor of a row of a keyset page."""
    return F.base64(F.concat_ws("|", F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")).cast("binary"))


def cursor_parts(cursor: Column) -> tuple[Column, Column]:
    """Time and key of a cursor; null for what is no cursor."""
    text = F.try_to_binary(cursor, F.lit("base64")).cast("string")
    return F.try_to_timestamp(F.split_part(text, F.lit("|"), F.lit(1)), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.split_part(text, F.lit("|"), F.lit(2)).try_cast("long")


def result_page(results: DataFrame, runs: DataFrame, on: str, created: str, key: str, limit: int, filters: list[Column] = (), before: tuple | None = None) -> DataFrame:
    """A page of results with their runs (none for results without one), newest first, and one row more to tell of another."""
    rows = results.join(runs, on, "left")
    for f in filters:
        rows = rows.where(f)
    if before is not None:
        rows = rows.where(F.struct(created, key) < F.struct(*map(F.lit, before)))
    return rows.orderBy(F.desc(created), F.desc(key)).limit(limit + 1)


def newest_series(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest n rows in ascending order, and truncated: whether there were more."""
    top = df.orderBy(*[F.desc(c) for c in order]).limit(n + 1)
    # n + 1 rows at most from here on
    one = Window.partitionBy(F.lit(0))
    marked = top.withColumn("_at", F.row_number().over(one.orderBy(*[F.desc(c) for c in order]))).withColumn("truncated", F.count(F.lit(1)).over(one) > n)
    return marked.where(F.col("_at") <= n).drop("_at").orderBy(*order)


def snippet(text: Column, start: Column, end: Column, context: int = 80) -> Column:
    """Struct of the text around an anchor, the place of the anchor in it, and whether it is cut on either side."""
    lo, hi = F.greatest(F.lit(0), start - context), F.least(F.length(text), end + context)
    return F.struct(
        F.substring(text, lo + 1, hi - lo).alias("text"), (start - lo).cast("long").alias("mark_start"), (F.least(end, hi) - lo).cast("long").alias("mark_end"),
        (lo > 0).alias("truncated_left"), (hi < F.length(text)).alias("truncated_right"),
    )


def capped_output(items: DataFrame, by: str, order: str, text: str, most_items: int, most_chars: int) -> DataFrame:
    """Items of each output up to a number of items, then up to a number of characters of their JSON list, in order.

    The items of an output are those of one tool call; only the first most_items + 1 of each are ranked.
    """
    w = Window.partitionBy(by).orderBy(order)
    top = items.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most_items + 1)
    size = top.withColumn("_size", F.sum(F.length(text) + 1).over(w) + 1)
    kept = (F.col("_at") <= most_items) & (F.col("_size") <= most_chars)
    cut = F.min(kept).over(Window.partitionBy(by))
    return size.withColumn("truncated", ~cut).where(kept).drop("_at", "_size")


def by_metric(df: DataFrame, metric: str, key: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows by a metric, undefined ones last, ties by key; the first ``limit`` where given."""
    x = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric))
    out = df.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), key)
    return out if limit is None else out.limit(limit)


def segments(timings: DataFrame, run: str, stage: str, ms: str, total: str) -> DataFrame:
    """run, stage, ms, pct: stages of a run, the unattributed rest of 1 ms or more as ``other``, and shares of the larger of
    total and sum. One grouping gives sums; no window.
    """
    known = timings.where(F.col(ms).isNotNull())
    sums = known.groupBy(run).agg(F.sum(ms).alias("_sum"), F.max(total).alias("_total"))
    rest = F.col("_total") - F.col("_sum")
    other = sums.where(rest >= 1).select(run, F.lit("other").alias(stage), rest.alias(ms))
    base = F.greatest(F.coalesce("_total", F.lit(0.0)), "_sum")
    return known.select(run, stage, ms).unionByName(other).join(sums, run).select(run, stage, ms, F.when(base > 0, F.col(ms) / base * 100).otherwise(0.0).alias("pct"))


def versions(df: DataFrame, source: str, version: str, status: Column) -> DataFrame:
    """Version history, newest first, with current: the newest version of a source with a usable status."""
    newest = df.where(status).groupBy(source).agg(F.max(version).alias("_newest"))
    return df.join(newest, source, "left").withColumn("current", F.coalesce(F.col(version) == F.col("_newest"), F.lit(False))).drop("_newest").orderBy(source, F.desc(version))


def without_repeats(df: DataFrame, group: str, by: list[str], order: list[str]) -> DataFrame:
    """Of rows of a group with equal ``by`` the newest; rows without a group are untouched."""
    alone = df.where(F.col(group).isNull())
    rest = [c for c in df.columns if c not in (group, *by)]
    newest = df.where(F.col(group).isNotNull()).groupBy(group, *by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(group, *by, "_r.*")
    return alone.unionByName(newest.select(df.columns))
