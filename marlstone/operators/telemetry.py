"""Aggregation of run records: JSON numbers, percentiles, flags, latest rows, outcome buckets and capped logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import settled
from .totals import quantiles

LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40}


def percentiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles and the number of values of each group; values are counted, then sorted by ranges over all tasks."""
    return quantiles(df, by, value, shares)


def stages(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Wide stage timings as rows: keep, stage, ms."""
    return df.unpivot(keep, columns, "stage", "ms")


def frequencies(df: DataFrame, array: str) -> DataFrame:
    """value, n of the elements of an array column; an element counts once for each time it is there."""
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a partial maximum, no sort and no gathered group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def outcome(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """List price of a call, prices for a million tokens, to 6 places."""
    million = F.lit(1_000_000).cast("decimal(20,6)")
    return F.bround((tokens_in * F.lit(price_in).cast("decimal(10,4)") + tokens_out * F.lit(price_out).cast("decimal(10,4)")) / million, 6)


def recency(ts: Column, now: Column) -> Column:
    days = F.datediff(now, ts)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "week").when(days <= 30, "month").otherwise("older")


def at_least(level: Column, minimum: str) -> Column:
    """Severity filter."""
    ranks = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.lower(level)), F.lit(0)) >= LEVELS[minimum]


def ring(df: DataFrame, order: str, capacity: int) -> DataFrame:
    """The newest rows up to a capacity; a bounded sort, not a window over all."""
    return df.orderBy(F.desc(order)).limit(capacity)


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have it the fresh one wins."""
    both = base.withColumn("_at", F.lit(0)).unionByName(fresh.withColumn("_at", F.lit(1)))
    return latest(both, key, ["_at"]).drop("_at")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "_i") -> DataFrame:
    """df with the row's place from 0 and ``_n``, the number of rows, without gathering all rows in one task.

    Rows are dealt in ranges of the order; the ranges' sizes, one row each, tell where each begins.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled, as the bounds of the ranges are drawn anew each time they are computed
    dealt = df.withColumn("_part", F.lit(0)) if by else settled(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    dealt = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    begins = sizes.withColumn("_n", F.sum("_size").over(w)).withColumn("_before", F.sum("_size").over(w.orderBy("_part")) - F.col("_size")).drop("_size")
    return dealt.join(F.broadcast(begins) if not by else begins, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def equal_bins(df: DataFrame, order: list[str], bins: int, value: Column) -> DataFrame:
    """bin, n, mean of consecutive bins of equal count; remainders spread by floor arithmetic."""
    at = numbered(df, [], order)
    return at.groupBy(F.floor(F.col("_i") * bins / F.col("_n")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def rate_per_bin(df: DataFrame, order: list[str], bins: int, hit: Column) -> DataFrame:
    """bin, n, rate: share of the rows of each bin for which a condition holds."""
    return equal_bins(df, order, bins, hit.cast("double")).withColumnRenamed("mean", "rate")


def counts_by(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def failure_categories(df: DataFrame, document: str, path: str) -> DataFrame:
    """category, n of the strings in a JSON array; documents without the array add nothing."""
    names = F.from_json(F.get_json_object(document, path), "array<string>")
    return df.select(F.explode(names).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def retrieval_timing(df: DataFrame, by: list[str], ms: Column, candidates: Column, hit: Column) -> DataFrame:
    """by, p50_ms, p95_ms, p50_candidates, hit_rate over the rows that tell whether the cache was hit; by has no nulls."""
    times = quantiles(df, by, ms, {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n")
    sizes = quantiles(df, by, candidates, {"p50_candidates": 0.5}).drop("n")
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("hit_rate")).join(times, by).join(sizes, by)


def summary(df: DataFrame, failed: Column, tokens: Column) -> DataFrame:
    """One row: runs, failed, error_rate, recorded (runs with usage) and mean_tokens over those."""
    return df.agg(F.count(F.lit(1)).alias("runs"), F.count_if(failed).alias("failed"), F.avg(failed.cast("double")).alias("error_rate"), F.count(tokens).alias("recorded"), F.avg(tokens.cast("double")).alias("mean_tokens"))


def overview(**counts: tuple[DataFrame, Column]) -> DataFrame:
    """One row of independent scalars: each name is an aggregate of its table; one-row frames are joined."""
    out = None
    for name, (df, aggregate) in counts.items():
        one = df.agg(aggregate.alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def log_page(df: DataFrame, level: Column, minimum: str, others: Column, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The page of a log query, newest first, and its level histogram, which does not look at the level filter."""
    chosen = df.where(others).withColumn("level", level)
    return chosen.where(at_least(F.col("level"), minimum)).orderBy(F.desc(order)).limit(limit), counts_by(chosen, "level")


def window_start(now: Column, minutes: int) -> Column:
    """Lower bound of a relative window, floored to the minute."""
    return F.date_trunc("minute", now - F.make_dt_interval(mins=F.lit(minutes)))


def merged(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Two rings as one, in order."""
    return a.unionByName(b).orderBy(order)


def two_rings(df: DataFrame, order: str, noise: Column, capacity: int, noise_capacity: int) -> DataFrame:
    """The newest rows of a log, where noise has a ring of its own and cannot push out the rest; with dropped, the number of
    rows of its kind that have gone.
    """
    rings = []
    for kind, on, most in (("log", ~F.coalesce(noise, F.lit(False)), capacity), ("noise", F.coalesce(noise, F.lit(False)), noise_capacity)):
        own = df.where(on)
        total = own.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))
        rings.append(ring(own, order, most).withColumn("ring", F.lit(kind)).crossJoin(F.broadcast(total)))  # one row
    return merged(*rings, order)


def paired(events: DataFrame, keys: list[str], kind: str, at: str, start: str, stop: str) -> DataFrame:
    """keys, call, started, completed, ms: each start with the first end of its keys that is not earlier and that no start before took.

    Starts without an end have null ms; an end that no start took is a call of its own, from its own time. With f the first end
    not before a start, the i-th start takes the end max(f_j - j) + i over the starts up to it, so running maxima pair them.
    """
    calls = events.where(F.col(kind).isin(start, stop) & F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), (F.col(kind) == start).alias("_start"))
    # starts before ends of the same time
    order = Window.partitionBy(*keys).orderBy("_at", F.desc("_start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = calls.withColumn("_starts", F.sum(F.col("_start").cast("int")).over(order)).withColumn("_ends", F.sum((~F.col("_start")).cast("int")).over(order))
    begun = placed.where("_start").withColumn("_end", F.max(F.col("_ends") + 1 - F.col("_starts")).over(Window.partitionBy(*keys).orderBy("_starts")) + F.col("_starts"))
    ended = placed.where("NOT _start").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_ends").alias("_n"), F.col("_at").alias("_stop"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = begun.join(ended, [*same, F.col("_end") == F.col("_n")], "full")
    started = F.coalesce("_at", "_stop")
    out = both.select(*(F.coalesce(k, f"_k{i}").alias(k) for i, k in enumerate(keys)), started.alias("started"), F.col("_stop").alias("completed"))
    call = F.row_number().over(Window.partitionBy(*keys).orderBy("started", "completed"))
    return out.withColumn("call", call).withColumn("ms", ((F.col("completed").cast("double") - F.col("started").cast("double")) * 1000).cast("long"))


def tool_table(calls: DataFrame, tool: str, status: str, statuses: list[str], ms: Column, redacted: Column) -> DataFrame:
    """tool, calls, one count for each status, p50, p95, redacted."""
    times = quantiles(calls, [tool], ms, {"p50": 0.5, "p95": 0.95}).drop("n")
    mix = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), *mix, F.count_if(F.coalesce(redacted, F.lit(False))).alias("redacted")).join(times, tool)


def run_summary(runs: DataFrame, total_ms: Column, tokens_in: Column, tokens_out: Column, calls: Column, flags: dict[str, Column], statuses: dict[str, Column], price_in: float, price_out: float) -> DataFrame:
    """One row: runs, runs with usage, tokens and their means over those, model calls and their mean over runs that counted them, cost, a rate for
    each flag and status, p50 and p95 of the total time. Means and rates of no runs are null.
    """
    used = tokens_in.isNotNull() | tokens_out.isNotNull()
    sums = [F.count(F.lit(1)).alias("runs"), F.count_if(used).alias("with_usage"), F.sum(F.coalesce(tokens_in, F.lit(0))).alias("tokens_in"), F.sum(F.coalesce(tokens_out, F.lit(0))).alias("tokens_out"), F.sum(calls).alias("model_calls"), F.count(calls).alias("with_calls")]
    shares = [F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"rate_{n}") for n, c in {**flags, **statuses}.items()]
    row = runs.agg(*sums, *shares)
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    times = quantiles(runs, [], total_ms, {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("n", "timed")
    out = row.withColumns({"mean_in": mean("tokens_in", "with_usage"), "mean_out": mean("tokens_out", "with_usage"), "mean_calls": mean("model_calls", "with_calls"), "cost": F.when(F.col("with_usage") > 0, cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))})
    return out.crossJoin(times)


def series_points(runs: DataFrame, key: str, at: str, document: str, stage_keys: list[str], tokens: list[str], price_in: float, price_out: float) -> DataFrame:
    """key, at, total_ms, one column for each stage, tokens_in, tokens_out, cost from the JSON document of a run; numbers only, times to one place.

    Runs without usage have null tokens and cost. tokens names the two JSON paths of tokens in and out.
    """
    from ..functions.cells import json_number

    number = lambda path: json_number(F.col(document), path)
    times = [F.round(number("$.timings.total_ms"), 1).alias("total_ms"), *(F.round(number(f"$.timings.{k}"), 1).alias(k) for k in stage_keys)]
    used = number(tokens[0]).isNotNull() | number(tokens[1]).isNotNull()
    token = [F.when(used, F.coalesce(number(p), F.lit(0.0)).cast("long")).alias(n) for p, n in zip(tokens, ("tokens_in", "tokens_out"), strict=True)]
    return runs.select(key, at, *times, *token).withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def run_details(runs: DataFrame, key: str, document: str, allowed: list[str], steps: DataFrame, order: str, shown: list[str]) -> DataFrame:
    """key, detail, steps: the allowed scalar fields of a run's JSON as JSON, and its steps in order as a JSON array; nothing else of either is told."""
    fields = F.to_json(F.struct(*(F.get_json_object(document, f"$.{p}").alias(p.replace(".", "_")) for p in allowed)))
    listed = steps.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*shown).alias("_s")))), lambda x: x["_s"])).alias("steps"))
    return runs.select(key, fields.alias("detail")).join(listed, key, "left").withColumn("steps", F.coalesce("steps", F.lit("[]")))


def safe_fields(fields: Column, allowed: list[str], longest: int = 200) -> Column:
    """A map of log fields with the allowed names only, values clipped, null ones left out."""
    kept = F.map_filter(fields, lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.transform_values(kept, lambda _, v: F.substring(v, 1, longest))


def precedence(states: Column, order: list[str], otherwise: str) -> Column:
    """The first of the ordered states that an array holds."""
    hits = F.filter(F.array(*map(F.lit, order)), lambda s: F.array_contains(states, s))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(otherwise))
