"""Tabular analytics: filters, grouped metrics, comparison of two groups, row listing and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.spec import MAX_GROUPS, Aggregate, ColumnInfo, Compare, Filter, Listing, Metric
from .totals import values_at

#: Order in which warnings are told.
WARNINGS = ("EMPTY_SELECTION", "NULLS_EXCLUDED", "ZERO_DENOMINATOR", "GROUPS_TRUNCATED")


def cell(col: ColumnInfo) -> Column:
    """Typed cell: a number, or text; null where it has no value of the column's kind."""
    return cells.number(F.col(col.name)) if col.kind == "numeric" else cells.canonical(F.col(col.name))


def predicate(f: Filter) -> Column:
    """A filter as a condition that is never null: without a cell only is_null holds."""
    if f.op in ("is_null", "not_null"):
        return cell(f.column).isNull() if f.op == "is_null" else cell(f.column).isNotNull()
    if f.column.kind == "date" and f.op in ("gt", "gte", "lt", "lte", "between"):
        return F.coalesce(_period(f), F.lit(False))
    x = cell(f.column)
    v = [F.lit(y).cast("decimal(38,10)") if f.column.kind == "numeric" else F.lit(y) for y in f.values]
    made = {
        "eq": lambda: x == v[0], "ne": lambda: x != v[0], "in": lambda: x.isin(*v), "not_in": lambda: ~x.isin(*v), "gt": lambda: x > v[0],
        "gte": lambda: x >= v[0], "lt": lambda: x < v[0], "lte": lambda: x <= v[0], "between": lambda: x.between(v[0], v[1]),
    }[f.op]()
    return F.coalesce(made, F.lit(False))


#: Column types whose bare comparison a file reader can use.
PLAIN = ("int", "bigint", "smallint", "double")


def scan_hint(f: Filter, dtype: str) -> Column | None:
    """A bare comparison that every row of the filter meets, so that the reader of files can skip what cannot; else None.

    It stands beside the exact predicate, which alone decides: bounds are widened by one part in 10 ** 9, as cells are
    compared as decimals and columns may be binary numbers.
    """
    if f.column.kind != "numeric" or dtype not in PLAIN or f.op not in ("eq", "gt", "gte", "lt", "lte", "between", "in"):
        return None
    x, v = F.col(f.column.name), [float(y) for y in f.values]
    low, high = min(v) - abs(min(v)) * 1e-9 - 1e-9, max(v) + abs(max(v)) * 1e-9 + 1e-9
    return {"gt": x >= low, "gte": x >= low, "lt": x <= high, "lte": x <= high}.get(f.op, (x >= low) & (x <= high))


def _period(f: Filter) -> Column:
    """Date predicates: the period of the cell must lie wholly inside what is asked for."""
    start, end = cells.period_start(F.col(f.column.name)), cells.period_end(F.col(f.column.name))
    low, high = (fn(F.lit(f.values[0])) for fn in (cells.period_start, cells.period_end))
    if f.op == "between":
        return (start >= low) & (end <= cells.period_end(F.lit(f.values[1])))
    return {"gte": start >= low, "gt": start > high, "lte": end <= high, "lt": end < low}[f.op]


def select(df: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    """Rows that meet all filters; comparisons of plain numbers reach the reader as well."""
    kinds = dict(df.dtypes)
    hints = [h for h in (scan_hint(f, kinds[f.column.name]) for f in filters) if h is not None]
    return df.where(cells.all_of([*hints, *(predicate(f) for f in filters)])) if filters else df


def _parts(m: Metric, i: int, also: Column | None = None) -> list[Column]:
    """Aggregates that a metric needs (all but medians); also restricts them to some rows."""
    on = (lambda c: c) if also is None else (lambda c: F.when(also, c))
    rows = F.count(on(F.lit(1)))
    if m.column is None:
        return [rows.alias(f"n{i}"), rows.alias(f"x{i}"), rows.alias(f"rows{i}")]
    x = cell(m.column)
    out = [F.count(on(x)).alias(f"n{i}"), rows.alias(f"rows{i}")]
    if m.fn == "count":
        out.append(F.count(on(x)).alias(f"x{i}"))
    elif m.fn == "count_distinct":
        out.append(F.count_distinct(on(cells.canonical(F.col(m.column.name)) if m.column.kind != "numeric" else x)).alias(f"x{i}"))
    elif m.fn == "share":
        out.append(F.count(on(F.when(predicate(m.condition), 1))).alias(f"x{i}"))
    elif m.fn in ("sum", "mean"):
        out.append(F.sum(on(x)).alias(f"x{i}"))
    elif m.fn in ("min", "max"):
        out.append((F.min if m.fn == "min" else F.max)(on(x)).alias(f"x{i}"))
    if m.column.kind == "numeric" and m.fn == "sum":
        out.append(F.bool_and(on(x == F.floor(x))).alias(f"whole{i}"))
    return out


def _value(m: Metric, i: int) -> dict[str, Column]:
    """exact and shown value, numerator and denominator of a metric from its aggregates."""
    n, x = F.col(f"n{i}"), F.col(f"x{i}")
    none = F.lit(None)
    if m.fn in ("count", "count_distinct"):
        return {"value": x.cast("double"), "denominator": n, "numerator": none.cast("long")}
    if m.fn == "share":
        share = (F.lit(100).cast("decimal(38,10)") * x / F.when(n != 0, n)).cast("decimal(38,10)")
        return {"value": cells.half_even(share, 1), "denominator": n, "numerator": F.when(n == 0, F.lit(0)).otherwise(x).cast("long")}
    if m.column.kind == "date":
        return {"value": x, "denominator": n, "numerator": none.cast("long")}
    exact = (x / F.when(n != 0, n)).cast("decimal(38,10)") if m.fn == "mean" else x
    if m.fn == "sum":
        value = F.when(F.col(f"whole{i}"), cells.half_even(exact, m.places(True))).otherwise(cells.half_even(exact, m.places(False)))
    else:
        value = cells.half_even(exact, m.places(False))
    return {"value": value, "denominator": n, "numerator": none.cast("long")}


def _medians(df: DataFrame, keys: list[str], m: Metric, i: int) -> DataFrame:
    """Exact medians: distinct values are counted, then sorted by ranges over all tasks."""
    lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    grouped = values_at(df, keys, cell(m.column), {"_l": lower, "_u": upper})
    return grouped.select(*keys, ((F.col("_l") + F.col("_u")) / 2).cast("decimal(38,10)").alias(f"x{i}"))


def _warnings(metrics: tuple[Metric, ...], matched: Column) -> Column:
    """Warnings of a row of aggregates, in their fixed order."""
    zero = reduce(lambda a, b: a | b, [(F.col(f"n{i}") == 0) & F.lit(m.fn not in ("count", "count_distinct")) for i, m in enumerate(metrics)])
    nulls = reduce(lambda a, b: a | b, [F.col(f"n{i}") < F.col(f"rows{i}") for i in range(len(metrics))])
    flags = {"EMPTY_SELECTION": matched == 0, "ZERO_DENOMINATOR": zero, "NULLS_EXCLUDED": nulls}
    return F.array_compact(F.array(*[F.when(flags[w], F.lit(w)) for w in WARNINGS if w in flags]))


def aggregate(df: DataFrame, plan: Aggregate, row_number: str | None = None) -> DataFrame:
    """Group columns, then value_i, denominator_i, numerator_i of each metric, and warnings.

    Cells of one canonical form are one group, shown as first seen (by row_number, else by the smallest text). Groups
    come in their order, nulls last, or reversed with nulls first; by value nulls come last and ties keep the group
    order. warnings are those of the row; cap_exceeded tells that the default cap of groups cut the result, which
    GROUPS_TRUNCATED says in the warnings as well.
    """
    chosen = select(df, plan.filters)
    keys = [f"_k{i}" for i in range(len(plan.group_by))]
    for k, c in zip(keys, plan.group_by, strict=True):
        own = cell(c)
        raw = cells.canonical(F.col(c.name))
        chosen = chosen.withColumn(k, F.coalesce(F.concat(F.lit("n"), cells.exact_text(own)), F.concat(F.lit("t"), raw)) if c.kind == "numeric" else F.concat(F.lit("t"), raw))
    first = F.col(row_number) if row_number else None
    shown = [(F.min_by(cells.present(F.col(c.name)), first) if first is not None else F.min(cells.present(F.col(c.name)))).alias(c.name) for c in plan.group_by]
    aggs = [a for i, m in enumerate(plan.metrics) for a in _parts(m, i)]
    out = chosen.groupBy(*keys).agg(*shown, F.count(F.lit(1)).alias("_matched"), *aggs)
    for i, m in enumerate(plan.metrics):
        if m.fn == "median":
            med = _medians(chosen, keys, m, i)
            if keys:
                med = med.select(*[F.col(k).alias(f"m{k}") for k in keys], f"x{i}")
                out = out.join(med, cells.all_of([F.col(k).eqNullSafe(F.col(f"m{k}")) for k in keys]), "left").drop(*[f"m{k}" for k in keys])
            else:
                out = out.crossJoin(F.broadcast(med))  # one row
    values = [c.alias(f"{n}_{i}") for i, m in enumerate(plan.metrics) for n, c in _value(m, i).items()]
    out = out.select(*[c.name for c in plan.group_by], *values, _warnings(plan.metrics, F.col("_matched")).alias("warnings"))
    if not plan.group_by:
        return out
    cap = plan.limit or MAX_GROUPS
    top = out.orderBy(*order(plan)).limit(cap + (plan.limit is None))
    # at most 51 rows from here on
    w = Window.partitionBy(F.lit(0)).orderBy(*order(plan))
    top = top.withColumn("_at", F.row_number().over(w)).withColumn("cap_exceeded", F.max("_at").over(Window.partitionBy(F.lit(0))) > cap)
    told = F.when(F.col("cap_exceeded"), F.array_append("warnings", F.lit("GROUPS_TRUNCATED"))).otherwise(F.col("warnings"))
    return top.withColumn("warnings", told).where(F.col("_at") <= cap).orderBy("_at").drop("_at")


def sort_keys(name: str, descending: bool = False) -> list[Column]:
    """Mixed cells: numbers before text before null; the reverse when descending."""
    num, text = cells.number(F.col(name)), cells.present(F.col(name))
    rank = F.when(num.isNotNull(), 0).when(text.isNotNull(), 1).otherwise(2)
    return [rank.desc(), num.desc(), text.desc()] if descending else [rank.asc(), num.asc(), text.asc()]


def order(plan: Aggregate) -> list[Column]:
    groups = [k for c in plan.group_by for k in sort_keys(c.name, plan.descending and plan.order_by == "group")]
    if plan.order_by == "group":
        return groups
    value = F.col(f"value_{plan.order_metric}")
    return [value.desc_nulls_last() if plan.descending else value.asc_nulls_last(), *groups]


def compare(df: DataFrame, plan: Compare) -> DataFrame:
    """One row: value_a, value_b, denominator_a, denominator_b, difference, in one pass over the rows."""
    chosen = select(df, plan.filters)
    m = plan.metric
    sides = [predicate(Filter(plan.column, "eq", (v,))) for v in (plan.a, plan.b)]
    if m.fn == "median":
        frames = [_medians(chosen.where(s), [], m, i).crossJoin(chosen.where(s).agg(*_parts(m, i))) for i, s in enumerate(sides)]
        out = frames[0].crossJoin(frames[1])
    else:
        out = chosen.agg(*[p for i, s in enumerate(sides) for p in _parts(m, i, s)])
    a, b = (_exact(m, i) for i in (0, 1))
    diff = (a - b).cast("decimal(38,10)")
    value = [_value(m, i) for i in (0, 1)]
    places = 0 if m.fn in ("count", "count_distinct") else m.places(False)
    return out.select(
        value[0]["value"].alias("value_a"), value[1]["value"].alias("value_b"), F.col("n0").alias("denominator_a"), F.col("n1").alias("denominator_b"),
        cells.half_even(diff, places).alias("difference"), (F.col("n0") + F.col("n1")).alias("denominator"),
    )


def _exact(m: Metric, i: int) -> Column:
    n, x = F.col(f"n{i}"), F.col(f"x{i}")
    if m.fn == "share":
        return (F.lit(100).cast("decimal(38,10)") * x / F.when(n != 0, n)).cast("decimal(38,10)")
    return (x / F.when(n != 0, n)).cast("decimal(38,10)") if m.fn == "mean" else x.cast("decimal(38,10)")


def list_rows(df: DataFrame, plan: Listing, row_number: str) -> DataFrame:
    """The first rows by a column, nulls last either way, ties by row number; cells are clipped."""
    chosen = select(df, plan.filters)
    keys = []
    if plan.order_by is not None:
        x = cell(plan.order_by)
        keys = [x.desc_nulls_last() if plan.descending else x.asc_nulls_last()]
    return chosen.orderBy(*keys, F.col(row_number)).limit(plan.limit).select(F.col(row_number), *[cells.clipped(F.col(c.name)).alias(c.name) for c in plan.columns if c.name != row_number])


def profile(df: DataFrame, columns: list[str], row_number: str, max_levels: int = 12) -> DataFrame:
    """column, kind, role, non_empty, distinct, levels of each column.

    Numeric: 90 % of the present cells are numbers. Date: all are YYYY-MM[-DD]. Else by lengths and repetition:
    constant, identifier, free text, or categorical with its most frequent levels, ties by first row.
    """
    long = df.select(F.col(row_number).alias("_row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cells.present(F.col(c)).alias("v")) for c in columns])).alias("_c")).select("_row", "_c.*")
    by_value = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"), F.min("_row").alias("first"))
    v, c = F.col("v"), F.col("c")
    stats = by_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), c)), F.lit(0)).alias("non_empty"),
        F.count(v).alias("distinct"),
        F.coalesce(F.sum(F.when(cells.number(v).isNotNull(), c)), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum(F.when(v.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), c)), F.lit(0)).alias("dates"),
        F.coalesce(F.sum(F.when(v.isNotNull(), F.length(v) * c)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(v.rlike(r"\s"), c)), F.lit(0)).alias("spaced"),
        F.coalesce(F.sum(F.when(F.trim(v).contains(" "), c)), F.lit(0)).alias("worded"),
    )
    n, d = F.col("non_empty"), F.col("distinct")
    role = (
        F.when(n == 0, "context")
        .when(F.col("numbers") >= 0.9 * n, "numeric")
        .when(F.col("dates") == n, "date")
        .when((d == 1) & (n > 1), "constant")
        .when((d == n) & (n > 1) & (F.col("spaced") == 0) & (F.col("chars") <= 64 * n), "identifier")
        .when((F.col("chars") > 40 * n) & (F.col("worded") >= 0.5 * n), "free_text")
        .otherwise("context")
    )
    kind = F.when(n == 0, "text").when(F.col("role").isin("numeric", "date"), F.col("role")).when(F.col("role").isin("identifier", "free_text"), "text").otherwise("categorical")
    w = Window.partitionBy("column").orderBy(F.desc("c"), "first")
    levels = by_value.where(v.isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_levels).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda x: x["v"]).alias("levels"))
    out = stats.withColumn("role", role).withColumn("kind", kind).join(levels, "column", "left")
    return out.select("column", "kind", "role", "non_empty", "distinct", F.when(F.col("kind") == "categorical", F.col("levels")).alias("levels"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low, n of equal-width bins; the last one is closed. Empty bins are left out."""
    x = cells.number(F.col(column)).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) / width)))
    return df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin"), (F.col("lo") + at * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Shares of the groups' sums with running offsets, largest first; one row for each group is sorted."""
    sums = df.groupBy(group).agg(F.sum(value).alias("v"))
    all_ = Window.partitionBy(F.lit(0))
    run = all_.orderBy(F.desc("v"), group).rowsBetween(Window.unboundedPreceding, -1)
    share = (100 * F.col("v") / F.sum("v").over(all_)).cast("decimal(38,10)")
    start = (100 * F.coalesce(F.sum("v").over(run), F.lit(0)) / F.sum("v").over(all_)).cast("decimal(38,10)")
    return sums.select(group, cells.half_even(share, 3).alias("share"), cells.half_even(start, 3).alias("start"))


def compare_pinned(computed: DataFrame, pinned: DataFrame, keys: list[str]) -> DataFrame:
    """computed, mismatch or unavailable for each pinned row (keys, value)."""
    got = computed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_value"))
    same = cells.all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    state = F.when(F.col("_value").isNull(), "unavailable").when(F.col("_value") == F.col("value"), "computed").otherwise("mismatch")
    return pinned.join(got, same, "left").select(*keys, state.alias("state"))


def bounded(df: DataFrame, budget: int, order_by: list[str]) -> DataFrame:
    """The leading rows whose JSON texts fit a budget of characters together, and truncated: whether any row was left out.

    A row takes two characters at least, so no more than half the budget of rows can fit: the top of the order is cut
    there before the running sum.
    """
    df = df.orderBy(*order_by).limit(budget // 2 + 1)
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    every = Window.partitionBy(F.lit(0))
    sized = df.withColumn("_total", F.sum(size).over(every.orderBy(*order_by)))
    return sized.withColumn("truncated", F.max("_total").over(every) > budget).where(F.col("_total") <= budget).drop("_total")


def grouped_series(df: DataFrame, first: str, second: str, value: str, most_series: int = 6) -> DataFrame | None:
    """series, category, value of a result grouped by two columns: the one with fewer values makes the series, the first if they tie.

    Every series has every category in the order of first appearance (series_at, category_at), with null where the result has no
    cell. None where there would be more than ``most_series`` series or none. df: at most some dozens of rows, with ``at``,
    their order.
    """
    sizes = df.agg(F.count_distinct(F.col(first)).alias("a"), F.count_distinct(F.col(second)).alias("b")).first()
    series, category = (second, first) if sizes["b"] < sizes["a"] else (first, second)
    if not 0 < min(sizes["a"], sizes["b"]) <= most_series:
        return None
    placed = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.min("at").alias("_at")).withColumn(f"{name}_at", F.row_number().over(Window.orderBy("_at"))).drop("_at")
    grid = placed(series, "series").crossJoin(F.broadcast(placed(category, "category")))
    cell = df.groupBy(F.col(series).alias("series"), F.col(category).alias("category")).agg(F.min_by(value, "at").alias("value"))
    return grid.join(cell, ["series", "category"], "left")


def table_block(df: DataFrame, order_by: list[str], most: int = 10) -> tuple[DataFrame, str | None]:
    """The first rows of a result as a table, and a note where it has more."""
    head = df.orderBy(*order_by).limit(most)
    n = df.count()
    return head, f"showing {most} of {n} rows" if n > most else None
