"""Gold items of evaluations: where surface forms stand, whether specs agree, and which computed cell is the gold value."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells

#: Characters of forms that one automaton holds; more forms go in further blocks, each over all texts.
BLOCK_CHARS = 4_000_000
#: Key of a group that says a value is a difference.
DIFFERENCE = "__difference__"


def form_hits(forms: DataFrame, texts: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, form: which distinct forms (column form, in lower case) each text contains, by case-insensitive substring.

    An automaton of many patterns reads each text once, whatever their number. Forms are cut into blocks of a bounded size, each
    broadcast for a pass of its own. Null texts contain nothing; empty forms are left out.
    """
    import ahocorasick

    spark, kind = texts.sparkSession, dict(texts.dtypes)[key]
    distinct = forms.select("form").where(F.length("form") > 0).distinct()
    above = F.sum(F.length("form")).over(Window.orderBy("form"))
    total = distinct.agg(F.sum(F.length("form"))).first()[0] or 0
    placed = distinct.withColumn("_block", F.floor(above / block_chars) if total > block_chars else F.lit(0))
    schema = f"`{key}` {kind}, form string"
    out = spark.createDataFrame([], schema)
    for (block,) in placed.select("_block").distinct().collect():
        held = spark.sparkContext.broadcast([r["form"] for r in placed.where(F.col("_block") == block).select("form").collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for form in held.value:
                automaton.add_word(form, form)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    own = {form for _, form in automaton.iter((t or "").lower())}
                    rows += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, pa.string())], [key, "form"])

        out = out.unionByName(texts.select(key, F.col(text).cast("string")).mapInArrow(run, schema))
    return out


def surface_candidates(facts: DataFrame, fact: str, forms: str, texts: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """fact, key of the texts that contain all surface forms of a fact, without the pairs that are known already.

    Blank forms do not count; a fact without any other form has no candidates.
    """
    wanted = facts.select(fact, F.explode(F.array_distinct(F.transform(forms, lambda f: F.lower(f)))).alias("form")).where(F.trim("form") != "")
    wanted = wanted.withColumn("_wanted", F.count(F.lit(1)).over(Window.partitionBy(fact)))
    hits = form_hits(wanted, texts, key, text)
    whole = hits.join(wanted, "form").groupBy(fact, key).agg(F.count(F.lit(1)).alias("_n"), F.first("_wanted").alias("_wanted")).where("_n = _wanted").select(fact, key)
    return whole if known is None else whole.join(known.select(fact, key), [fact, key], "left_anti")


# ---- specs

FILTER = "struct<column:string,op:string,value:string,values:array<string>,operands:array<string>>"
SPEC = f"struct<filters:array<{FILTER}>,metrics:array<struct<fn:string,column:string,condition:{FILTER}>>,metric:struct<fn:string,column:string,condition:{FILTER}>,group_by:array<string>,compare_column:string,group_a:string,group_b:string>"


def filter_key(f: Column) -> Column:
    """Canonical text of a filter: operands as a set of canonical values, ``in`` of one as ``eq``, ``not_in`` of one as ``ne``."""
    given = F.coalesce(f["operands"], f["values"], F.when(f["value"].isNotNull(), F.array(f["value"])), F.array().cast("array<string>"))
    op = F.when((F.size(given) == 1) & (f["op"] == "in"), "eq").when((F.size(given) == 1) & (f["op"] == "not_in"), "ne").otherwise(f["op"])
    return F.to_json(F.struct(f["column"].alias("c"), op.alias("o"), as_set(F.transform(given, lambda v: F.coalesce(cells.canonical(v), F.lit("")))).alias("v")))


def as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))


def metric_key(m: Column) -> Column:
    """Canonical text of a metric; a share is told by its condition, other functions by their column."""
    share = F.concat(F.lit("share:"), F.coalesce(F.when(m["condition"].isNotNull(), filter_key(m["condition"])), F.lit("")))
    return F.when(m["fn"] == "share", share).otherwise(F.concat_ws(":", m["fn"], m["column"]))


def spec_components(df: DataFrame, gold_tool: str, gold_spec: str, tool: str, spec: str) -> DataFrame:
    """df with filter_ok, aggregation_ok, grouping_ok of a spec (JSON text) against a gold spec.

    Filters agree as sets of canonical filters, whatever their order and form. All gold metrics must be among the spec's. A
    comparison agrees in its column and the set of its two sides, an aggregate in the set of its columns. For a
    listing, aggregation and grouping are not judged (null).
    """
    read = df.withColumn("_g", F.from_json(gold_spec, SPEC)).withColumn("_s", F.from_json(spec, SPEC))
    filters = lambda c: as_set(F.transform(F.coalesce(F.col(c)["filters"], F.array().cast(f"array<{FILTER}>")), filter_key))

    def metrics(c: str, of: str) -> Column:
        one = F.when(F.col(c)["metric"].isNotNull(), F.array(metric_key(F.col(c)["metric"])))
        return as_set(F.when(F.col(of) == "group_compare", one).otherwise(F.transform(F.col(c)["metrics"], metric_key)))

    gold, own = metrics("_g", gold_tool), metrics("_s", tool)
    sides = lambda c: as_set(F.array(*(F.coalesce(cells.canonical(F.col(c)[g]), F.lit("")) for g in ("group_a", "group_b"))))
    compared = (F.col(tool) == "group_compare") & F.col("_g")["compare_column"].eqNullSafe(F.col("_s")["compare_column"]) & (sides("_g") == sides("_s"))
    grouped = (F.col(tool) == "aggregate") & (as_set(F.col("_g")["group_by"]) == as_set(F.col("_s")["group_by"]))
    listing = F.col(gold_tool) == "filter_rows"
    out = {
        "filter_ok": filters("_g") == filters("_s"),
        "aggregation_ok": F.when(~listing, (F.size(gold) > 0) & (F.size(F.array_except(gold, own)) == 0)),
        "grouping_ok": F.when(~listing, F.when(F.col(gold_tool) == "group_compare", compared).otherwise(grouped)),
    }
    return read.withColumns(out).drop("_g", "_s")


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(cells.number(a) == cells.number(b), F.lit(False))


def group_agrees(gold: Column, cell: Column) -> Column:
    """Groups (maps of text) agree where they share a key, or one has none, and say the same under all shared keys; a difference only meets a difference."""
    empty = F.create_map().cast("map<string,string>")
    g, c = F.coalesce(gold, empty), F.coalesce(cell, empty)
    shared = F.array_intersect(F.map_keys(g), F.map_keys(c))
    same = F.forall(shared, lambda k: cells.canonical(F.try_element_at(g, k)).eqNullSafe(cells.canonical(F.try_element_at(c, k))))
    apart = (F.size(g) > 0) & (F.size(c) > 0) & (F.size(shared) == 0)
    return (F.map_contains_key(g, DIFFERENCE) == F.map_contains_key(c, DIFFERENCE)) & ~apart & same


def match_gold(gold: DataFrame, cells_: DataFrame, item: str, fact: str) -> DataFrame:
    """item, fact, place, exact_equal, rounded_equal, denominator_ok, unit_ok: the best cell of each gold value; place is null without one.

    gold: item, fact, dataset, tool, fn, column, group, value, exact, denominator, unit. cells_: item, place, dataset, operation, fn,
    column, group, value, exact, denominator, unit; values are text. Metrics agree by function and, but for shares, by
    column where the gold has one; in listings by column. Of the cells whose exact or shown value agrees, one that agrees
    in both is best, then the first in place. A gold value without numbers meets a cell without.
    """
    g, c = gold.alias("g"), cells_.alias("c")
    listing = (F.col("g.tool") == "filter_rows") | (F.col("c.operation") == "filter_rows")
    listed = (F.col("c.operation") == "filter_rows") & F.col("g.column").eqNullSafe(F.col("c.column"))
    fn = F.col("g.fn").isNull() | F.col("c.fn").eqNullSafe(F.col("g.fn"))
    column = F.coalesce(F.col("g.fn") == "share", F.lit(False)) | F.col("g.column").isNull() | F.col("c.column").eqNullSafe(F.col("g.column"))
    metric = F.when(listing, listed).otherwise(fn & column)
    empty = F.col("g.value").isNull() & F.col("g.exact").isNull()
    none = F.col("c.value").isNull() & F.col("c.exact").isNull()
    exact = F.when(empty, none).otherwise(same_number(F.col("c.exact"), F.col("g.exact")))
    text = cells.canonical(F.col("c.value")).eqNullSafe(cells.canonical(F.col("g.value")))
    shown = F.when(empty, none).when(cells.number(F.col("g.value")).isNull(), text).otherwise(same_number(F.col("c.value"), F.col("g.value")))
    on = (F.col(f"g.{item}") == F.col(f"c.{item}")) & F.col("g.dataset").eqNullSafe(F.col("c.dataset"))
    denominator = F.when(F.col("g.denominator").isNotNull(), F.col("c.denominator").eqNullSafe(F.col("g.denominator")))
    unit = F.when(F.col("c.unit").isNotNull(), F.col("c.unit").eqNullSafe(F.col("g.unit")))
    pairs = g.join(c, on).where(metric & group_agrees(F.col("g.group"), F.col("c.group")))
    judged = pairs.select(F.col(f"g.{item}").alias(item), F.col(f"g.{fact}").alias(fact), F.col("c.place").alias("place"), exact.alias("exact_equal"), shown.alias("rounded_equal"), denominator.alias("denominator_ok"), unit.alias("unit_ok"))
    agree = F.col("exact_equal").cast("int") + F.col("rounded_equal").cast("int")
    best = judged.where(agree > 0).groupBy(item, fact).agg(F.min(F.struct((-agree).alias("a"), "place", "exact_equal", "rounded_equal", "denominator_ok", "unit_ok")).alias("b"))
    out = gold.select(item, fact).join(best, [item, fact], "left")
    no = F.lit(False)
    found = F.col("b").isNotNull()
    return out.select(
        item, fact, F.col("b.place").alias("place"), F.coalesce("b.exact_equal", no).alias("exact_equal"), F.coalesce("b.rounded_equal", no).alias("rounded_equal"),
        F.when(found, F.col("b.denominator_ok")).otherwise(no).alias("denominator_ok"), F.when(found, F.col("b.unit_ok")).otherwise(no).alias("unit_ok"),
    )
