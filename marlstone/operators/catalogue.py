"""Sources and their versions as a catalogue: newest versions, visible children, datasets, row units and users of analyses.

Counts are made before they are joined, so a catalogue row costs one shuffle of the children by their version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READY = ("ready", "ready_degraded")


def newest_versions(sources: DataFrame, versions: DataFrame, source: str, version: str) -> DataFrame:
    """sources with the columns of their newest version; sources without one are left out.

    The newest row is found by a partial aggregate, not a sort. Of rows with one version number, the greatest row stays.
    """
    others = [c for c in versions.columns if c not in (source, version)]
    best = versions.groupBy(source).agg(F.max(F.struct(version, *others)).alias("_v")).select(source, "_v.*")
    return sources.join(best, source)


def visible_children(children: DataFrame, active: DataFrame, version: str, level: str, levels: list[str], ceiling: str, group: str | None = None, wanted: list[str] = ()) -> DataFrame:
    """Children of active versions, not above the ceiling, of the wanted classes (all where none is named)."""
    out = children.where(F.col(level).isin(levels[: levels.index(ceiling) + 1]))
    out = out.where(F.col(group).isin(list(wanted))) if group and wanted else out
    return out.join(active.select(version).distinct(), version, "left_semi")


def catalogue(sources: DataFrame, versions: DataFrame, parents: DataFrame, source: str, version: str, status: str, most: int | None = None) -> DataFrame:
    """source, version (the newest ready one), parents of the sources that have a ready version; 0 without parents."""
    ready = versions.where(F.col(status).isin(*READY)).groupBy(source).agg(F.max(version).alias(version))
    counts = parents.groupBy(version).agg(F.count(F.lit(1)).alias("parents"))
    out = sources.select(source).join(ready, source).join(counts, version, "left").select(source, version, F.coalesce("parents", F.lit(0)).alias("parents"))
    return out.orderBy(source).limit(most) if most else out


def dataset_ids(tables: DataFrame, code: str, sheet: str) -> DataFrame:
    """tables with dataset, their public id CODE:sheet."""
    return tables.withColumn("dataset", F.concat_ws(":", F.col(code).cast("string"), F.col(sheet).cast("string")))


def described(tables: DataFrame, dataset: str | None, columns: str) -> DataFrame:
    """The schema of one dataset, or the list of all without their columns."""
    return tables.drop(columns) if dataset is None else tables.where(F.col("dataset") == dataset)


def rows_of(rows: DataFrame, table: str, wanted, n_rows: int, most: int = 20_000) -> DataFrame:
    """Rows of a table. The table's recorded size is checked against the scan limit, so that nothing is read to refuse."""
    if n_rows > most:
        raise ValueError(f"dataset exceeds the scan limit ({most} rows)")
    return rows.where(F.col(table) == wanted)


def run_filter(runs: DataFrame, at: str, since, until, equal: dict[str, object]) -> DataFrame:
    """Runs of a half-open time range and of given modes or statuses; comparisons of bare columns, so that the scan gets them."""
    out = runs.where((F.col(at) >= F.lit(since)) & (F.col(at) < F.lit(until)))
    for name, value in equal.items():
        out = out if value is None else out.where(F.col(name) == F.lit(value))
    return out


def used_by(users: DataFrame, user: str, kind: str, uses: str) -> DataFrame:
    """use, kind, users: who reads each analysis, each user once, in order."""
    each = users.select(user, kind, F.explode(F.array_distinct(uses)).alias("use"))
    return each.groupBy("use", kind).agg(F.array_sort(F.collect_set(user)).alias("users"))


def row_units(rows: DataFrame, key: str, title: str, columns: list[str], identifiers: list[str], context: list[str], free: str | None) -> DataFrame:
    """key, text, retrieval, char_start, char_end: each row as a passage, and the passage that is searched for it.

    text lists the cells that are not null as "name: value"; the span is that of the free-text cell in it. retrieval leads
    with the title and the identifying and context cells. Rows without free text have no retrieval and no span.
    """
    shown = lambda c: F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))
    pair = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    joined = lambda parts: F.array_join(F.array_compact(F.array(*parts)), ", ")
    text = F.array_join(F.array_compact(F.array(*map(shown, columns))), "; ")
    if free is None:
        none = F.lit(None)
        return rows.select(key, text.alias("text"), none.cast("string").alias("retrieval"), none.cast("int").alias("char_start"), none.cast("int").alias("char_end"))
    before = columns[: columns.index(free)]
    # the empty string at the front stands for the separator before the free-text cell
    lead = F.length(F.array_join(F.array_compact(F.array(F.lit(""), *map(shown, before))), "; "))
    start = lead + len(f"{free}: ")
    there = F.col(free).isNotNull()
    head = F.array_join(F.filter(F.array(F.lit(title), joined([*map(pair, identifiers), *map(pair, context)])), lambda p: p != ""), " | ")
    return rows.select(
        key,
        text.alias("text"),
        F.when(there, F.concat(head, F.lit(f" | {free}: "), F.col(free).cast("string"))).alias("retrieval"),
        F.when(there, start).alias("char_start"),
        F.when(there, start + F.length(F.col(free).cast("string"))).alias("char_end"),
    )


def table_summary(profile: DataFrame, table: str, column: str, role: str, levels: str, at: str, rows: DataFrame, title: str) -> DataFrame:
    """table, summary: one sentence of a table's rows and columns. rows holds table, n_rows."""
    words = F.when((F.col(role) == "context") & (F.size(levels) > 0), F.concat(F.lit("categorical: "), F.array_join(levels, ", "))).otherwise(F.regexp_replace(role, "free_text", "free text"))
    each = profile.select(table, at, F.concat(F.col(column), F.lit(" ("), words, F.lit(")")).alias("_c"))
    listed = each.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(at, "_c"))).alias("_l")).join(rows, table)
    text = F.concat(F.lit("Table '"), F.col(table), F.lit(f"' in {title}: "), F.col("n_rows"), F.lit(" data rows. Columns: "), F.array_join(F.col("_l._c"), "; "), F.lit("."))
    return listed.select(table, text.alias("summary"))


def embedding_input(title: Column, heading: Column, text: Column, separator: str = " > ") -> Column:
    """What is embedded for a child: its source and heading, those that are not empty, above its text."""
    parts = F.filter(F.array(title, heading), lambda p: p.isNotNull() & (p != ""))
    return F.concat(F.array_join(parts, separator), F.lit("\n"), text)


def anchor_window(text: Column, tokens: Column, start: Column, end: Column, most: int) -> Column:
    """Struct of lo, hi (null where the whole text fits) and window: some ``most`` tokens about an anchor's span.

    The anchor is always whole, and both ends move outwards to white space, so no word is cut.
    """
    n = F.length(text)
    width = F.floor(F.lit(most) * n / F.greatest(tokens, F.lit(1))).cast("int")
    left = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - F.floor(width / 2).cast("int"))
    right = F.least(n, left + width)
    left, right = F.least(F.greatest(F.lit(0), right - width), start), F.greatest(right, end)
    lo = left - F.length(F.regexp_extract(F.substring(text, F.lit(1), left), r"\S*\z", 0))
    hi = right + F.length(F.regexp_extract(F.substring(text, right + 1, n), r"\A\S*", 0))
    whole = (tokens <= most) | (n == 0)
    cut = F.regexp_replace(F.substring(text, lo + 1, hi - lo), r"\A\s+|\s+\z", "")
    return F.when(whole, F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), text.alias("window"))).otherwise(F.struct(lo.alias("lo"), hi.alias("hi"), cut.alias("window")))


def quote_span(text: Column, quote: Column) -> Column:
    """Struct of char_start, char_end of the first place of a quote, white space apart; null where it does not stand."""
    quote = F.regexp_replace(F.regexp_replace(F.coalesce(quote, F.lit("")), r"\A\s+|\s+\z", ""), r"\\E", r"\\E\\\\E\\Q")
    pattern = F.concat(F.lit(r"\Q"), F.regexp_replace(quote, r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    at = F.regexp_instr(text, pattern)
    found = F.length(F.regexp_substr(text, pattern))
    return F.when((quote != "") & (at > 0), F.struct((at - 1).alias("char_start"), (at - 1 + found).alias("char_end")))


def next_cursor(before: Column, last_seen: Column, latest: Column, n: Column, limit: int, incremental: bool = True) -> Column:
    """Cursor after a poll: the last row seen of a full page, else the newest of the buffer; it never moves back."""
    page = F.when(n >= limit, last_seen).otherwise(F.coalesce(latest, last_seen)) if incremental else F.coalesce(latest, last_seen)
    return F.coalesce(F.greatest(before, page), before, page)


def recent(turns: DataFrame, conversation: str, turn: str, question: str, keep: int = 3) -> DataFrame:
    """turns with recent: the last ``keep`` questions of the conversation up to this one, oldest first."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(1 - keep, 0)
    return turns.withColumn("recent", F.collect_list(question).over(w))
