"""Evidence by handle or by word: units with their neighbours, spans and versions, and exhaustive keyword hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import handle_parts, is_handle

#: Characters of a neighbour that are shown, and the longest search term.
EXCERPT, LONGEST_TERM = 200, 60
PURGED = "purged"


def resolve(requested: DataFrame, handle: str, parents: DataFrame, children: DataFrame, versions: DataFrame, child: str | None = None) -> DataFrame:
    """requested with state, text, previous_excerpt, next_excerpt, children, highlight, version, latest_version, is_latest.

    parents: handle, source, version, ordinal, text; children: handle, child, ordinal, char_start, char_end; versions: source, version,
    status. state is malformed, deleted (its version is purged), missing, or found; only what is found has a text.
    Neighbours are the units of the version one place before and after; the last and first characters of theirs are
    shown. children are in order; highlight is the part of the text that the requested child stands for, null where it
    is none of its parent's.
    """
    versions = versions.select(F.col("source").alias("_source"), F.col("version").alias("_version"), "status")
    newest = versions.groupBy("_source").agg(F.max("_version").alias("latest_version"))
    by_place = Window.partitionBy("source", "version").orderBy("ordinal")

    def beside(step: int) -> Column:
        text, at = F.lag("text", step).over(by_place), F.lag("ordinal", step).over(by_place)
        return F.when(at == F.col("ordinal") - step, text)

    units = parents.select("handle", "source", "version", "ordinal", "text")
    placed = units.withColumn("previous_excerpt", F.nullif(F.right(beside(1), F.lit(EXCERPT)), F.lit(""))).withColumn("next_excerpt", F.nullif(F.left(beside(-1), F.lit(EXCERPT)), F.lit("")))
    spans = children.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("ordinal", "child", "char_start", "char_end"))).alias("children"))
    known = placed.join(spans, "handle", "left").withColumnRenamed("handle", "_handle").drop("source", "version", "ordinal")

    asked = requested.withColumn("_p", handle_parts(F.col(handle)))
    versioned = asked.join(versions, (F.col("_p.source") == F.col("_source")) & (F.col("_p.version") == F.col("_version")), "left").drop("_source", "_version")
    found = versioned.join(newest, F.col("_p.source") == F.col("_source"), "left").drop("_source").join(known, F.col(handle) == F.col("_handle"), "left")
    state = F.when(~is_handle(F.col(handle)), "malformed").when(F.col("status") == PURGED, "deleted").when(F.col("_handle").isNull() | F.col("status").isNull(), "missing").otherwise("found")
    out = found.withColumn("state", state)
    shown = lambda c: F.when(F.col("state") == "found", F.col(c)).alias(c)
    own = F.get(F.filter("children", lambda x: x["child"] == F.col(child)), F.lit(0)) if child else None
    mark = F.substr("text", (own["char_start"] + 1).cast("int"), (own["char_end"] - own["char_start"]).cast("int")) if child else F.lit(None).cast("string")
    return out.select(
        *requested.columns, "state", *(shown(c) for c in ("text", "previous_excerpt", "next_excerpt", "children")), F.when(F.col("state") == "found", mark).alias("highlight"),
        F.col("_p.version").alias("version"), shown("latest_version"), F.when(F.col("state") == "found", F.col("_p.version") == F.col("latest_version")).alias("is_latest"),
    )


def keyword_terms(terms: list[str]) -> list[str]:
    """Terms in lower case with white space runs as one blank, each once, in order; blank or overlong ones are refused."""
    flat = [" ".join(t.split()) for t in terms]
    if any(not t or len(t) > LONGEST_TERM for t in flat):
        raise ValueError(f"each term must have 1 to {LONGEST_TERM} characters")
    return list(dict.fromkeys(t.lower() for t in flat))


def keyword_hits(parents: DataFrame, terms: list[str], match: str = "all") -> DataFrame:
    """parents that hold all terms, any, or the terms as one phrase, as literal text whatever its case, with n_terms.

    A phrase is looked for with white space runs as one blank. Every text is searched in whole.
    """
    clean = keyword_terms(terms)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    n = sum((F.contains(low, F.lit(t)).cast("int") for t in clean), F.lit(0))
    holds = {"all": F.col("n_terms") == len(clean), "any": F.col("n_terms") > 0, "phrase": F.contains(F.regexp_replace(low, r"\s+", " "), F.lit(" ".join(clean)))}[match]
    return parents.withColumn("n_terms", n).where(holds)


def counts_by_source(hits: DataFrame) -> DataFrame:
    """source, n of all hits."""
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def first_hits(hits: DataFrame, children: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """place, handle, source, n_terms, anchor of the first hits: most terms first, then source, then place.

    anchor is the first child of a hit that holds a term, else its first child; hits without children are none. children: handle, child,
    ordinal, text.
    """
    clean = keyword_terms(terms)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    holds = F.array_max(F.array(*(F.contains(low, F.lit(t)) for t in clean)))
    ranked = hits.orderBy(F.desc("n_terms"), "source", "ordinal", "handle")
    best = children.select("handle", F.struct(~holds, F.col("ordinal").alias("o"), F.col("child").alias("child")).alias("_c")).groupBy("handle").agg(F.min("_c")["child"].alias("anchor"))
    top = ranked.join(best, "handle").orderBy(F.desc("n_terms"), "source", "ordinal", "handle").limit(limit)
    w = Window.orderBy(F.desc("n_terms"), "source", "ordinal", "handle")  # at most limit rows
    return top.select(F.row_number().over(w).alias("place"), "handle", "source", "n_terms", "anchor")


def pool_order(items: DataFrame, handle: str) -> DataFrame:
    """handle, best_rank, first_step, place of an evidence pool: best rank first, then the first step that gave it, then who came first.

    items: handle, rank, step, seq (order of arrival).
    """
    per = items.groupBy(handle).agg(F.min("rank").alias("best_rank"), F.min("step").alias("first_step"), F.min("seq").alias("_seq"))
    return per.select(handle, "best_rank", "first_step", F.row_number().over(Window.orderBy("best_rank", "first_step", "_seq")).alias("place"))
