"""Joins of evidence: handles, prefixes, neighbours, anchors, conflicts, drift, reachability and leakage groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import settled


def chain(start: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins along keys: (table, key of what is there, key of the table); key columns of tables go."""
    for table, left, right in steps:
        start = start.join(table.withColumnRenamed(right, "_key"), F.col(left) == F.col("_key")).drop("_key")
    return start


def arrays_joined(lists: DataFrame, keys: str, values: str, parents: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """Parallel arrays (parent keys, child keys) as rows with their place, joined to both tables."""
    rows = lists.select(*[c for c in lists.columns if c not in (keys, values)], F.posexplode(F.arrays_zip(F.col(keys).alias("p"), F.col(values).alias("c"))).alias("place", "_z"))
    rows = rows.select("*", F.col("_z.p").alias(parent), F.col("_z.c").alias(child)).drop("_z")
    return rows.join(parents, parent).join(children, child)


def or_first_child(parents: DataFrame, chosen: DataFrame, children: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """key, value of every parent: the chosen child, else the first of its children (null without any)."""
    first = children.groupBy(key).agg(F.min_by(value, ordinal).alias("_first"))
    return parents.select(key).join(chosen.select(key, value), key, "left").join(first, key, "left").select(key, F.coalesce(value, "_first").alias(value))


def prefix_join(handles: DataFrame, handle: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Pairs of handles and the prefixes that they begin with: by length of the prefix, so that each length is an equi-join.

    The lengths of the prefixes are few and are read once; handles are cut to each of them.
    """
    lengths = prefixes.select(F.length(prefix).alias("_n")).distinct()
    cut = handles.crossJoin(F.broadcast(lengths)).where(F.length(handle) >= F.col("_n")).withColumn("_cut", F.substring(F.col(handle), F.lit(1), F.col("_n"))).drop("_n")
    return cut.join(prefixes.withColumnRenamed(prefix, "_cut"), "_cut").withColumnRenamed("_cut", prefix)


def with_neighbours(df: DataFrame, by: str, ordinal: str, value: str) -> DataFrame:
    """df with before and after: the value at the ordinal one less and one more, null where there is a gap.

    One union and one grouping by the ordinal asked for; an ordinal stands once for each ``by``.
    """
    asked = [df.select(by, (F.col(ordinal) + d).alias(ordinal), F.col(value).alias(n)) for d, n in ((1, "before"), (-1, "after"))]
    both = asked[0].unionByName(asked[1], allowMissingColumns=True).groupBy(by, ordinal).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return df.join(both, [by, ordinal], "left")


def conflicts(claims: DataFrame, label: str, value: str, rank: str) -> DataFrame:
    """Pairs of claims (rank_a < rank_b) with one label and different values.

    Labels of one value are out before the join, and only distinct values of a label meet: each pair of values is told by
    the first claims that have them, so claims that repeat a value do not multiply.
    """
    first = claims.where(F.col(value).isNotNull()).groupBy(label, value).agg(F.min(rank).alias("rank"))
    several = first.groupBy(label).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(label)
    first = first.join(several, label, "left_semi")
    a, b = (first.select(label, F.col(value).alias(f"value_{n}"), F.col("rank").alias(f"rank_{n}")) for n in "ab")
    return a.join(b, label).where("rank_a < rank_b")


def flat(text: Column) -> Column:
    """Text with white space runs as one blank, for comparisons."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def anchored(anchors: DataFrame, anchor: str, parents: DataFrame, parent: str, text: str, words: int = 3) -> DataFrame:
    """anchors with n_parents and parent: how many parents hold the anchor sentence, and which if it is exactly one.

    A sentence is looked for only in parents that have its first words in a row, found by an equi-join of digests of words and
    ids of parents; texts are fetched for what it finds, and the containment is checked then. Anchors of fewer words use
    them all.
    """
    a = anchors.withColumn("_flat", flat(F.col(anchor))).withColumn("_words", F.split("_flat", " ")).withColumn("_id", F.xxhash64(*anchors.columns))
    size = F.least(F.size("_words"), F.lit(words))
    probes = a.where("_flat <> ''").select("_id", "_flat", size.alias("_n"), F.concat_ws(" ", F.slice("_words", 1, size)).alias("_key"))
    sizes = probes.select("_n").distinct()
    p = parents.select(F.col(parent).alias("parent"), flat(F.col(text)).alias("_text"))
    grams = p.select("parent", F.split("_text", " ").alias("_w")).crossJoin(F.broadcast(sizes))  # a few sizes
    # anchors begin and end anywhere in a word of the parent, so the first word is compared by the rest of the parent's one
    keyed = grams.select("parent", "_n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - F.col("_n") + 1)), lambda i: F.concat_ws(" ", F.slice("_w", i, F.col("_n"))))).alias("_key"))
    met = probes.select("_id", "_n", F.xxhash64("_key").alias("_key")).join(keyed.withColumn("_key", F.xxhash64("_key")), ["_n", "_key"]).select("_id", "parent").distinct()
    checked = met.join(probes.select("_id", "_flat").distinct(), "_id").join(p, "parent").where(F.contains("_text", F.col("_flat")))
    held = checked.groupBy("_id").agg(F.count_distinct("parent").alias("_k"), F.min("parent").alias("_p"))
    return a.join(held, "_id", "left").select(*anchors.columns, F.coalesce("_k", F.lit(0)).alias("n_parents"), F.when(F.col("_k") == 1, F.col("_p")).alias("parent"))


def key_rows(facts: DataFrame, rows: DataFrame, sheet: str, column: str, value: str, cells: str) -> DataFrame:
    """Facts joined to the rows of their sheet whose cell in the named column has the value; cells is a map of rows."""
    return facts.join(rows.select("*", F.explode(cells).alias(column, value)), [sheet, column, value])


def drift(pinned: DataFrame, current: DataFrame, code: str, version: str, status: str) -> DataFrame:
    """code, state of each pinned source: missing, deleted, not ready, different or same."""
    now = current.select(code, F.col(version).alias("_now"), F.col(status).alias("_status"), F.lit(True).alias("_there"))
    state = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_status") == "deleted", "deleted").when(~F.col("_status").startswith("ready"), "not ready")
        .when(~F.col("_now").eqNullSafe(F.col(version)), "different").otherwise("same")
    )
    return pinned.join(now, code, "left").select(code, state.alias("state"))


def reachable(facts: DataFrame, item: str, fact: str, handle: str, children: DataFrame) -> DataFrame:
    """item, any_fact, all_facts: whether some and whether every fact of an item has a handle with a child."""
    there = children.select(handle).distinct().withColumn("_there", F.lit(True))
    per = facts.join(there, handle, "left").groupBy(item, fact).agg(F.coalesce(F.bool_or("_there"), F.lit(False)).alias("_ok"))
    return per.groupBy(item).agg(F.bool_or("_ok").alias("any_fact"), F.bool_and("_ok").alias("all_facts"))


def leakage_groups(members: DataFrame, item: str, key: str, most_rounds: int = 40) -> DataFrame:
    """item, grp of items that share keys, directly or through others: the smallest item of the connected group.

    Labels pass from items to keys and back, and then jump to the label of their label, so chains shorten by half each
    round; a round is two groupings. Raises RuntimeError when labels do not settle.
    """
    edges = members.select(F.col(item).alias("i"), F.col(key).alias("k")).where("i IS NOT NULL").distinct()
    edges = settled(edges)
    now = edges.select("i", F.col("i").alias("grp")).distinct()
    for _ in range(most_rounds):
        low = edges.where("k IS NOT NULL").join(now, "i").groupBy("k").agg(F.min("grp").alias("low"))
        near = edges.join(low, "k").groupBy("i").agg(F.min("low").alias("low"))
        step = now.join(near, "i", "left").select("i", "grp", F.least("grp", "low").alias("new"))
        jump = step.select(F.col("i").alias("new"), F.col("new").alias("far"))
        moved = step.join(jump, "new", "left").select("i", "grp", F.least("new", "far").alias("new"))
        moved = settled(moved)
        now = moved.select("i", F.col("new").alias("grp"))
        if not moved.where("grp <> new").take(1):
            return now.withColumnRenamed("i", item)
    raise RuntimeError("leakage groups did not settle")

