"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's words are shared out over its documents: a document of size s may expect ``theta * s ** tilt`` copies, at most
``most``, where theta makes the expected words equal the source's target. Its whole copies are certain; what is left, p,
is its inclusion probability for one more. With u uniform by a hash, documents are ranked by the random odds u / (1 - u)
divided by the inclusion odds p / (1 - p), and the sample takes them in that order up to its fixed size, which is in
words: what the certain copies leave of the target. Long documents being likelier, chance falls on short ones, so the
words that a sample takes stay near its target; the last gap is closed by the document that fits it best.

Sources, one row each, are weighed in one task. A document row holds id, source, size and a number; those are sorted by
range over all tasks, so a source with most of the documents is in no single one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .running import running

#: Word sources beyond this many are joined by shuffle with salts instead of a broadcast.
FEW = 50_000
SALTS = 32
WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than blank and 9 to 13; no array of words is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACES, "")).cast("long")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 with 53 bits, by SHA-256 of the parts."""
    digits = F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: source, source_size, one row each. Adds place (by code point, null last) and target.

    Sources share ``share`` times all words by weights that repeat in the order of places; a target stops at ``most``
    times its source's size, and the excess goes to the others by weight. The sources that stop are those with the least
    size for their weight, so the level of the others follows from one ordered pass.
    """
    every = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(every) - 1) % len(weights) + 1)
    placed = sizes.select("source", "source_size", (F.row_number().over(every) - 1).alias("place"), cycle.alias("weight"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(fill), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    levels = placed.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    best = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(all_rows)["level"]
    stop = (most * F.col("source_size")).cast("double")
    return levels.select("source", "source_size", "place", F.when(best.isNull(), stop).otherwise(F.least(stop, best * F.col("weight"))).alias("target"))


def copy_levels(counts: DataFrame, targets: DataFrame, most: int, tilt: float) -> DataFrame:
    """targets with theta (null: all documents have ``most`` copies) and left: target less the words of certain copies.

    counts: place, size, words, one row for each size of a source; its rows are bounded by the longest document.
    """
    up = Window.partitionBy("place").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # theta if this size is the largest one below ``most`` copies
    stepped = (
        counts.join(targets, "place")
        .withColumn("weight", F.pow("size", F.lit(tilt)))
        .withColumn("theta", (F.col("target") - most * (F.col("source_size") - F.sum("words").over(up))) / F.sum(F.col("words") * F.col("weight")).over(up))
    )
    best = stepped.where(F.col("theta") * F.col("weight") <= most).groupBy("place").agg(F.max_by("theta", "size").alias("theta"))
    levels = targets.join(best, "place", "left")
    sure = counts.join(levels.select("place", "theta"), "place").groupBy("place").agg(F.sum(F.col("words") * F.floor(copies(most, tilt))).alias("sure"))
    return levels.join(sure, "place", "left").withColumn("left", F.col("target") - F.coalesce("sure", F.lit(0)))


def copies(most: int, tilt: float) -> Column:
    """Copies that a document of ``size`` may expect."""
    return F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("theta") * F.pow("size", F.lit(tilt)), F.lit(float(most)))))


def _by_place(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with the columns of their source; a few sources are broadcast, more are joined with salts."""
    if table.count() <= FEW:
        return docs.join(F.broadcast(table), "place")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(salted, ["place", "_salt"]).drop("_salt")


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, tilt: float = 0.5, seed: int = 11) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    size counts the words of the text (null: 0), target is the source's, taken = copies * size; copies are whole, from 0 to
    ``most``. A null source is a source of its own, the last; a null id is an id like others. Chance depends on seed, id
    and size alone, so reruns agree; rows with equal id and size tie, and it does not show which of them was taken.
    Documents without words have 0 copies. Other columns are not read; an empty table gives no rows.
    """
    base = docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"))
    base = materialise(base, "mix-sizes")
    counts = materialise(base.groupBy("source", "size").agg(F.sum("size").alias("words")), "mix-counts")
    targets = materialise(source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")
    named = counts.join(targets.select("source", "place"), counts["source"].eqNullSafe(targets["source"])).where("size > 0").select("place", "size", "words")
    levels = materialise(copy_levels(named, targets, most, tilt), "mix-levels")

    few = levels.count() <= FEW
    place = base.join(F.broadcast(levels) if few else levels, base["source"].eqNullSafe(levels["source"])).select(base["*"], "place", "source_size", "target", "theta", "left")
    expected = place.withColumn("_copies", copies(most, tilt)).withColumn("whole", F.floor("_copies")).withColumn("p", F.col("_copies") - F.col("whole"))
    u = uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    ranked = expected.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    drawn = ranked.select("doc_id", "source", "size", "source_size", "target", "left", "place", "whole", "rank")
    chance = F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)
    summed = materialise(running(drawn, "place", [F.asc_nulls_last("rank"), F.col("size"), F.col("doc_id")], {"upto": chance}), "mix-drawn")

    open_ = F.col("rank").isNotNull()
    gaps = summed.groupBy("place").agg(F.first("left").alias("left"), F.coalesce(F.max(F.when(open_ & (F.col("upto") <= F.col("left")), F.col("upto"))), F.lit(0)).alias("filled")).select("place", (F.col("left") - F.col("filled")).alias("gap"))
    last = _by_place(summed.where(open_ & (F.col("upto") > F.col("left"))), gaps).where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    last = last.groupBy("place").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "upto"))["upto"].alias("closing"))
    # one row for each source, those without a closing document as well
    closing = gaps.join(last, "place", "left").select("place", "closing")
    more = open_ & ((F.col("upto") <= F.col("left")) | F.coalesce(F.col("upto") == F.col("closing"), F.lit(False)))
    out = _by_place(summed, closing).withColumn("copies", F.col("whole") + more.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
