"""Grouped prefix join: exact Jaccard similarity join of word-shingle sets.

1. One pass takes the size and a 64-bit identity of every shingle set, and counts shingles that repeat inside a
   partition. The most frequent of them (a bounded list) come last in the order of shingles, so that prefixes hold rare
   ones. Any fixed order is exact; this one only keeps buckets small.
2. Sets of similarity >= t share a shingle among the first n - ceil(t n) + 1 of each. Sets with the same prefix and
   size make one group, and groups meet by shared prefix shingles: one shuffle of (shingle, group, size).
3. Pairs of groups are filtered first: all sets of a group have its prefix and size, so the size filter and the count
   of common prefix shingles at early places hold for all of them at once. In every bucket groups are first tried
   against a few pivots (stars, linear in the bucket), then all pairs of groups that meet in a bucket. A group whose
   sets are in several components counts as one part for each, and pairs of one component are never enumerated.
   Pairs that pass expand to their sets: a representative of one part against all sets of the other with stars, all
   sets against all in the last turn. So no link that could join components is missed.
4. Pairs are verified on the whole sets, recomputed from the texts of candidate sets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, long_column, materialise, mix, shingles, slices, words
from .components import connected_components

#: Entries of the list of frequent shingles that each task receives (8 bytes each).
FREQUENT = 100_000
#: A set size and a place in the set are one integer: size * _SHIFT + place.
_SHIFT = 1 << 31
#: Of the common prefix shingles that a similar pair must have, one in SHARE is asked for, at correspondingly early places.
SHARE = 4


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(slice, shingles, owner row, sizes, set identities) of each slice."""
    for batch in batches:
        for part, data, off in slices(batch):
            h, owner, _ = words(data, off)
            s, own = shingles(h, owner, part.num_rows, size)
            n = np.bincount(own, minlength=part.num_rows).astype(np.int64)
            ident = np.zeros(part.num_rows + 1, np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
            ends = np.cumsum(n)
            ident = mix(total[ends] - total[ends - n] + mix(n.astype(np.uint64) + np.uint64(1)))
            yield part, s, own, n, ident


def _profile(size: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        names = ["kind", "a", "b", "c"]
        seen: set[int] = set()
        pool, pooled = [], 0
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            v, c = held
            u, n = np.unique(np.concatenate(pool), return_counts=True) if pool else (v[:0], c[:0])
            u, n = np.concatenate([v, u]), np.concatenate([c, n])
            u, at = np.unique(u, return_inverse=True)
            n = np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)
            u, n = u[n > 1], n[n > 1]
            if len(u) > keep:
                top = np.argpartition(-n, keep)[:keep]
                u, n = u[top], n[top]
            return u, n

        for part, s, own, n, ident in _sets(batches, size):
            ids, null = long_column(part.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), pa.array(ids, mask=null), pa.array(n), _signed(ident)], names)
            fresh = np.zeros(len(n), bool)
            for i, x in enumerate(ident.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            pool.append(s[fresh[own]])
            pooled += len(pool[-1])
            if pooled > 4_000_000:
                held, pool, pooled = fold(), [], 0
        u, n = fold()
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), _signed(u), pa.array(n), pa.array(np.zeros(len(u), np.int64))], names)

    return run


def _prefixes(size: int, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        hot, rank = frequent.value
        seen: set[int] = set()
        for _, s, own, n, ident in _sets(batches, size):
            late = np.zeros(len(s), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                late = np.where(hot[at] == s, rank[at], 0)
            order = np.lexsort((s, late, own))
            s = s[order]
            first = np.cumsum(n) - n
            length = np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)
            fresh = np.zeros(len(n), bool)
            for i, x in enumerate(ident.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            length[~fresh] = 0
            inside = np.arange(len(s)) - first[own] < length[own]
            tok, who, place = s[inside], own[inside], (np.arange(len(s)) - first[own])[inside]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tok ^ np.uint64(0x5555555555555555)), dtype=np.uint64)])
            ends = np.cumsum(length)
            group = mix(total[ends] - total[ends - length] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own_rows = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tok, group[own_rows]]).view(np.int64)),
                    pa.array(np.concatenate([group[who], ident[own_rows]]).view(np.int64)),
                    pa.array(np.concatenate([n[who] * _SHIFT + place, -n[own_rows] * _SHIFT])),
                ],
                ["token", "id", "n"],
            )

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, id: distinct ones; those with n > 0 only where their token has two ids or more."""
    held = None
    told = False
    for batch in batches:
        tok, ident, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            tok, ident, n = (np.concatenate([np.array([h], x.dtype), x]) for h, x in zip(held, (tok, ident, n), strict=True))
        if not len(tok):
            continue
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (ident[1:] != ident[:-1]) | (n[1:] != n[:-1])
        was_told = held is not None and told
        tok, ident, n = tok[new], ident[new], n[new]
        near = np.zeros(len(tok), bool)
        pair = (tok[1:] == tok[:-1]) & (n[1:] > 0) & (n[:-1] > 0)
        near[1:] |= pair
        near[:-1] |= pair
        near |= n < 0
        # the last row waits for the next batch; the first may have been told already
        tail_near = near[-1]
        out = near.copy()
        if was_told:
            out[0] = False
        told = bool(tail_near)
        held = (tok[-1], ident[-1], n[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(tok[out]), pa.array(ident[out]), pa.array(n[out])], ["token", "id", "n"])


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_rows = batch.num_rows
            both = []
            for side in ("text_u", "text_v"):
                got = []
                for _, s, _, n, _ in _sets(iter([pa.RecordBatch.from_arrays([batch.column(side)], ["text"])]), size):
                    got += np.split(s, np.cumsum(n)[:-1])
                both.append(got)
            keep = np.zeros(n_rows, bool)
            for i in range(n_rows):
                a, b = both[0][i], both[1][i]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = common > 0 and den * common >= num * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    return run


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, num: int = 4, den: int = 5, stars: int = 2, pivots: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, for similarity >= num / den.

    A set is the distinct shingles of ``size`` words (A-Z lowered); a text with fewer words has its whole sequence as
    one shingle; null, empty and blank texts have an empty set, link with nothing and are their own component.
    component_id is the smallest key reachable by links, itself included. Rows of one key count as one document as far
    as ids go. Rows with a null key are kept; they link only with rows of the same set, and take its smallest key or null.
    Other columns of docs are not read; an empty table gives no rows. Set identities and shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    profile = materialise(base.mapInArrow(_profile(size, FREQUENT // 4), "kind byte, a long, b long, c long"), "jaccard-profile")
    sig = profile.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("id"))
    top = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("df")).where("df >= 4").orderBy(F.desc("df"), "a").limit(FREQUENT).toPandas()
    hot = top["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    frequent = spark.sparkContext.broadcast((hot[order], top["df"].to_numpy(np.int64)[order]))

    rows = base.mapInArrow(_prefixes(size, num, den, frequent), "token long, id long, n long")
    met = materialise(rows.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(_meeting, "token long, id long, n long"), "jaccard-met")
    members = met.where("n < 0").select(F.col("token").alias("grp"), "id", F.expr(f"-n div {_SHIFT}").alias("n")).distinct()
    buckets = met.where("n > 0").select("token", F.col("id").alias("grp"), F.expr(f"n div {_SHIFT}").alias("n"), F.expr(f"n % {_SHIFT}").alias("at"))
    counts = members.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    meets = buckets.select("grp").distinct().withColumn("meets", F.lit(True))
    # the sets of groups that meet another one or hold several sets
    wanted = materialise(members.join(counts, "grp").join(meets, "grp", "left").where("k > 1 OR meets").select("grp", "id", "n", (F.col("k") > 1).alias("crowd")), "jaccard-members")
    reps = sig.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"))
    named = wanted.select("id").join(reps, "id")
    # one text for each of these sets; a text exchange here is the price of exact verification
    texts = materialise(base.join(named, base["doc_id"] == named["rep"]).groupBy("id").agg(F.first("text").alias("text")), "jaccard-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
        right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
        return materialise(both.mapInArrow(_verify(size, num, den), "u long, v long"), "jaccard-links")

    links, roots, tried = None, None, None
    similar = f"{den} * least(n, pn) >= {num} * greatest(n, pn)"
    # A similar pair has ``overlap`` common shingles. The first ``enough`` of them, in the order of shingles, have overlap
    # - enough others after them, so in either set they stand among the first n - overlap + enough. Shared shingles at
    # later places are no reason to try a pair, and a pair with fewer than ``enough`` at those places is not similar.
    overlap = f"(({num} * (n + pn) + {num + den - 1}) div {num + den})"
    most = f"({overlap} - greatest(({num} * n + {den - 1}) div {den}, ({num} * pn + {den - 1}) div {den}) + 1)"
    enough = f"greatest(1, {most} div {SHARE})"
    placed = f"at < n - {overlap} + {enough} AND pat < pn - {overlap} + {enough}"
    for turn in range(stars + 1):
        # a part: the sets of one group and one component, named by its least set; at first a group is one part
        if roots is None:
            nodes = wanted.withColumn("root", F.col("grp"))
        else:
            nodes = wanted.join(roots, wanted["id"] == roots["node"], "left").select("grp", "id", "n", "crowd", F.coalesce("root", "id").alias("root"))
        parts = nodes.groupBy("grp", "root").agg(F.min("id").alias("part"), F.first("n").alias("size"))
        others = nodes.where("crowd").join(parts, ["grp", "root"]).where("id <> part").select("part", "id")
        now = buckets.join(parts, "grp").select("token", F.col("part").alias("id"), "n", "at", F.lit(1).cast("long").alias("w"), "root")
        if roots is None:
            now = materialise(now, "jaccard-buckets")
        else:
            # the parts of one group are a bucket too; their whole prefixes are common, which is always enough
            split = parts.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
            now = now.unionByName(parts.join(split, "grp").select(F.col("grp").alias("token"), F.col("part").alias("id"), F.col("size").alias("n"), F.lit(0).cast("long").alias("at"), F.col("size").alias("w"), "root"))
            # buckets of a single component are done
            open_ = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
            now = materialise(now.join(open_, "token"), "jaccard-open")
        if turn < stars:
            # a set that has the shingle at an early place has few rare ones before it: it lies amid its copies
            lead = ["at"] if not turn else []
            best = [
                F.min(F.struct(*lead, F.xxhash64("root", F.lit(turn * pivots + i)).alias("o"), F.col("at").alias("pat"), F.xxhash64("id", F.lit(i)).alias("h"), F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("root").alias("proot")))
                for i in range(pivots)
            ]
            chosen = now.groupBy("token").agg(F.array(*best).alias("p"))
            names = ("pivot", "pn", "pat", "proot")
            other = chosen.select("token", F.explode(F.array_distinct(F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in names])))).alias("p")).select("token", "p.*")
            where = "root <> proot"  # pivots try what is likely; no pair is lost by that, as the last turn takes all that is left
        else:
            other = now.select("token", F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("root").alias("proot"))
            where = "root <> proot AND id < pivot"
        together = now.join(other, "token").where(where).where(similar).where(placed).select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v"), F.least("n", "pn").alias("n"), F.greatest("n", "pn").alias("pn"), "w")
        pairs = together.groupBy("u", "v", "n", "pn").agg(F.sum("w").alias("c")).where(f"c >= {enough}").select("u", "v")
        # pairs of parts expand to pairs of sets
        left = pairs.join(others, pairs["u"] == others["part"]).select(F.col("id").alias("u"), "v")
        wide = pairs.unionByName(left)
        if turn < stars:
            pairs = wide.unionByName(pairs.join(others, pairs["v"] == others["part"]).select("u", F.col("id").alias("v")))
        else:
            pairs = wide.unionByName(wide.join(others, wide["v"] == others["part"]).select("u", F.col("id").alias("v")))
        if roots is None:  # the sets of a group against a few of them
            few = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id")) for i in range(pivots)]
            centres = wanted.where("crowd").groupBy("grp").agg(F.array(*few).alias("p")).select("grp", F.explode(F.array_distinct("p.id")).alias("v"))
            pairs = pairs.unionByName(wanted.where("crowd").join(centres, "grp").where("id <> v").select(F.col("id").alias("u"), "v"))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = verified(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        roots = materialise(connected_components(links), "jaccard-roots")

    smallest = roots.join(reps, roots["node"] == reps["id"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("id"), "component_id")
    known = reps.join(linked, "id", "left").select("id", F.coalesce("component_id", "rep").alias("component_id"))
    full = sig.where("n > 0").join(known, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the rows of a component other than those of its smallest key; columns as given.

    All rows of a key are one document, so they stay or go together; rows with a null key stay, as do null and empty
    texts, which are linked with nothing. An empty table stays empty.
    """
    gone = jaccard_classes(docs, text, key, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
