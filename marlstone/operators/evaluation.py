"""Evaluation: ranking metrics, intervals, paired tests, leakage, deterministic splits and confusion counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from .steps import settled
from .totals import running_totals

CUTS = (1, 3, 5, 10, 20)


def ranking(gold: DataFrame, ranked: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """item, recall_k for each cut, reciprocal_rank. gold: item, fact, handle (any handle satisfies); ranked: item, handle, rank."""
    best = gold.join(ranked, ["item", "handle"], "left").groupBy("item", "fact").agg(F.min("rank").alias("rank"))
    per = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in cuts]
    return best.groupBy("item").agg(*per, F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("reciprocal_rank"))


def macro(per_item: DataFrame) -> DataFrame:
    return per_item.agg(F.count(F.lit(1)).alias("items"), *[F.round(F.avg(c), 9).alias(c) for c in per_item.columns if c != "item"])


def rates(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, hits, n, rate, low, high: shares with their Wilson intervals."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = cells.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return out.select(*by, "hits", "n", F.round(F.col("hits") / F.col("n"), 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a_only, b_only, p: exact two-sided McNemar test of two boolean columns."""
    counts = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(F.col(b) & ~F.col(a)).alias("b_only"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # log of the binomial coefficients, summed one factor at a time; terms are counted from 0 to k
    start = F.struct(F.lit(0.0).alias("logc"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct(
        F.when(i == 0, F.lit(0.0)).otherwise(s["logc"] + F.log(((n - i + 1) / i).cast("double"))).alias("logc"),
        (s["sum"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["logc"] + F.log(((n - i + 1) / i).cast("double"))) - n * F.log(F.lit(2.0)))).alias("sum"),
    )
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step)["sum"]
    return counts.select("a_only", "b_only", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 9).alias("p"))


def bootstrap(df: DataFrame, by: str, value: str, samples: int = 10_000, seed: int = 20_240, confidence: float = 0.95) -> DataFrame:
    """by, n, mean, low, high: percentile bootstrap of group means, null values left out.

    Values are counted first, so a task holds the distinct scores of a group and draws how often each comes again.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(value)
        x, times = frame[value].to_numpy(float), frame["_times"].to_numpy(np.int64)
        n = int(times.sum())
        rng = np.random.default_rng(seed)
        step = max(1, (1 << 20) // len(x))
        means = np.concatenate([rng.multinomial(n, times / n, min(step, samples - i)) @ x / n for i in range(0, samples, step)])
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({by: [frame[by].iloc[0]], "n": [n], "mean": [x @ times / n], "low": [low], "high": [high]})

    counted = df.select(by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_times"))
    return counted.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, n long, mean double, low double, high double")


def token_overlap(a: DataFrame, b: DataFrame, tokens: str, least: float) -> DataFrame:
    """a_id, b_id, jaccard of pairs of token sets (distinct tokens) with at least one common token and a similarity of ``least``.

    Two sets that are similar enough share one of their rarest tokens, so only those are joined: of n tokens, from the rarest
    up, the first n - ceil(least * n) + 1. A token of most sets stands among the last and pairs nothing. The sets of the
    pairs found are then compared in whole. Without a ``least`` above 0 all tokens are joined.
    """
    if least > 0:
        rarity = a.select(F.explode(tokens).alias("tok")).unionAll(b.select(F.explode(tokens).alias("tok"))).groupBy("tok").agg(F.count(F.lit(1)).alias("_df"))

        def rare(df: DataFrame, key: str) -> DataFrame:
            """key, tok of the tokens that decide."""
            placed = df.select(key, F.size(tokens).alias("_n"), F.explode(tokens).alias("tok")).join(rarity, "tok")
            at = F.row_number().over(Window.partitionBy(key).orderBy("_df", "tok"))
            return placed.withColumn("_at", at).where(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select(key, "tok")

        pairs = rare(a, "a_id").join(rare(b, "b_id"), "tok").select("a_id", "b_id").distinct()
        whole = pairs.join(a.select("a_id", F.col(tokens).alias("_x")), "a_id").join(b.select("b_id", F.col(tokens).alias("_y")), "b_id")
        k = F.size(F.array_intersect("_x", "_y"))
        return whole.select("a_id", "b_id", F.round(k / (F.size("_x") + F.size("_y") - k), 9).alias("jaccard")).where(F.col("jaccard") >= least)
    left = a.select("a_id", F.size(tokens).alias("na"), F.explode(tokens).alias("tok"))
    right = b.select("b_id", F.size(tokens).alias("nb"), F.explode(tokens).alias("tok"))
    common = left.join(right, "tok").groupBy("a_id", "b_id", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return common.select("a_id", "b_id", F.round(j, 9).alias("jaccard")).where(F.col("jaccard") >= least)


def argmax(pairs: DataFrame) -> DataFrame:
    """The most similar b of each a, ties by the smaller id."""
    return pairs.groupBy("a_id").agg(F.max_by("b_id", F.struct("jaccard", -F.col("b_id"))).alias("b_id"), F.max("jaccard").alias("jaccard"))


def split(items: DataFrame, item: str, stratum: str, group: str, share: float = 0.5) -> DataFrame:
    """item, stratum, split: groups stay whole; in the order of their digests they fill ``dev`` up to its share of a stratum.

    A group counts for the stratum of its smallest item. Running totals replace the sequential quota.
    """
    groups = items.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min_by(stratum, item).alias("_stratum"))
    groups = groups.withColumn("_digest", F.sha2(F.col(group).cast("string").cast("binary"), 256))
    summed = running_totals(groups, ["_stratum"], [F.col("_digest"), F.col(group)], "_upto", F.col("size"))
    totals = groups.groupBy(F.col("_stratum").alias("_s")).agg(F.sum("size").alias("_all"))
    # one row for each stratum
    side = F.when(F.col("_upto") <= F.ceil(F.col("_all") * share), "dev").otherwise("holdout")
    sided = summed.join(totals, F.col("_stratum").eqNullSafe(F.col("_s"))).select(group, side.alias("split"))
    return items.join(sided, group).select(item, stratum, group, "split")


def split_leaks(assigned: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return assigned.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def confusion(df: DataFrame, gold: str, said: str) -> DataFrame:
    return df.groupBy(gold, said).agg(F.count(F.lit(1)).alias("n"))


def below_floor(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metric, value, floor of the metrics that miss their floor; an empty result passes the gate."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("floor")) for k, v in floors.items()])).alias("m")).select("m.*")
    return long.where(F.coalesce(F.col("value") < F.col("floor"), F.lit(True)))


def longest_shared_run(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with longest: content stems of the longest run that both texts share; null texts share nothing."""

    def longest(x: list[str], y: list[str]) -> int:
        # a run of n words holds runs of fewer, so the length is searched by halving
        low, high = 0, min(len(x), len(y))
        while low < high:
            n = (low + high + 1) // 2
            own = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            if any(tuple(y[i : i + n]) in own for i in range(len(y) - n + 1)):
                low = n
            else:
                high = n - 1
        return low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.assign(longest=[longest(list(p), list(q)) for p, q in zip(f["_a"], f["_b"], strict=True)]).drop(columns=["_a", "_b"])

    stemmed = pairs.withColumn("_a", content_stems(F.col(a))).withColumn("_b", content_stems(F.col(b)))
    return stemmed.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes) + ", longest long")


def paired_difference(a: DataFrame, b: DataFrame, item: str, score: str, **options) -> DataFrame:
    """n, mean, low, high: bootstrap of the mean difference of two arms over the items that both have."""
    both = a.select(item, F.col(score).alias("_a")).join(b.select(item, F.col(score).alias("_b")), item)
    return bootstrap(both.select(F.lit("all").alias("_by"), (F.col("_a") - F.col("_b")).alias("d")), "_by", "d", **options).drop("_by")


def breakdown(per_item: DataFrame, keys: dict[str, str], score: str) -> DataFrame:
    """dimension, value, items, mean of a score for each value of several dimensions, in one grouping."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("value")) for n, c in keys.items()]))
    return per_item.select(score, pairs.alias("k")).groupBy("k.dimension", "k.value").agg(F.count(F.lit(1)).alias("items"), F.avg(score).alias("mean"))


def failure_buckets(items: DataFrame, item: str, hit_a: Column, hit_b: Column, examples: int = 6) -> DataFrame:
    """bucket, n, examples (the first items): a_only, b_only and both_miss; items that both hit are in none.

    The first items of a bucket come from a bounded top of each partition, not from a list of the bucket.
    """
    name = F.when(hit_a & ~hit_b, "a_only").when(hit_b & ~hit_a, "b_only").when(~hit_a & ~hit_b, "both_miss")
    marked = items.select(item, name.alias("bucket")).where("bucket IS NOT NULL")
    w = Window.partitionBy("bucket").orderBy(item)
    first = marked.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= examples).groupBy("bucket").agg(F.sort_array(F.collect_list(item)).alias("examples"))
    return marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(first, "bucket")


def outranked(ranked: DataFrame, item: str, handle: str, truth: DataFrame, negatives: DataFrame) -> DataFrame:
    """item, true_rank, best_distractor_rank, distractor_wins of the items that have distractors."""
    best = lambda t, n: t.join(ranked, [item, handle], "left").groupBy(item).agg(F.min("rank").alias(n))
    both = best(negatives, "best_distractor_rank").join(best(truth, "true_rank"), item, "left")
    wins = F.col("best_distractor_rank").isNotNull() & (F.col("true_rank").isNull() | (F.col("best_distractor_rank") < F.col("true_rank")))
    return both.select(item, "true_rank", "best_distractor_rank", wins.alias("distractor_wins"))


# Words without content, and endings that are cut from words of more than their length and three, in order.
PLAIN_WORDS = (
    "a an the of in on for to and or is are was were be been by with from at as that this these those it its than more most into over per vs their they our we what which who whom how why "
    "when where did does do has have had about across between among any all each there here not no can could would should will shall may might much many very also just only"
).split()
ENDINGS = ("ingly", "edly", "ing", "ies", "ied", "ers", "est", "ed", "es", "er", "ly", "s")


def content_stems(text: Column) -> Column:
    """Stems of the content words of a text, in order, repeats kept."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+(?:[.%][a-z0-9]+)*%?)"), F.lit(1)), lambda w: ~w.isin(PLAIN_WORDS))

    def stem(w: Column) -> Column:
        out = w
        for end in reversed(ENDINGS):
            out = F.when(w.endswith(end) & (F.length(w) > len(end) + 3), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
        return F.when(w.rlike("^[0-9]"), w).otherwise(out)

    return F.transform(words, stem)


def overlap_share(question: Column, anchors: Column) -> Column:
    """Share of the question's distinct stems that its anchors' text has; 0 without any."""
    q = F.array_distinct(content_stems(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_stems(anchors))) / F.size(q)).otherwise(F.lit(0.0))


def overlap_bin(share: Column) -> Column:
    """low, mid from 0.34, high from 0.67."""
    return F.when(share >= 0.67, "high").when(share >= 0.34, "mid").otherwise("low")


def id_scores(df: DataFrame, item: str, found: str, wanted: str) -> DataFrame:
    """item, recall, precision of id sets; undefined (null) without wanted or found ids."""
    f, w = F.array_distinct(found), F.array_distinct(wanted)
    both = F.size(F.array_intersect(f, w))
    return df.select(item, F.when(F.size(w) > 0, both / F.size(w)).alias("recall"), F.when(F.size(f) > 0, both / F.size(f)).alias("precision"))


def average_precision(ranked: DataFrame, item: str, rank: str, relevant: str) -> DataFrame:
    """item, average_precision: mean of the precision at each relevant rank; null without relevant ones."""
    w = Window.partitionBy(item).orderBy(rank)
    at = ranked.withColumn("_p", F.sum(F.col(relevant).cast("int")).over(w) / F.row_number().over(w))
    return at.groupBy(item).agg(F.avg(F.when(F.col(relevant), F.col("_p"))).alias("average_precision"))


def verifier_rates(df: DataFrame, by: list[str], supported: Column, accepted: Column) -> DataFrame:
    """by, n, false_positive_rate (accepted of the unsupported), false_negative_rate (refused of the supported)."""
    fp, fn = F.avg(F.when(~supported, accepted.cast("double"))), F.avg(F.when(supported, (~accepted).cast("double")))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), fp.alias("false_positive_rate"), fn.alias("false_negative_rate"))


def prefixed_sum(timings: Column, prefix: str) -> Column:
    """Sum of the values of a map whose keys begin with a prefix; null without any."""
    own = F.map_values(F.map_filter(timings, lambda k, v: k.startswith(prefix) & v.isNotNull()))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double")))


def gates(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """by, each gate and passed: whether all rows meet every condition."""
    out = df.groupBy(*by).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    return out.withColumn("passed", cells.all_of([F.col(n) for n in conditions]))


def frozen(items: DataFrame, item: str, columns: list[str], expected: DataFrame) -> DataFrame:
    """item, state: changed, missing or new against expected (item, digest); unchanged items are not told."""
    digest = F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)
    now = items.select(item, digest.alias("_now"))
    both = now.join(expected.select(item, F.col("digest").alias("_was")), item, "full")
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("_was"), "changed")
    return both.select(item, state.alias("state")).where("state IS NOT NULL")


def compare_arms(reference: DataFrame, other: DataFrame, item: str, cuts: tuple[int, ...] = (1, 5, 10, 20), **options) -> DataFrame:
    """metric, n, only_reference, only_other, p, mean, low, high of two arms over the items that both have.

    Arms are results of ranking(): item, recall_k, reciprocal_rank. Hits at k (a recall above 0) are compared by an exact McNemar test,
    the reciprocal rank and recall at 10 by a paired bootstrap of other minus reference.
    """
    pairs = reference.alias("a").join(other.alias("b"), item)
    tests = None
    for k in cuts:
        hit = pairs.select((F.col(f"a.recall_{k}") > 0).alias("x"), (F.col(f"b.recall_{k}") > 0).alias("y"))
        n = hit.agg(F.count(F.lit(1)).alias("n"))
        none = F.lit(None).cast("double")
        row = mcnemar(hit, "x", "y").crossJoin(n).select(F.lit(f"hit@{k}").alias("metric"), "n", F.col("a_only").alias("only_reference"), F.col("b_only").alias("only_other"), "p", none.alias("mean"), none.alias("low"), none.alias("high"))
        tests = row if tests is None else tests.unionByName(row)
    for name, column in (("mrr", "reciprocal_rank"), ("recall@10", "recall_10")):
        diff = paired_difference(other.select(item, F.col(column).alias("s")), reference.select(item, F.col(column).alias("s")), item, "s", **options)
        tests = tests.unionByName(diff.select(F.lit(name).alias("metric"), "n", F.lit(None).cast("long").alias("only_reference"), F.lit(None).cast("long").alias("only_other"), F.lit(None).cast("double").alias("p"), "mean", "low", "high"))
    return tests


def task_type(kinds: Column) -> Column:
    """Task of an item from the kinds of its facts: retrieval or analytics where all are of that kind, else multi_tool."""
    distinct = F.array_distinct(kinds)
    return F.when(distinct == F.array(F.lit("retrieval")), "retrieval").when(distinct == F.array(F.lit("analytics")), "analytics").otherwise("multi_tool")


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


#: Texts that open ones are tried against before all, in two rounds, and tasks over which all pairs of an item are dealt.
_FIRST, _DEALT = (16, 512), 64


def _alike(texts: DataFrame, others: DataFrame, item: str, enough) -> DataFrame:
    """item, text of the distinct ``texts`` that some text of ``others`` of their item is like enough.

    Only whether there is one counts, so a text is tried against a few others first, and only what stays open against all
    of them: lists of at most about 1,000 others, dealt over tasks, and a text leaves a list at its first match. Lengths
    that differ too much are no pair. Nothing alike costs all pairs, in bounded memory.
    """
    longer, apart = (lambda a, b: F.greatest(F.length(a), F.length(b))), (lambda a, b: F.abs(F.length(a) - F.length(b)))
    may = lambda a, b: (longer(a, b) == 0) | enough(1 - apart(a, b) / longer(a, b))
    some = F.exists("_others", lambda o: may(F.col("_text"), o) & enough(likeness(F.col("_text"), o)))
    own, rest = (d.select(item, "_text").where(F.col(item).isNotNull() & F.col("_text").isNotNull()).distinct() for d in (texts, others))
    rest = settled(rest)
    found, left = [], own
    for n in _FIRST:
        few = rest.groupBy(item, F.pmod(F.xxhash64("_text"), F.lit(n)).alias("_b")).agg(F.min("_text").alias("_text")).groupBy(item).agg(F.collect_list("_text").alias("_others"))
        tried = settled(left.join(few, item).select(item, "_text", some.alias("_some")))
        found.append(tried.where("_some").select(item, "_text"))
        left = tried.where("NOT _some").select(item, "_text")
    if not left.isEmpty():
        lists = F.greatest(F.ceil(F.col("_n") / 1000), F.lit(1))
        sized = rest.join(rest.groupBy(item).agg(F.count(F.lit(1)).alias("_n")), item)
        blocks = sized.groupBy(item, F.pmod(F.xxhash64("_text"), lists).alias("_b")).agg(F.collect_list("_text").alias("_others")).withColumn("_deal", F.pmod(F.col("_b"), F.lit(_DEALT)))
        open_ = left.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)).cast("array<bigint>")))
        found.append(open_.join(blocks, [item, "_deal"]).where(some).select(item, "_text"))
    return reduce(DataFrame.unionByName, found).distinct()


def text_scores(found: DataFrame, wanted: DataFrame, item: str, least: float = 0.5) -> DataFrame:
    """item, recall, precision by likeness of passages: share of wanted passages with a found one above ``least``, and the rank-weighted
    precision of found passages of at least ``least``. Null without wanted or found passages.

    found: item, rank, text; wanted: item, ref, text.
    """
    had, want = found.select(item, "rank", F.col("text").alias("_text")), wanted.select(item, "ref", F.col("text").alias("_text"))
    got = _alike(want, had, item, lambda x: x > least).withColumn("_got", F.lit(True))
    fits = _alike(had, want, item, lambda x: x >= least).withColumn("_fits", F.lit(True))
    # rows of one ref, or of one rank, share their best pair; without a ref, or a rank, a row has none
    hit = F.coalesce(F.col("_got") & F.col("ref").isNotNull(), F.lit(0.0 > least))
    refs = want.join(got, [item, "_text"], "left").groupBy(item, "ref").agg(F.bool_or(hit).alias("_got"), F.count(F.lit(1)).alias("_rows"))
    recall = refs.groupBy(item).agg((F.sum(F.when(F.col("_got"), F.col("_rows")).otherwise(0)) / F.sum("_rows")).alias("recall"))
    ranks = had.join(fits, [item, "_text"], "left")
    whole = F.bool_or(F.coalesce(F.col("_fits") & F.col("rank").isNotNull(), F.lit(False))).over(Window.partitionBy(item, "rank"))
    precise = average_precision(ranks.withColumn("_relevant", whole), item, "rank", "_relevant").withColumnRenamed("average_precision", "precision")
    items = found.select(item).union(wanted.select(item)).distinct()
    return items.join(recall, item, "left").join(precise, item, "left")
