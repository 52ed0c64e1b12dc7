"""The assembled search: one plan from stages that can be switched, with counts of the stages as its trace."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import retrieval as re_
from .lexical import LexicalIndex, lexical_lane
from .steps import written

#: Scores of the passages of one query, in order; any exception counts as a scorer that is not there.
Scorer = Callable[[str, list[str]], list[float]]
UNAVAILABLE = "RERANKER_UNAVAILABLE"
#: Rows of a pool up to this many are broadcast to the texts; more are joined by shuffle.
FEW_ROWS = 200_000


@dataclass(frozen=True)
class SearchConfig:
    """Stages and their sizes; weights of lanes are for the fusion."""

    use_lexical: bool = True
    use_dense: bool = True
    balance: bool = True
    rerank: bool = False
    lane_k: int = 40
    rrf_k: int = 60
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    pool_size: int = 24
    pool_source_cap: int = 4
    final_source_cap: int = 3
    wanted_classes: tuple[str, ...] = ()
    top_k: int = 10
    rerank_timeout: float = 5.0


@dataclass
class Search:
    """Result of search(): ranked has query_id, key, source, class, score, fused_rank, in_pool, rerank_score, promoted, flag and rank.

    trace() gives the rows that left each stage; it runs the plan where no action has done so.
    """

    ranked: DataFrame
    stages: dict[str, Observation] = field(default_factory=dict)

    def trace(self) -> dict[str, int]:
        return {name: seen.get["rows"] for name, seen in self.stages.items()}


def rerank(pool: DataFrame, key: str, query_text: str, passage: str, scorer: Scorer, timeout: float) -> DataFrame:
    """pool with rerank_score and flag. A query whose passages the scorer does not score within ``timeout`` seconds, or that
    it fails on, has no scores and the flag; nothing fails for it.

    The candidates of a query are a pool of bounded size; each query is scored in one call.
    """
    schema = ", ".join(f"`{n}` {k}" for n, k in pool.dtypes) + ", rerank_score double, flag string"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key])
        began, scores, flag = time.monotonic(), None, None
        try:
            scores = [float(x) for x in scorer(frame[query_text].iloc[0] or "", [t or "" for t in frame[passage]])]
            if len(scores) != len(frame) or time.monotonic() - began > timeout or not np.isfinite(scores).all():
                scores = None
        except Exception:  # a scorer that fails degrades its query, never the search
            scores = None
        if scores is None:
            flag = UNAVAILABLE
        return frame.assign(rerank_score=pd.Series(scores if scores is not None else np.nan, index=frame.index, dtype="float64"), flag=flag)

    return pool.groupBy("query_id").applyInPandas(run, schema).withColumn("rerank_score", F.when(F.col("flag").isNull(), F.col("rerank_score")))


def search(queries: DataFrame, docs: DataFrame, key: str, source: str, class_: str, config: SearchConfig, index: LexicalIndex | None = None, vectors: DataFrame | None = None, vector: str = "vector", text: str = "text", scorer: Scorer | None = None) -> Search:
    """Lanes, fusion, pool, rerank, source caps and class floor for a table of queries (query_id, text, vector).

    A stage that is off leaves out its step: without a lane the other one is fused alone, without balance the pool is the
    first of the fused order and nothing is demoted or promoted, without rerank the pool keeps its order. What the pool
    leaves out follows it. Texts of the pool only are read for the scorer.
    """
    stages: dict[str, Observation] = {}

    def seen(df: DataFrame, name: str, rows: Column | None = None) -> DataFrame:
        stages[name] = Observation()
        return df.observe(stages[name], (F.count(F.lit(1)) if rows is None else F.count_if(rows)).alias("rows"))

    lanes: dict[str, DataFrame] = {}
    if config.use_lexical and index is not None:
        lanes["lexical"] = seen(lexical_lane(queries.select("query_id", "text"), index, config.lane_k), "lexical")
    if config.use_dense and vectors is not None:
        lanes["dense"] = seen(re_.dense_lane(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), vectors, key, vector, config.lane_k), "dense")
    if not lanes:
        raise ValueError("a search needs a lane")
    fused = re_.fuse(lanes, key, config.rrf_k, {"lexical": config.lexical_weight, "dense": config.dense_weight})
    about = docs.select(key, F.col(source).alias("source"), F.col(class_).alias("class"))
    ranked = seen(fused.join(about, key), "fused")

    query = Window.partitionBy("query_id")
    over = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("fused_rank")) > config.pool_source_cap if config.balance else F.lit(False)
    pooled = ranked.withColumn("_over", over).withColumn("_place", F.row_number().over(query.orderBy("_over", "fused_rank")))
    pooled = seen(pooled.withColumn("in_pool", F.col("_place") <= config.pool_size), "pool", F.col("in_pool")).drop("_over")
    if config.rerank and scorer is not None:
        pooled = written(pooled, "pool")  # read for the scorer and for the ranks: the lanes run once
        wanted = pooled.where("in_pool").select("query_id", key)
        if queries.count() * config.pool_size <= FEW_ROWS:  # the texts stay where they are, few are shuffled
            wanted = F.broadcast(wanted)
        held = docs.select(key, F.col(text).alias("_passage")).join(wanted, key).join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
        scored = rerank(held.select("query_id", key, "_query", "_passage"), key, "_query", "_passage", scorer, config.rerank_timeout).select("query_id", key, "rerank_score", "flag")
        pooled = pooled.join(seen(scored, "reranked", F.col("rerank_score").isNotNull()), ["query_id", key], "left")
    else:
        pooled = pooled.withColumns({"rerank_score": F.lit(None).cast("double"), "flag": F.lit(None).cast("string")})
    # the pool first: by score, those without one after them, in the order of the pool; then the rest as it was fused
    first = [F.desc("in_pool"), F.col("rerank_score").isNull(), F.desc("rerank_score"), F.when(F.col("in_pool"), F.col("_place")).otherwise(F.col("fused_rank"))]
    ordered = pooled.withColumn("rank", F.row_number().over(query.orderBy(*first)))
    if config.balance:
        ordered = re_.cap_final(ordered, "source", "rank", config.final_source_cap).drop("rank").withColumnRenamed("final_rank", "rank")
    ordered = ordered.withColumn("promoted", F.lit(False))
    if config.balance and config.wanted_classes:
        floor = re_.class_floor(ordered, key, "class", "rank", list(config.wanted_classes), config.top_k)
        ordered = ordered.drop("rank", "promoted").join(floor.withColumnRenamed("floor_rank", "rank"), ["query_id", key])
    out = ordered.select("query_id", key, "source", "class", "score", "best_rank", "fused_rank", "in_pool", "rerank_score", "promoted", "flag", F.col("rank").cast("int").alias("rank"))
    return Search(seen(out, "final"), stages)


def overlap_scorer(query: str, passages: list[str]) -> list[float]:
    """A scorer without a model: share of the query's words that a passage has."""
    words = set(query.lower().split())
    return [len(words & set(p.lower().split())) / max(1, len(words)) for p in passages]


def combined(searches: dict[str, DataFrame]) -> DataFrame:
    """Results of several configurations as one table, by arm."""
    return reduce(DataFrame.unionByName, [df.withColumn("arm", F.lit(name)) for name, df in searches.items()])
