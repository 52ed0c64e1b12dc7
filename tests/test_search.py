"""The assembled search: a stage that is off leaves the shorter chain, and the trace counts what the stages gave."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import lexical
from marlstone.operators import retrieval as re_
from marlstone.operators import search as se


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(77)
    words = "market price rate loyal custom growth sales store region brand panel wave".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15))), f"s{rng.randrange(5)}", rng.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(docs, "id int, text string, source string, class string").cache()
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(0, 120, 2)], "id int, vector array<double>").cache()
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words, 3)), [rng.random() for _ in range(4)] if q % 3 else None) for q in range(9)], "query_id int, text string, vector array<double>").cache()
    index = lexical.LexicalIndex.write(df, "id", "text", str(tmp_path_factory.mktemp("search") / "i"), buckets=4)
    return df, vectors, queries, index


def run(world, scorer=None, **options):
    df, vectors, queries, index = world
    return se.search(queries, df, "id", "source", "class", se.SearchConfig(**options), index, vectors, scorer=scorer)


def lists(df, rank="rank"):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r[rank])):
        out[r.query_id].append(r.id)
    return dict(out)


def test_one_lane_alone(world):
    df, vectors, queries, index = world
    lane = lexical.lexical_lane(queries.select("query_id", "text"), index, 40)
    assert lists(run(world, use_dense=False, balance=False).ranked) == lists(lane)
    dense = re_.dense_lane(queries.where("vector IS NOT NULL").select("query_id", "vector"), vectors, "id", "vector", 40)
    assert lists(run(world, use_lexical=False, balance=False).ranked) == lists(dense)
    with pytest.raises(ValueError):
        run(world, use_lexical=False, use_dense=False)


def fused(world):
    df, vectors, queries, index = world
    lanes = {"lexical": lexical.lexical_lane(queries.select("query_id", "text"), index, 40), "dense": re_.dense_lane(queries.where("vector IS NOT NULL").select("query_id", "vector"), vectors, "id", "vector", 40)}
    return re_.fuse(lanes, "id"), lanes


def test_fusion_without_balance(world):
    want = lists(fused(world)[0], "fused_rank")
    found = run(world, balance=False, pool_size=5)
    assert lists(found.ranked) == want
    assert all(r.in_pool == (r.fused_rank <= 5) and not r.promoted for r in found.ranked.collect())


def plain_balance(rows, pool_size, pool_cap, final_cap):
    """rows: (id, source) in fused order."""

    def capped(rows, cap):
        seen, first, over = defaultdict(int), [], []
        for r in rows:
            seen[r[1]] += 1
            (first if seen[r[1]] <= cap else over).append(r)
        return first + over

    pool = capped(rows, pool_cap)[:pool_size]
    return capped(pool + [r for r in rows if r not in pool], final_cap)


def test_balance(world):
    df, *_ = world
    source = {r.id: r.source for r in df.collect()}
    want = {q: [i for i, _ in plain_balance([(i, source[i]) for i in ids], 12, 2, 3)] for q, ids in lists(fused(world)[0], "fused_rank").items()}
    assert lists(run(world, pool_size=12, pool_source_cap=2, final_source_cap=3).ranked) == want


def test_floor_equals_the_step_alone(world):
    options = {"pool_size": 12, "pool_source_cap": 2, "final_source_cap": 3}
    plain, floored = run(world, **options), run(world, **options, wanted_classes=("c", "a"), top_k=3)
    want = re_.class_floor(plain.ranked.withColumnRenamed("rank", "r"), "id", "class", "r", ["c", "a"], 3)
    assert lists(floored.ranked) == lists(want, "floor_rank")
    for q, ids in lists(floored.ranked.where("rank <= 3")).items():
        assert len(ids) == 3


def test_trace_counts_the_rows(world):
    found = run(world, pool_size=7, rerank=True, wanted_classes=("a",), scorer=se.overlap_scorer)
    rows = found.ranked.collect()
    both, lanes = fused(world)
    trace = found.trace()
    assert trace == {"lexical": lanes["lexical"].count(), "dense": lanes["dense"].count(), "fused": both.count(), "pool": sum(r.in_pool for r in rows), "reranked": sum(r.rerank_score is not None for r in rows), "final": len(rows)}


def test_rerank_orders_the_pool(world):
    df, vectors, queries, index = world
    text, asked = {r.id: r.text for r in df.collect()}, {r.query_id: r.text for r in queries.collect()}
    plain = run(world, balance=False, pool_size=8)
    found = run(world, balance=False, pool_size=8, rerank=True, scorer=se.overlap_scorer)
    got = lists(found.ranked)
    for q, ids in lists(plain.ranked).items():
        pool = sorted(ids[:8], key=lambda i: (-se.overlap_scorer(asked[q], [text[i]])[0], ids.index(i)))
        assert got[q] == pool + ids[8:]


def test_a_scorer_that_fails_leaves_the_order(world):
    def broken(query, passages):
        raise RuntimeError("no model")

    def slow(query, passages):
        time.sleep(0.02)
        return [1.0] * len(passages)

    def short(query, passages):
        return [1.0]

    plain = lists(run(world, pool_size=8).ranked)
    for scorer, limit in ((broken, 5.0), (slow, 0.001), (short, 5.0)):
        found = run(world, pool_size=8, rerank=True, scorer=scorer, rerank_timeout=limit)
        assert lists(found.ranked) == plain
        flags = {r.flag for r in found.ranked.where(F.col("in_pool")).collect()}
        assert flags == {se.UNAVAILABLE}


def test_all_terms_without_a_shuffle(spark):
    """Each set of words against plain loops, in parts of queries and slices of documents; no row is dealt out."""
    import random

    from marlstone.operators import retrieval as re_

    rng = random.Random(8)
    words = "red green blue grey the of tin".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6])))) for i in range(120)] + [(500, None), (501, "Red, GREEN!")]
    asked = [(f"q{i}", " ".join(rng.choice([*words, "absent"]) for _ in range(rng.choice([0, 1, 2, 3])))) for i in range(40)] + [("same", "red"), ("again", "RED the"), ("none", None)]
    plain = lambda t: {w.strip(",!").lower() for w in (t or "").split()} - set(re_.STOPWORDS)
    want = sorted((q, d) for q, a in asked for d, t in docs if plain(a) and plain(a) <= plain(t))
    df, qs = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id string, text string")
    for most in (1000, 7):
        lane = re_.all_terms_lane(qs, df, "id", "text", most_queries=most)
        assert sorted(map(tuple, lane.collect())) == want
        assert "Exchange" not in lane._jdf.queryExecution().executedPlan().toString()
    assert re_.all_terms_lane(qs.where("query_id = 'none'"), df, "id", "text").count() == 0


def test_the_lanes_run_once_for_a_scorer(world):
    """The pool is written before the scorer reads it, so no plan after it scores the texts again."""
    found = run(world, scorer=se.overlap_scorer, use_dense=False, rerank=True)
    assert "MapInArrow" not in found.ranked._jdf.queryExecution().executedPlan().toString()
    assert found.ranked.count() and found.trace()["lexical"] >= found.trace()["pool"] > 0
