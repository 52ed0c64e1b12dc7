"""Running totals, quantiles, medians and splits over ranges against plain lists; filters reach the file reader."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import analytics as an
from marlstone.operators import totals as to
from marlstone.plans.spec import Schema


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(40)
    return [(rng.choice(["a", "a", "a", "a", "b", None]), rng.choice([None, *[round(rng.uniform(-5, 5), 1) for _ in range(6)]]), i) for i in range(700)] + [("none", None, 900), ("one", 3.25, 901)]


def test_running_totals(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(7)
    got = {(r.g, r.i): r.t for r in to.running_totals(df, ["g"], [F.col("i")], "t", F.col("i")).collect()}
    total, want = {}, {}
    for g, _, i in sorted(rows, key=lambda r: r[2]):
        total[g] = total.get(g, 0) + i
        want[g, i] = total[g]
    assert got == want
    alone = {r.i: r.t for r in to.running_totals(df, [], [F.desc("i")], "t", F.lit(1)).collect()}
    assert alone == {i: n for n, i in enumerate(sorted((r[2] for r in rows), reverse=True), 1)}


def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in to.quantiles(df, ["g"], F.col("v"), shares).collect():
        own = [v for g, v, _ in rows if g == r.g and v is not None]
        assert r.n == len(own)
        assert [r[n] for n in shares] == ([pytest.approx(float(np.quantile(own, p))) for p in shares.values()] if own else [None] * len(shares))
    every = to.quantiles(df, [], F.col("v"), {"m": 0.5}).first()
    assert every.m == pytest.approx(statistics.median(v for _, v, _ in rows if v is not None))
    none = to.quantiles(df.limit(0), [], F.col("v"), {"m": 0.5}).collect()
    assert [(r.m, r.n) for r in none] == [(None, 0)] and to.quantiles(df.limit(0), ["g"], F.col("v"), {"m": 0.5}).count() == 0


def test_medians_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i long")
    schema = Schema.of(g="categorical", v="numeric")
    got = {r["g"]: r["value_0"] for r in an.aggregate(df, schema.aggregate({"metrics": [{"fn": "median", "column": "v"}], "group_by": ["g"]})).collect()}
    for g in ("a", "b", "one"):
        assert got[g] == pytest.approx(round(statistics.median(v for x, v, _ in rows if x == g and v is not None), 2), abs=0.011)
    assert got["none"] is None
    whole = an.aggregate(df, schema.aggregate({"metrics": [{"fn": "median", "column": "v"}]})).first()
    assert whole["value_0"] == pytest.approx(statistics.median(v for _, v, _ in rows if v is not None), abs=0.011)


def test_filters_reach_the_reader(spark, tmp_path):
    values = [None, -1.0, 0.0, 0.1, 0.30000000000000004, 0.3, 5.0, 5.0000000001, 1e17, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "i int, v double, n long")
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    schema = Schema.of(i="numeric", v="numeric", n="numeric")
    for op, value in [("gt", 0), ("gte", 0.3), ("lt", 5), ("lte", 5), ("eq", 0.3), ("eq", 5), ("between", [0.1, 5]), ("in", [0.1, 5, 7]), ("ne", 5), ("gt", 1e16)]:
        asked = {"column": "v", "op": op, **({"values": value} if isinstance(value, list) else {"value": value})}
        chosen = an.select(table, schema.aggregate({"metrics": [{"fn": "count"}], "filters": [asked]}).filters)
        exact = table.where(an.predicate(schema.aggregate({"metrics": [{"fn": "count"}], "filters": [asked]}).filters[0]))
        assert sorted(r.i for r in chosen.collect()) == sorted(r.i for r in exact.collect()), asked
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: ")[1].split("]")[0]
        assert op == "ne" or "ThanOrEqual(v" in pushed, (asked, pushed)


def test_token_overlap_by_rare_tokens(spark):
    from marlstone.operators import evaluation as ev

    rng = random.Random(6)
    sets = [(i, ["common", *rng.sample([f"w{k}" for k in range(14)], rng.randrange(0, 7))]) for i in range(60)] + [(100, []), (101, ["only"])]
    a = spark.createDataFrame(sets, "a_id int, tok array<string>")
    b = spark.createDataFrame(sets, "b_id int, tok array<string>")
    for least in (0.0, 0.2, 0.5, 0.8, 1.0):
        got = {(r.a_id, r.b_id): r.jaccard for r in ev.token_overlap(a, b, "tok", least).collect()}
        want = {}
        for i, x in sets:
            for j, y in sets:
                k = len(set(x) & set(y))
                if k and k / len(set(x) | set(y)) >= least - 1e-9:
                    want[i, j] = round(k / len(set(x) | set(y)), 9)
        assert got == want, least


def test_anchors_in_one_parent(spark):
    from marlstone.operators import links

    parents = spark.createDataFrame([(1, "The cat sat  on the mat. Dogs bark."), (2, "Once the cat sat on the mat again"), (3, None), (4, "")], "p int, t string")
    anchors = spark.createDataFrame([("Dogs bark.",), ("cat sat on the mat",), ("the mat. Dogs",), ("no such words here",), ("",), (None,), ("bark.",)], "a string")
    got = {r.a: (r.n_parents, r.parent) for r in links.anchored(anchors, "a", parents, "p", "t").collect()}
    assert got == {"Dogs bark.": (1, 1), "cat sat on the mat": (2, None), "the mat. Dogs": (1, 1), "no such words here": (0, None), "": (0, None), None: (0, None), "bark.": (1, 1)}
