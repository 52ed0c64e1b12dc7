"""Rules of cells, requests, streams and statistics on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import cells
from marlstone.operators import analytics as an
from marlstone.operators import figures, ingestion
from marlstone.operators import evaluation as ev
from marlstone.operators import retrieval as re_
from marlstone.plans.spec import Schema, SpecError, dataset_id, request_key
from marlstone.sources import tabular
from marlstone.streaming import events

SCHEMA = Schema.of(id="text", seg="categorical", x="numeric", rate_pct="numeric", day="date")
ROWS = [("a", "A", "10", "12.25", "2024-02"), ("b", "A", "20.0", "12.35", "2024-02-29"), ("c", "B", None, None, "2024-03-01"), ("d", "B", "n/a", "1", None), ("e", " ", "-5", "0", "2024-13")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "n int, id string, seg string, x string, rate_pct string, day string")


def one(df):
    return df.first()


def test_null_rules(spark, table):
    count = lambda *f: one(an.aggregate(table, SCHEMA.aggregate({"metrics": [{"fn": "count"}], "filters": list(f)})))["denominator_0"]
    assert count({"column": "x", "op": "is_null"}) == 2
    assert count({"column": "x", "op": "ne", "value": 10}) == 2
    assert count({"column": "seg", "op": "is_null"}) == 1
    assert count({"column": "x", "op": "eq", "value": "20"}) == 1
    assert count({"column": "day", "op": "gte", "value": "2024-02-10"}) == 2
    assert count({"column": "day", "op": "lte", "value": "2024-02"}) == 2
    assert count({"column": "day", "op": "between", "values": ["2024-02", "2024-02-28"]}) == 0


def test_metrics(spark, table):
    spec = {"metrics": [{"fn": "sum", "column": "x"}, {"fn": "mean", "column": "rate_pct"}, {"fn": "median", "column": "x"}, {"fn": "share", "condition": {"column": "x", "op": "gt", "value": 0}}]}
    r = one(an.aggregate(table, SCHEMA.aggregate(spec)))
    assert (r["value_0"], r["denominator_0"]) == (25.0, 3)
    assert r["value_1"] == 6.4  # 25.6 / 4
    assert r["value_2"] == 10.0
    assert (r["value_3"], r["numerator_3"], r["denominator_3"]) == (66.7, 2, 3)
    assert r["warnings"] == ["NULLS_EXCLUDED"]


def test_half_even(spark):
    r = spark.range(1).select(*[cells.half_even(F.lit(v).cast("decimal(38,10)"), 1).alias(f"v{i}") for i, v in enumerate(("12.25", "12.35", "-0.04"))]).first()
    assert tuple(r) == (12.2, 12.4, 0.0) and str(r[2]) == "0.0"


def test_groups_order(spark, table):
    up = an.aggregate(table, SCHEMA.aggregate({"metrics": [{"fn": "count"}], "group_by": ["seg"]}), "n").collect()
    assert [r["seg"] for r in up] == ["A", "B", None]
    down = an.aggregate(table, SCHEMA.aggregate({"metrics": [{"fn": "count"}], "group_by": ["seg"], "descending": True}), "n").collect()
    assert [r["seg"] for r in down] == [None, "B", "A"]


def test_requests_are_closed():
    for bad in (
        {"metrics": [{"fn": "median", "column": "seg"}]},
        {"metrics": [{"fn": "count"}], "filters": [{"column": "seg", "op": "gt", "value": "A"}]},
        {"metrics": [{"fn": "count"}], "filters": [{"column": "x", "op": "eq", "value": "NaN"}]},
        {"metrics": [{"fn": "count"}], "sql": "1"},
        {"metrics": []},
        {"metrics": [{"fn": "count"}], "filters": [{"column": "day", "op": "gte", "value": "2024-13"}]},
    ):
        with pytest.raises(SpecError):
            SCHEMA.aggregate(bad)
    assert request_key("aggregate", {"a": 1, "b": 2}) == request_key("aggregate", {"b": 2, "a": 1})
    assert dataset_id("SURV:1") == ("SURV", 1)
    assert SCHEMA.columns["rate_pct"].unit == "percent"


def test_empty_table(spark, table):
    r = one(an.aggregate(table.limit(0), SCHEMA.aggregate({"metrics": [{"fn": "count"}, {"fn": "sum", "column": "x"}]})))
    assert (r["value_0"], r["value_1"], r["warnings"]) == (0.0, None, ["EMPTY_SELECTION", "ZERO_DENOMINATOR"])


def test_pack_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 60), (1, 12, 3, 40), (1, 13, 4, 20)], "query_id int, k int, rank int, t int")
    got = re_.evidence_pack(df, "k", "rank", "t", most_items=3, most_tokens=100).orderBy("pack_rank").collect()
    assert [r["k"] for r in got] == [10, 12]


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, ""), (3, None)], "id int, text string")
    got = ingestion.windows(ingestion.token_spans(df, "id", "text"), "id").orderBy("ordinal").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 192), (160, 352), (320, 500)]


def test_sections(spark):
    df = spark.createDataFrame([(1, "# T\n\npara one\nmore\n\n## S\n- item\n")], "id int, text string")
    got = tabular.sections(df, "id", "text").orderBy("ordinal").collect()
    assert [(r["heading_path"], r["kind"], r["block"]) for r in got] == [(["T"], "paragraph", "para one more"), (["T", "S"], "item", "item")]


def test_csv_rows_keep_numbers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n,\n3,z\n')
    got = tabular.read_csv(spark, str(tmp_path / "t.csv")).orderBy("row_number").collect()
    assert [(r["row_number"], r["a"]) for r in got] == [(2, "1"), (4, "3")]


def test_numbers(spark):
    df = spark.createDataFrame([("Sales rose 3.5% to $1.2 million in 2021, twelve more than 1,200",)], "t string")
    got = one(figures.with_mentions(df, "t", bare=True))["mentions"]
    assert [(n["value"], n["percent"], n["currency"], n["temporal"]) for n in got] == [(3.5, True, None, False), (1.2e6, False, "USD", False), (2021.0, False, None, True), (12.0, False, None, False), (1200.0, False, None, False)]


def test_bootstrap_and_floor(spark):
    df = spark.createDataFrame([("a", float(i % 2)) for i in range(100)], "g string, v double")
    r = one(ev.bootstrap(df, "g", "v", samples=500))
    assert r["mean"] == 0.5 and 0.35 < r["low"] < 0.5 < r["high"] < 0.65
    assert ev.below_floor(spark.createDataFrame([(0.4,)], "m double"), {"m": 0.5}).count() == 1


def test_scope_is_needed(spark, table):
    with pytest.raises(PermissionError):
        tabular.scoped(table, None)


def test_event_stream(spark, tmp_path):
    rows = [(1, 0, "start", "", 0), (1, 1, "token", "he", 1), (1, 2, "token", "llo", 1), (1, 3, "done", "", 2), (2, 0, "start", "", 0), (2, 2, "token", "x", 1)]
    log = spark.createDataFrame(rows, "run_id long, seq long, type string, payload string, s long").select("run_id", "seq", "type", "payload", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    log.union(log).write.parquet(str(tmp_path / "in"))
    q = events.append_once(events.read_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 6
    assert [r["seq"] for r in events.replay(stored, 1, 1).collect()] == [2, 3]
    assert [r["run_id"] for r in events.gaps(stored).collect()] == [2]
    assert {r["payload"] for r in events.coalesce_tokens(stored).where("type = 'token' AND run_id = 1").collect()} == {"hello"}
