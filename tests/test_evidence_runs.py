"""Evidence by handle, keyword hits, calls paired first come first served, series and texts compared by likeness."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import cells
from marlstone.operators import analytics as an
from marlstone.operators import evaluation as ev
from marlstone.operators import evidence as ed
from marlstone.operators import telemetry as te


def test_resolved_evidence(spark):
    parents = spark.createDataFrame([("WS/A@v1:P1", "A", 1, 1, "x" * 300), ("WS/A@v1:P2", "A", 1, 2, "middle"), ("WS/A@v1:P4", "A", 1, 4, "alone"), ("WS/A@v2:P1", "A", 2, 1, "new"), ("WS/B@v1:P1", "B", 1, 1, "gone")], "handle string, source string, version int, ordinal int, text string")
    children = spark.createDataFrame([("WS/A@v1:P2", "k1", 1, 0, 3), ("WS/A@v1:P2", "k2", 2, 3, 6)], "handle string, child string, ordinal int, char_start int, char_end int")
    versions = spark.createDataFrame([("A", 1, "ready"), ("A", 2, "ready"), ("B", 1, "purged"), ("C", 1, "ready")], "source string, version int, status string")
    asked = spark.createDataFrame([(1, "WS/A@v1:P2", "k2"), (2, "WS/A@v1:P4", "k1"), (3, "WS/A@v2:P1", None), (4, "WS/B@v1:P1", None), (5, "WS/C@v1:P9", None), (6, "junk", None), (7, None, None), (8, "WS/D@v1:P1", None)], "i int, handle string, child string")
    got = {r.i: r for r in ed.resolve(asked, "handle", parents, children, versions, "child").collect()}
    assert {i: r.state for i, r in got.items()} == {1: "found", 2: "found", 3: "found", 4: "deleted", 5: "missing", 6: "malformed", 7: "malformed", 8: "missing"}
    assert (got[1].text, got[1].previous_excerpt, got[1].next_excerpt, got[1].highlight, got[1].is_latest) == ("middle", "x" * 200, None, "dle", False)
    assert [c.child for c in got[1].children] == ["k1", "k2"] and got[2].previous_excerpt is None and got[2].highlight is None
    assert (got[3].is_latest, got[3].latest_version) == (True, 2) and got[4].text is None and got[4].children is None


def test_keyword_hits(spark):
    rows = [(1, "s", 1, "Blue Sky over water"), (2, "s", 2, "blue\n sky"), (3, "r", 1, "water"), (4, "r", 2, None), (5, "r", 3, "100% of_it")]
    df = spark.createDataFrame(rows, "id int, source string, ordinal int, text string").withColumn("handle", F.col("id").cast("string"))
    ids = lambda *a: sorted(r.id for r in ed.keyword_hits(df, *a).collect())
    assert ids(["blue", "WATER"]) == [1] and ids(["blue", "water"], "any") == [1, 2, 3] and ids(["blue", "sky"], "phrase") == [1, 2] and ids(["%"], "any") == [5] and ids(["_"], "any") == [5]
    assert ed.keyword_terms([" A  b", "a b", "C"]) == ["a b", "c"]
    for bad in ([""], ["x" * 61]):
        with pytest.raises(ValueError):
            ed.keyword_terms(bad)
    children = spark.createDataFrame([("1", "c1", 1, "Blue Sky"), ("1", "c2", 2, "over water"), ("2", "c1", 1, "none"), ("2", "c2", 2, "sky")], "handle string, child string, ordinal int, text string")
    terms = ["water", "sky"]
    got = [(r.place, r.handle, r.n_terms, r.anchor) for r in ed.first_hits(ed.keyword_hits(df, terms, "any"), children, terms, 5).collect()]
    assert got == [(1, "1", 2, "c1"), (2, "2", 1, "c2")]
    assert {r.source: r.n for r in ed.counts_by_source(ed.keyword_hits(df, terms, "any")).collect()} == {"s": 2, "r": 1}


def test_calls_are_paired_first_come_first_served(spark):
    rng = random.Random(14)
    rows = [(rng.randrange(4), rng.choice(["a", None]), rng.choice(["on", "on", "off", "other"]), float(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(rows, "run int, tool string, kind string, at double")
    want = []
    for key in {r[:2] for r in rows}:
        ends = sorted(r[3] for r in rows if r[:2] == key and r[2] == "off")
        used = [False] * len(ends)
        for s in sorted(r[3] for r in rows if r[:2] == key and r[2] == "on"):
            end = next((i for i, e in enumerate(ends) if not used[i] and e >= s), None)
            if end is not None:
                used[end] = True
            want.append((*key, s, None if end is None else ends[end]))
        want += [(*key, e, e) for i, e in enumerate(ends) if not used[i]]
    got = [(r.run, r.tool, r.started, r.completed) for r in te.paired(df, ["run", "tool"], "kind", "at", "on", "off").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_json_numbers_are_numbers(spark):
    docs = [('{"a": 1}', 1.0), ('{"a": 1.5}', 1.5), ('{"a": "2"}', None), ('{"a": true}', None), ('{"a": null}', None), ("{}", None), ("junk", None), (None, None), ('{"a": 1e30}', 1e30), ('{"a": [1]}', None)]
    df = spark.createDataFrame([(d,) for d, _ in docs], "d string")
    assert [r.x for r in df.select(cells.json_number(F.col("d"), "$.a").alias("x")).collect()] == [x for _, x in docs]


def test_run_details_tell_allowed_fields_only(spark):
    runs = spark.createDataFrame([(1, json.dumps({"mode": "fast", "secret": "x", "n": 3})), (2, None)], "id int, doc string")
    steps = spark.createDataFrame([(1, 2, "b", "hid"), (1, 1, "a", "hid")], "id int, at int, name string, key string")
    got = {r.id: (r.detail, r.steps) for r in te.run_details(runs, "id", "doc", ["mode", "n"], steps, "at", ["name"]).collect()}
    assert got == {1: ('{"mode":"fast","n":"3"}', '[{"name":"a"},{"name":"b"}]'), 2: ("{}", "[]")}


def test_series_need_few_values(spark):
    rows = [(0, "a", "x", 1), (1, "a", "y", 2), (2, "b", "x", 3), (3, "c", "y", 4)]
    df = spark.createDataFrame(rows, "at int, p string, q string, v int")
    got = {(r.series, r.category): r.value for r in an.grouped_series(df, "p", "q", "v").collect()}
    assert got == {("x", "a"): 1, ("y", "a"): 2, ("x", "b"): 3, ("y", "b"): None, ("x", "c"): None, ("y", "c"): 4}
    assert an.grouped_series(df, "p", "q", "v", most_series=1) is None and an.grouped_series(df.limit(0), "p", "q", "v") is None
    head, note = an.table_block(df, ["at"], 2)
    assert [r["at"] for r in head.collect()] == [0, 1] and note == "showing 2 of 4 rows" and an.table_block(df, ["at"])[1] is None


def test_texts_by_likeness(spark):
    found = spark.createDataFrame([(1, 1, "kitten"), (1, 2, "zzzzzz"), (1, 3, "sitting"), (2, 1, "x")], "item int, rank int, text string")
    wanted = spark.createDataFrame([(1, 1, "sitting"), (1, 2, "qqqq"), (3, 1, "y")], "item int, ref int, text string")
    got = {r.item: (r.recall, r.precision) for r in ev.text_scores(found, wanted, "item").collect()}
    # kitten to sitting: 3 edits of 7, likeness 0.571
    assert got[1] == (0.5, pytest.approx((1 + 2 / 3) / 2)) and got[2] == (None, None) and got[3] == (0.0, None)


def test_texts_by_likeness_try_few_before_all(spark, monkeypatch):
    monkeypatch.setattr(ev, "_FIRST", (1, 2))  # most texts stay open for the last round
    draw = random.Random(5)
    text = lambda: "".join(draw.choice("abcd") for _ in range(draw.randint(0, 7)))
    found, wanted = ([(i % 3, i // 6, text()) for i in range(90)] for _ in "ab")

    def like(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0

    kinds = "item int, {} int, text string"
    f, w = spark.createDataFrame(found, kinds.format("rank")), spark.createDataFrame(wanted, kinds.format("ref"))
    one = lambda df: df.withColumnRenamed("text", "_text").where("item = 1")
    got = {r._text for r in ev._alike(one(w), one(f), "item", lambda x: x > 0.7).collect()}
    assert got == {a for i, _, a in wanted if i == 1 and any(like(a, b) > 0.7 for j, _, b in found if j == 1)}
    for r in ev.text_scores(f, w, "item", 0.7).collect():
        refs = {(i, k) for i, k, a in wanted if any(i == j and like(a, b) > 0.7 for j, _, b in found)}
        own = [(i, k) in refs for i, k, _ in wanted if i == r.item]
        assert r.recall == pytest.approx(sum(own) / len(own))


def test_arms_over_common_items(spark):
    schema = "item int, recall_1 double, recall_5 double, recall_10 double, recall_20 double, reciprocal_rank double"
    a = spark.createDataFrame([(i, float(i % 2), 1.0, 1.0, 1.0, 0.5) for i in range(40)] + [(99, 1.0, 1.0, 1.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([(i, 0.0, 1.0, 0.5, 1.0, 0.75) for i in range(40)], schema)
    got = {r.metric: r for r in ev.compare_arms(a, b, "item", samples=300).collect()}
    assert (got["hit@1"].only_reference, got["hit@1"].only_other, got["hit@5"].p) == (20, 0, 1.0) and got["hit@1"].p < 1e-5
    assert got["mrr"].mean == pytest.approx(0.25) and got["recall@10"].mean == pytest.approx(-0.5) and got["recall@10"].low == pytest.approx(-0.5)
    assert {r.n for r in got.values()} == {40}
