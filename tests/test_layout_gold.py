"""Layout against lines read one by one; surface forms against contains; specs and gold values against plain sets."""

import json
import random

from marlstone.operators import gold as go
from marlstone.operators import layout as la

LINES = "doc int, page int, line int, text string, size double, top double, bottom double"


def plain_layout(lines):
    """Reads the lines of one document in order, with a state."""
    lines = sorted(x for x in lines if x[2].strip())
    sizes = {}
    for _, _, t, size, _, _ in lines:
        sizes[size] = sizes.get(size, 0) + len(t)
    body = max(sizes, key=lambda s: (sizes[s], -list(sizes).index(s))) if sizes else 0
    out, path, run, page_now, state = [], [], 0, None, {}
    for page, line, t, size, top, bottom in lines:
        if size - body <= -2:
            continue
        if page != page_now:
            page_now, state = page, {"prev": None, "open": None, "last_item": False, "n": 0}
        if size - body >= 2 and len(t) <= 160:
            path = [t] if size - body >= 5 else [*path[:1], t]
            state.update(open=None, last_item=False)
        else:
            item = t[:2] in la.BULLETS
            if item or state["open"] is None or state["prev"] is None or top - state["prev"] > 0.45 * body:
                if item and not state["last_item"]:
                    run += 1
                state["n"] += 1
                state["open"] = [page, state["n"], "item" if item else "paragraph", run if item else None, list(path), t[2:].strip() if item else t]
                state["last_item"] = item
                out.append(state["open"])
            else:
                state["open"][5] += " " + t
        state["prev"] = bottom
    return [tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, u)) for u in out]


def test_layout(spark):
    rng = random.Random(7)
    docs = {}
    for d in range(60):
        rows, top = [], 0.0
        for i in range(rng.randrange(0, 40)):
            top += rng.choice([0.0, 2.0, 4.0, 5.0, 9.0])
            text = rng.choice(["", "- ", "* ", "• ", "-", "  "]) + rng.choice(["word", "some more words", "x" * 170, "", "Title"])
            rows.append((i // rng.choice([12, 13]), i, text, rng.choice([10.0, 10.0, 10.0, 7.0, 8.0, 12.0, 15.0, 11.5]), top, top + 10))
            top += 10
        docs[d] = rows
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], LINES).repartition(5)
    got = {}
    for r in la.layout(df, "doc").orderBy("doc", "page", "unit").collect():
        got.setdefault(r.doc, []).append((r.page, r.unit, r.kind, r.list_run, tuple(r.heading_path), r.text))
    for d, rows in docs.items():
        assert got.get(d, []) == plain_layout(rows), d
    assert la.layout(df.limit(0), "doc").count() == 0
    assert la.thin_pages(spark.createDataFrame([(1, 1, 1, "one two", 10.0, 0.0, 9.0), (1, 2, 1, "a b c d e", 10.0, 0.0, 9.0), (1, 2, 2, "foot", 6.0, 0.0, 9.0)], LINES), "doc", 5).collect()[0]["page"] == 1


def test_surface_forms_equal_contains(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "é", "gamma ray", "ray", "a", "aa", "İx", "", "  ", "delta-9"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(200, None), (201, ""), (202, "ALPHA BETA ray" * 2000)]
    facts = [(f, [rng.choice([*words, "beta  a", "ray a"]) for _ in range(rng.randrange(0, 4))]) for f in range(60)]
    tdf, fdf = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(facts, "fact int, forms array<string>")
    known = spark.createDataFrame([(f, i) for f in range(10) for i in range(20)], "fact int, id int")
    got = {(r.fact, r.id) for r in go.surface_candidates(fdf, "fact", "forms", tdf, "id", "text", known).collect()}
    want = set()
    for f, forms in facts:
        low = [x.lower() for x in forms if x.strip()]
        want |= {(f, i) for i, t in texts if low and t is not None and all(x in t.lower() for x in low) and not (f < 10 and i < 20)}
    assert {x for x in got if "İx" not in dict(facts)[x[0]]} == {x for x in want if "İx" not in dict(facts)[x[0]]}


def test_ten_thousand_forms_in_blocks(spark):
    rng = random.Random(10)
    forms = list({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(40_000)})[:10_000]
    texts = [(i, "".join(rng.choice("abcde ") for _ in range(300))) for i in range(25)]
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    got = {(r.id, r.form) for r in go.form_hits(df, spark.createDataFrame(texts, "id int, text string"), "id", "text", block_chars=20_000).collect()}
    assert len(forms) == 10_000 and got == {(i, f) for i, t in texts for f in forms if f in t}


SPECS = [
    ("aggregate", {"filters": [{"column": "a", "op": "in", "values": ["2023"]}, {"column": "b", "op": "gt", "value": 5}], "metrics": [{"fn": "sum", "column": "x"}], "group_by": ["g", "h"]},
     "aggregate", {"filters": [{"column": "b", "op": "gt", "operands": ["5.0"]}, {"column": "a", "op": "eq", "value": 2023}], "metrics": [{"fn": "count"}, {"fn": "sum", "column": "x"}], "group_by": ["h", "g"]}, (True, True, True)),
    ("aggregate", {"metrics": [{"fn": "sum", "column": "x"}]}, "aggregate", {"metrics": [{"fn": "mean", "column": "x"}], "group_by": ["g"]}, (True, False, False)),
    ("aggregate", {"metrics": []}, "aggregate", {"metrics": []}, (True, False, True)),
    ("aggregate", {"metrics": [{"fn": "share", "condition": {"column": "c", "op": "in", "values": ["x"]}}]}, "aggregate", {"metrics": [{"fn": "share", "column": "zzz", "condition": {"column": "c", "op": "eq", "value": "x"}}]}, (True, True, True)),
    ("group_compare", {"metric": {"fn": "mean", "column": "x"}, "compare_column": "g", "group_a": "A", "group_b": "B"}, "group_compare", {"metric": {"fn": "mean", "column": "x"}, "compare_column": "g", "group_a": "B", "group_b": "A"}, (True, True, True)),
    ("group_compare", {"metric": {"fn": "mean", "column": "x"}, "compare_column": "g", "group_a": "A", "group_b": "B"}, "aggregate", {"metrics": [{"fn": "mean", "column": "x"}], "group_by": ["g"]}, (True, True, False)),
    ("filter_rows", {"filters": [{"column": "a", "op": "not_in", "values": ["q"]}]}, "filter_rows", {"filters": [{"column": "a", "op": "ne", "value": "q"}]}, (True, None, None)),
    ("filter_rows", {"filters": [{"column": "a", "op": "in", "values": ["q", "r", "q"]}]}, "filter_rows", {"filters": [{"column": "a", "op": "in", "values": ["r", "q"]}]}, (True, None, None)),
    ("filter_rows", {}, "filter_rows", {"filters": [{"column": "a", "op": "is_null"}]}, (False, None, None)),
    ("filter_rows", {}, "filter_rows", {}, (True, None, None)),
]


def test_spec_components(spark):
    df = spark.createDataFrame([(i, a, json.dumps(b), c, json.dumps(d)) for i, (a, b, c, d, _) in enumerate(SPECS)], "i int, gt string, gs string, t string, s string")
    for r in go.spec_components(df, "gt", "gs", "t", "s").collect():
        assert (r.filter_ok, r.aggregation_ok, r.grouping_ok) == SPECS[r.i][-1], SPECS[r.i]


def test_gold_values(spark):
    cells = [
        (1, 0, "D:1", "aggregate", "sum", "x", {"g": "A"}, "10.5", "10.512", 4, "number"), (1, 1, "D:1", "aggregate", "sum", "x", {"g": "A"}, "10.5", "10.51", 4, "percent"), (1, 2, "D:1", "aggregate", "sum", "x", {"g": "B"}, "10.5", "10.51", 4, None),
        (1, 3, "D:1", "filter_rows", None, "name", {}, "Joe", None, None, None), (1, 4, "D:1", "aggregate", "share", "y", {}, None, None, 0, "percent"), (1, 5, "D:1", "group_compare", "sum", "x", {go.DIFFERENCE: "1"}, "3", "3", None, "number"),
        (2, 0, "D:1", "aggregate", "sum", "x", {"g": "A"}, "10.5", "10.51", 4, "number"),
    ]
    gold = [
        (1, 1, "D:1", "aggregate", "sum", "x", {"g": "A"}, "10.50", "10.51", 4, "number"), (1, 2, "D:1", "aggregate", "sum", "x", {"g": "C"}, "10.5", "10.51", 4, "number"), (1, 3, "D:1", "filter_rows", None, "name", {}, "Joe", None, None, "text"),
        (1, 4, "D:1", "aggregate", "share", None, {}, None, None, None, "percent"), (1, 5, "D:1", "group_compare", "sum", "x", {go.DIFFERENCE: "1"}, "3.0", "3", None, "number"), (1, 6, "D:2", "aggregate", "sum", "x", {}, "3", "3", None, "number"),
        (1, 7, "D:1", "aggregate", "sum", "x", {}, "10.5", None, 5, "number"), (3, 1, "D:1", "aggregate", "sum", "x", {}, "1", "1", None, None),
    ]
    cs = "item int, place int, dataset string, operation string, fn string, column string, group map<string,string>, value string, exact string, denominator int, unit string"
    gs = "item int, fact int, dataset string, tool string, fn string, column string, group map<string,string>, value string, exact string, denominator int, unit string"
    got = {(r.item, r.fact): (r.place, r.exact_equal, r.rounded_equal, r.denominator_ok, r.unit_ok) for r in go.match_gold(spark.createDataFrame(gold, gs), spark.createDataFrame(cells, cs), "item", "fact").collect()}
    assert got == {
        (1, 1): (1, True, True, True, False), (1, 2): (None, False, False, False, False), (1, 3): (3, False, True, None, None), (1, 4): (4, True, True, None, True), (1, 5): (5, True, True, None, True),
        (1, 6): (None, False, False, False, False), (1, 7): (0, False, True, False, True), (3, 1): (None, False, False, False, False),
    }
