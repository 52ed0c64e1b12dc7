"""What one worker or task holds: rows leave in parts, and plans deal out no more than they need."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from test_catalogue import plain_blocks

from marlstone.operators import ingestion
from marlstone.operators import packing as pk
from marlstone.operators import retrieval as re_
from marlstone.sources import tabular
from marlstone.streaming import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Caught:
    """A table that keeps the function it is mapped with."""

    dtypes = [("id", "bigint"), ("text", "string")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def parts_of(make, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    return list(make(Caught()).run(iter([batch])))


def test_token_spans_leave_in_parts(spark):
    texts = [None, "", *(f"a{i}, é b " * 2000 for i in range(40))]
    parts = parts_of(lambda df: ingestion.token_spans(df, "id", "text"), texts)
    assert max(sum(map(len, p.column(1).to_pylist())) for p in parts) <= ingestion.MOST_TOKENS + 8000
    got = [tuple(r) for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    spans = [[m.span() for m in re.finditer(ingestion.TOKEN, t or "")] for t in texts]
    assert got == [(i, [b for b, _ in s], [e for _, e in s]) for i, s in enumerate(spans)]


def test_sections_leave_in_parts(spark):
    texts = [None, " \n ", *("one\ntwo\n\nthree\n \n" * 3000 for _ in range(60)), "end"]
    parts = parts_of(lambda df: tabular.sections(df, "id", "text", markdown=False), texts)
    assert max(p.num_rows for p in parts) <= 2 * 6000 + tabular.MOST_CHARS // 3
    got = [tuple(r) for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    assert len(parts) > 2 and len(got) == 60 * 6000 + 1
    assert got[:2] == [(2, 0, [], "paragraph", "one two"), (2, 1, [], "paragraph", "three")] and got[-1] == (62, 0, [], "paragraph", "end")


def test_block_sizes(spark):
    rng = random.Random(3)
    rows = [(d, [rng.choice([0, 1, 3, 9, 25]) for _ in range(rng.choice([0, 1, 7, 60]))]) for d in range(80)] + [(99, None)]
    want = {}
    for d, sizes in rows:
        for n, b in zip(sizes or [], plain_blocks([(n, None) for n in sizes or []], 20), strict=True):
            want[d, b] = want.get((d, b), 0) + n
    df = spark.createDataFrame(rows, "doc long, sizes array<int>")
    got = pk.block_sizes(df, "doc", "sizes", 20)
    assert {(r.doc, r.block): r["size"] for r in got.collect()} == want and "Exchange" not in plan(got)
    units = df.select("doc", F.posexplode("sizes").alias("at", "n"))
    filled = pk.filled(units, ["doc"], ["at"], "n", 20)
    assert "Join" not in plan(filled) and "InPandas" not in plan(filled)
    assert {(r.doc, r.block): r.n for r in filled.groupBy("doc", "block").agg(F.sum("n").alias("n")).collect()} == want


def test_phrases_stay_in_the_row(spark):
    docs = [(1, "of the people"), (2, "Of  THE, of"), (3, "the of"), (4, None), (5, "of of the"), (6, "often the"), (7, "x of then")]
    asked = [(1, "of the"), (2, "the of"), (3, "!"), (4, "absent"), (5, "of")]
    plain = lambda t: f" {' '.join(re.findall('[^\\W_]+', (t or '').lower()))} "
    got = re_.phrase_matches(spark.createDataFrame(docs, "id int, text string"), "id", "text", spark.createDataFrame(asked, "phrase_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, p) for d, t in docs for p, s in asked if plain(s).strip() and plain(s) in plain(t))
    assert "SortMergeJoin" not in plan(got)


def test_a_gate_over_a_table_has_no_state(spark):
    rows = [("a", 1, " [E1]", True, None), ("a", 0, "x", False, ["E1"]), ("a", 0, "x", False, ["E1"]), ("b", 1, "late", True, None), (None, 0, "y [E7]", True, ["E1"])]
    got = keyed.gate_deltas(spark.createDataFrame(rows, "k string, seq int, delta string, last boolean, aliases array<string>"), "k")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 0, "text", "x"), ("a", 1, "text", " "), ("a", 2, "citation", "E1"), ("a", 3, "text", "[E1]"), (None, 0, "text", "y "), (None, 1, "unknown", "[E7]")], key=str)
    assert "TransformWithState" not in plan(got)
