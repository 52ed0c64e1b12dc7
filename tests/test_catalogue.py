"""Blocks against a plain loop, quotes, windows and cursors on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import catalogue as ca
from marlstone.operators import packing as pk

count = lambda s: len(re.findall(pk.TOKEN, s))


def plain_blocks(rows, most):
    """Block numbers of (size, run) in order, by trying what each unit and its whole run need."""
    total = {}
    for n, r in rows:
        total[r] = total.get(r, 0) + n
    out, room, last, number = [], most, None, 0
    for n, r in rows:
        begins = r is not None and r != last
        short = n > room or (begins and room < total[r] <= most)
        if short and room < most:
            number, room = number + 1, most
        room, last = room - n, r
        out.append(number)
    return out


def test_filled(spark):
    rng = random.Random(5)
    rows, want = [], []
    for doc in range(60):
        units, run = [], 0
        while len(units) < 40:
            length = rng.choice([1, 1, 2, 5])
            run += 1
            units += [(rng.randint(1, 14), run if length > 1 else None) for _ in range(length)]
        rows += [(doc, i, n, r) for i, (n, r) in enumerate(units)]
        want += [(doc, i, b) for i, b in enumerate(plain_blocks(units, 20))]
    df = spark.createDataFrame(rows, "doc long, at int, n int, run int")
    got = pk.filled(df, ["doc"], ["at"], "n", 20, "run").select("doc", "at", "block").collect()
    assert sorted(map(tuple, got)) == want
    assert pk.filled(df.limit(0), ["doc"], ["at"], "n", 20).count() == 0


def test_blocks(spark):
    long = " ".join(f"W{i} is word {i} of this text." for i in range(40))
    endless = " ".join(f"x{i}" for i in range(95))
    rows = [(1, 0, long, None), (1, 1, endless, None), (1, 2, "short", None), (1, 3, None, None), (2, 0, "", None), (3, 0, "only one", None)]
    rows += [(4, i, f"item {i} of a list", 7) for i in range(12)]
    df = spark.createDataFrame(rows, "doc long, at int, text string, run int")
    got = {(r.doc, r.block): r for r in pk.blocks(df, "doc", "at", "text", "run", most=30).collect()}
    assert all(r.n_tokens <= 30 and count(r.text) == r.n_tokens for r in got.values())
    one = " ".join(got[k].text for k in sorted(got) if k[0] == 1)
    assert one.split() == f"{long} {endless} short".split()
    assert (2, 0) not in got and got[3, 0].text == "only one" and got[3, 0].list_group is None
    lists = [got[k] for k in sorted(got) if k[0] == 4]
    assert len(lists) > 1 and all(r.list_group == 7 for r in lists)
    assert "\n".join(r.text for r in lists) == "\n".join(f"- item {i} of a list" for i in range(12))
    assert pk.blocks(df.limit(0), "doc", "at", "text", "run").count() == 0


@pytest.mark.parametrize(
    "text, quote, want",
    [("a b  c", "b c", (2, 6)), ("one\n two", " one two ", (0, 8)), ("x", "y", None), ("x", "", None), ("x", None, None), (None, "x", None), (r"a \E. b", r"\E. b", (2, 7)), ("a.c abc", "abc", (4, 7)), ("p $1 (q", "$1  (q", (2, 7))],
)
def test_quote_span(spark, text, quote, want):
    df = spark.createDataFrame([(text, quote)], "t string, q string").select(ca.quote_span(F.col("t"), F.col("q")).alias("s"))
    got = df.first().s
    assert (tuple(got) if got else None) == want


def test_anchor_window(spark):
    text = " ".join(f"word{i}" for i in range(100))
    at = text.index("word50")
    df = spark.createDataFrame([(text, 100, at, at + 6), ("few words", 2, 0, 3), ("", 0, 0, 0)], "t string, n int, s int, e int")
    got = [r.w for r in df.select(ca.anchor_window(F.col("t"), F.col("n"), F.col("s"), F.col("e"), 10).alias("w")).collect()]
    assert "word50" in got[0].window.split() and set(got[0].window.split()) <= set(text.split()) and 9 <= len(got[0].window.split()) <= 13
    assert text[got[0].lo : got[0].hi].strip() == got[0].window
    assert (got[1].lo, got[1].window) == (None, "few words") and got[2].window == ""


def test_cursor_and_limits(spark):
    df = spark.createDataFrame([(None, None, None, 0), (9, 5, 7, 3), (1, 5, 7, 3), (1, 5, 7, 1)], "b int, l int, n int, k int")
    got = [r.c for r in df.select(ca.next_cursor(F.col("b"), F.col("l"), F.col("n"), F.col("k"), 3).alias("c")).collect()]
    assert got == [None, 9, 5, 7]
    with pytest.raises(ValueError, match="scan limit"):
        ca.rows_of(df, "b", 1, 20_001)


def test_row_units_without_free_text(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, a string, f string")
    got = {r.k: r for r in ca.row_units(df, "k", "T", ["a", "f"], ["k"], ["a"], "f").collect()}
    assert got[1].text == "a: a" and got[1].retrieval is None and got[2].text == "" and got[2].char_start is None
    assert ca.row_units(df, "k", "T", ["a"], ["k"], [], None).first().retrieval is None
