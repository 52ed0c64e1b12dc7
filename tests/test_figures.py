"""Numbers of texts against a table of written forms, and support against plain arithmetic."""

import itertools
import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import figures as fg

NUMBERS = ["7", "12.5", "1,250", "612.0", "3,400,000.25", "0.4"]
#: Form, scale, percent, currency, labelled; {} is the number.
STYLES = [
    ("it was {} at last", 1, False, None, False), ("it was ${}", 1, False, "USD", False), ("US${} in cash", 1, False, "USD", False), ("EUR {} of it", 1, False, "EUR", False), ("£{}m", 1e6, False, "GBP", False),
    ("${} million", 1e6, False, "USD", False), ("${} Billion", 1e9, False, "USD", False), ("€{}bn,", 1e9, False, "EUR", False), ("{}k", 1e3, False, None, False), ("{} trillion", 1e12, False, None, False),
    ("{}%", 1, True, None, False), ("{} percent", 1, True, None, False), ("{} per cent.", 1, True, None, False), ("{}pct", 1, True, None, False), ("a percentage: {} %", 1, True, None, False),
    ("{} respondents", 1, False, None, True), ("n: {}", 1, False, None, True), ("sample_size = {}", 1, False, None, True), ("{}bps", 1, False, None, True), ("{}x", 1, False, None, True), ("{}pp", 1, False, None, True),
    ("growth_pct: {}", 1, True, None, False), ("revenue_musd: {}", 1e6, False, "USD", False), ("revenue_usd_m: {}", 1e6, False, "USD", False), ("sales (EUR million): {}", 1e6, False, "EUR", False),
    ("net_sales_gbp: {}", 1, False, "GBP", False), ("value_usd_bn: {}", 1e9, False, "USD", False), ("line one\n2. {}", 1, False, None, False), ("see [E3] {} [R12]", 1, False, None, False), ("A-{0} no, but {0}", 1, False, None, False),
    ("v1.2.3 then {}", 1, False, None, False), ("Q2 and COVID-19: {}", 1, False, None, False), ("({})", 1, False, None, False), ("“{}”", 1, False, None, False), ("é{0} x, then {0}", 1, False, None, False),
]
FORMS = [(style[0].format(n), float(n.replace(",", "")) * style[1], *style[1:]) for style, n in itertools.product(STYLES, NUMBERS)]


def test_table_of_forms(spark):
    assert len(FORMS) >= 200
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FORMS)], "i int, t string")
    got = {r.i: r.mentions for r in fg.with_mentions(df, "t").collect()}
    for i, (text, value, scale, percent, currency, labelled) in enumerate(FORMS):
        assert len(got[i]) == 1, (text, got[i])
        m = got[i][0]
        assert (m.value, m.scale, m.percent, m.currency, m.labelled, m.temporal) == (pytest.approx(value), scale, percent, currency, labelled, False), (text, m)


SPELLED = {
    "nine hundred million": 9e8, "one point two billion": 1.2e9, "two thousand and five": 2005, "forty-two percent": 42, "a hundred": None, "thirteen": None, "one of the drivers": None, "three million four hundred thousand": 3.4e6,
    "seventeen per cent": 17, "zero point five percent": 0.5, "sixty thousand": 6e4, "Twelve Million": 1.2e7, "one hundred and one thousand": 101_000, "fourteen hundred": 1400, "six": None,
}


def values(spark, text, **options):
    got = fg.with_mentions(spark.createDataFrame([(text,)], "t string"), "t", **options).first()["mentions"]
    return got


def test_numbers_in_words(spark):
    df = spark.createDataFrame([(t,) for t in SPELLED], "t string")
    got = {r.t: [m.value for m in r.mentions] for r in fg.with_mentions(df, "t").collect()}
    assert got == {t: [] if v is None else [pytest.approx(v)] for t, v in SPELLED.items()}
    bare = {r.t: [m.value for m in r.mentions] for r in fg.with_mentions(df, "t", bare=True).collect()}
    assert bare["thirteen"] == [13] and bare["one of the drivers"] == [1] and bare["six"] == [6]


def test_ranges(spark):
    pick = lambda t: [(m.value, m.percent, m.currency) for m in values(spark, t)]
    assert pick("5-7%") == [(5, True, None), (7, True, None)]
    assert pick("$1.2-1.5 million") == [(1.2e6, False, "USD"), (1.5e6, False, "USD")]
    assert pick("between 14 and 21 percent") == [(14, True, None), (21, True, None)]
    assert pick("5 to 10 million") == [(5e6, False, None), (1e7, False, None)]
    assert pick("from 900,000 to 1.2 million") == [(9e5, False, None), (1.2e6, False, None)]
    assert pick("12 units to 3 million") == [(12, False, None), (3e6, False, None)]
    assert pick("€4–6bn") == [(4e9, False, "EUR"), (6e9, False, "EUR")]
    assert pick("14-21") == [(14, False, None), (21, False, None)] and pick("fell to -21") == [(-21, False, None)]


YEARS = {
    "Q3 2024": [True], "in 2024": [True], "2019 sales": [False], "the 2026 edition": [True], "March 3, 2026": [False, True], "2024-03-05": [True, False, False], "3/4/2026": [False, False, True], "in 2023, 2024 and 2025": [True] * 3,
    "2023-2025 plan": [True, True], "2,024 people": [False], "2024 respondents": [False], "since 1899": [False], "(2025)": [True], "$2024": [False], "2024/25": [False, False], "FY2025": [], "2021, 2022, 2023 and 2024 in 2025": [False] * 4 + [True],
}


def test_years(spark):
    df = spark.createDataFrame([(t,) for t in YEARS], "t string")
    assert {r.t: [m.temporal for m in r.mentions] for r in fg.with_mentions(df, "t").collect()} == YEARS


def test_odd_texts(spark):
    rows = [(None, "a"), ("", "a"), ("no figures", "a"), ("1,5 %", "a"), ("1.2.3", "a"), ("\u00015\u0002", "a"), ("5 " * 3000, "a"), ("5 " * 3000, "a")]
    df = spark.createDataFrame(rows, "t string, mentions string")
    got = [(r.t, [m.value for m in r.mentions]) for r in fg.with_mentions(df, "t").collect()]
    assert got == [(None, []), ("", []), ("no figures", []), ("1,5 %", []), ("1.2.3", []), ("\u00015\u0002", [5]), *[("5 " * 3000, [5] * 3000)] * 2]
    assert fg.with_mentions(df.limit(0), "t").count() == 0


SUPPORT = [
    ("$612.0 million", "612.0", True), ("612 million", "612 billion", False), ("612,000,000", "$612.0M", True), ("3.2%", "-3.2%", True), ("3.2%", "growth_pct: 3.2", True), ("3.2%", "3.2 respondents", False), ("3.2%", "$3.2", False),
    ("$5", "€5", False), ("$5", "5", True), ("12", "12.0000001", True), ("12", "12.1", False), ("5-7%", "5%, 7%", True), ("nine hundred million", "900M", True), ("0", "0", True), ("410 people", "n: 410", True), ("7", "no figure", False),
]


def test_support_by_evidence(spark):
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(SUPPORT)], "i int, a string, e string")
    bad = {r.i for r in fg.unsupported(df, "a", "e", "i").collect()}
    assert bad == {i for i, (*_, ok) in enumerate(SUPPORT) if not ok}


def test_digits_state_a_value_by_half_even_rounding(spark):
    exact = [Decimal(x) for x in ("2.5", "3.5", "2.25", "-2.35", "0.004", "0", "1234.5678", "12", "-0.05", "99.995")]
    rows = [(str(abs(e.quantize(Decimal(1).scaleb(-p), rounding=ROUND_HALF_EVEN)) + d), e) for e in exact for p in range(4) for d in (Decimal(0), Decimal("0.1"))]
    df = spark.createDataFrame(rows, "digits string, exact decimal(20,6)").withColumn("ok", fg.stated_as(F.col("digits"), F.bround("exact", 2), F.col("exact")))
    for r in df.collect():
        e, digits = abs(Decimal(r.exact).normalize()), Decimal(r.digits)
        places = -digits.as_tuple().exponent
        rounded = abs(Decimal(r.exact)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_EVEN) == digits
        plain = digits in (e, abs(Decimal(r.exact).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)))
        assert r.ok == ((rounded or plain) and not (digits == 0 and e != 0)), r


RESULTS = [
    ("A was 3.5 higher than B", "difference", "number", "", "3.5", True), ("A was 3.5 lower than B", "difference", "number", "", "3.5", False), ("B was 3.5 lower than A", "difference", "number", "", "3.5", True),
    ("A was 3.5 lower than B", "difference", "number", "", "-3.5", True), ("the gap between A and B is 3.5", "difference", "number", "", "3.5", True), ("the gap between A and B is 3.5", "difference", "number", "", "-3.5", False),
    ("A is up and B is down by 3.5", "difference", "number", "", "3.5", False), ("a difference of 12.5 points", "difference", "percent", "", "12.5", True), ("12.5% of A", "metric", "percent", "", "12.5", True),
    ("12.5 of A", "metric", "percent", "", "12.5", False), ("$612.0 million in A", "metric", "currency_usd", "million", "612", True), ("$612.0 in A", "metric", "currency_usd", "million", "612", False), ("€612 million", "metric", "currency_usd", "million", "612", False),
    ("A rose 12.5%", "metric", "percent", "", "12.5", False), ("a loss of 12.5%", "metric", "percent", "", "-12.5", True), ("A stood at 12.5%", "metric", "percent", "", "-12.5", False), ("about 410 rows", "count", "count", "", "410", True),
    ("about 411 rows", "count", "count", "", "410", False), ("a multiple of 2.5x", "metric", "ratio", "", "2.5", True), ("-3.5 for A", "metric", "number", "", "-3.5", True),
]


def test_support_by_results(spark):
    df = spark.createDataFrame([(i, t, k, u, s, Decimal(v)) for i, (t, k, u, s, v, _) in enumerate(RESULTS)], "i int, t string, k string, u string, s string, v decimal(20,6)")
    said = fg.with_mentions(df, "t", context=200)
    ok = fg.result_supports(F.col("mentions")[0], F.col("k"), F.col("u"), F.col("s"), F.col("v"), F.col("v"), F.lit("A"), F.lit("B"))
    for r in said.select("i", ok.alias("ok")).collect():
        assert r.ok == RESULTS[r.i][-1], RESULTS[r.i]


def test_recheck_of_stored_answers(spark):
    texts = spark.createDataFrame([("H1", "Sales of $612.0M and 12 stores."), ("H2", "Share 14%")], "handle string, body string")
    said = spark.createDataFrame([(1, "Sales were $612 million [[H1]]. It has 13 stores [[H1]][[H2]]. A bare 99 is not checked."), (2, "Share is 14% [[H2]] now [[H9]]. 5 of it [[H9]]."), (3, None)], "id int, content string")
    got = sorted((r.id, r.unit, r.numbers) for r in fg.recheck(said, texts, "id", "content", "handle", "body").collect())
    assert got == [(1, 1, ["13"]), (2, 1, ["5"])]


def test_summary_status(spark):
    rows = [("It grew to 12.5 and $3 million.", "computed", [12.5, 3e6]), ("It grew to 12.6.", "computed", [12.5]), (" ", "computed", [1.0]), (None, "computed", []), ("All 12.5.", "failed", [12.5]), ("No figures.", "computed", [])]
    df = spark.createDataFrame(rows, "t string, s string, a array<double>")
    assert [r.summary_status for r in fg.summary_status(df, "t", "s", "a").collect()] == ["verified", "unverified", "absent", "absent", "unverified", "verified"]


def test_gold_numbers_of_an_answer(spark):
    df = fg.with_mentions(spark.createDataFrame([("It is $1.5 million or 7%.",)], "t string"), "t")
    asked = [1.5, 1.5e6, 7.0, 8.0, None]
    got = df.select(*(fg.states(F.lit(v).cast("double"), "mentions").alias(f"c{i}") for i, v in enumerate(asked))).first()
    assert list(got) == [True, True, True, False, True]


def test_evidence_may_be_mentions_that_answers_share(spark):
    d = spark.createDataFrame([(1, "2 pieces for $3.50; growth_pct: 7")], "id int, evidence string")
    read = fg.with_mentions(d, "evidence", "stated")
    said = read.crossJoin(spark.createDataFrame([("a", "It is $3.50."), ("b", "It is 7% and 9 now.")], "k string, answer string"))
    got = {(r.k, r.text) for r in fg.unsupported(said, "answer", "stated", "k").collect()}
    assert got == {(r.k, r.text) for r in fg.unsupported(said.drop("stated"), "answer", "evidence", "k").collect()} == {("b", "9")}


def test_answers_that_share_evidence(spark):
    rows = [(1, ["It is $3.50.", "It is 7% and 9 now.", None, "In 2024 it was 2."], "2 pieces for $3.50; growth_pct: 7"), (2, [], "5"), (3, None, "5"), (4, ["5", "-6", "6.0%"], None)]
    got = [(r.k, r.at, r.text, r.value) for r in fg.unsupported(spark.createDataFrame(rows, "k int, a array<string>, e string"), "a", "e", "k").collect()]
    assert sorted(got) == [(1, 1, "9", 9.0), (4, 0, "5", 5.0), (4, 1, "-6", -6.0), (4, 2, "6.0%", 6.0)]


def test_plain_texts_of_one_form_are_read_once(spark, monkeypatch):
    import pyarrow as pa

    from marlstone.operators import figure_columns as fc
    from marlstone.operators import mentions as mn

    rng = random.Random(3)
    words = "7 12 0.50 3.25 1.2.3 2024 1999 19.5 123456 0 $ US$ € £ USD EUR k m bn million x bps pp pts % percent per cent points people to and or in since for ; . a A5 v2 nine hundred".split()
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "; "]) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    say = lambda m: (m.percent, m.currency, m.scale, m.labelled, m.temporal)
    for t in texts:
        got = [(f.text, -f.value if f.negative else f.value, f.mantissa, f.unscaled, say(f.says)) for f in mn.figures(t)]
        assert got == [(m.text, m.value, abs(m.mantissa), m.scale == 1, say(m)) for m in mn.read(t)], t
    # a column of texts, in forms and one by one
    column = [*texts, *(f"{rng.randrange(3000)} pieces for ${rng.randrange(10**9) / 100:.2f}; or {rng.random():.6f} x; {10**rng.randrange(19)}%" for _ in range(400)), *(f"{rng.randrange(10**6)} for ${rng.randrange(10**6) / 100}" for _ in range(400)), None, ""]
    got = fc.of_texts(pa.array(column).slice(5))
    unscaled, percent, labelled, temporal, code = got.says()
    for i, t in enumerate(column[5:]):
        here = [(got.text(j), got.signed(j), got.mantissa[j], unscaled[j], (percent[j], (None, "USD", "EUR", "GBP")[code[j]], labelled[j], temporal[j])) for j in range(got.begin[i], got.begin[i + 1])]
        assert here == [(m.text, m.value, abs(m.mantissa), m.scale == 1, (m.percent, m.currency, m.labelled, m.temporal)) for m in mn.read(t)], t
    assert 300 < len(got.value) - len(got.odd)
    # the support of figures is that of columns
    pairs = [(i, a, e) for i, (a, e) in enumerate(zip(texts, reversed(texts), strict=True))][:600]
    monkeypatch.setattr(fc, "PAIRS", 7)
    df = spark.createDataFrame(pairs, "i int, a string, e string")
    both = fg.with_mentions(fg.with_mentions(df, "a", "x"), "e", "y")
    want = both.select("i", F.explode(F.filter("x", lambda c: ~c["temporal"] & ~F.exists("y", lambda e: fg.supports(c, e)))).alias("c")).select("i", "c.text", "c.value").collect()
    assert sorted(want) == sorted(fg.unsupported(df, "a", "e", "i").collect()) and want
    claims, stated = fc.of_texts(pa.array([a for _, a, _ in pairs])), fc.of_texts(pa.array([e for *_, e in pairs]))
    assert sorted(claims.text(j) for j in fc.unbacked(claims, stated, np.arange(len(pairs)))) == sorted(r.text for r in want)
    mn.form.cache_clear()
    for i in range(500):
        mn.figures(f"{i} pieces for ${i * 7}.25; {i + 3} pieces for $0.50")
    assert mn.form.cache_info().misses == 1
