"""Stems against published forms and SQL, the lexical lanes against plain Python, covers against every interval."""

import itertools
import math
import random

import duckdb
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from marlstone.functions import stemming as st
from marlstone.operators import lexical
from marlstone.operators import retrieval as re_

#: Words and their stems in the published description of the algorithm.
FORMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consolation consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson consort consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspire conspir conspiring conspir constable constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knag knag knave knave knavish knavish kneaded knead kneel kneel kneeled kneel knees knee knelt knelt knightly knight knitted knit knives knive knocker knocker
generally general generously generous generation generat communication communic happy happi cry cri by by say say hopping hop hoping hope luxuriated luxuri relational relat conditional condit
caresses caress ponies poni ties tie cats cat gas gas this this gaps gap kiwis kiwi skies sky dying die bias bias exceed exceed proceeding proceed national nation digitizer digit feudalism feudal
decisiveness decis hopefulness hope sensitivity sensit electrical electr hopeful hope goodness good adjustable adjust replacement replac adoption adopt effective effect rate rate cease ceas
roll roll youth youth enjoyed enjoy sayyid sayyid shed shed feed feed agreed agre disabled disabl filing file falling fall hissing hiss fizzed fizz troubling troubl sized size""".split()


def test_published_stems():
    for word, stem in zip(FORMS[::2], FORMS[1::2], strict=True):
        assert st.stem(word) == stem, word


def test_stems_equal_those_by_regular_expressions():
    rng = random.Random(6)
    ends = [*st.STEP_2, *st.STEP_3, *st.STEP_4, "sses", "ied", "ies", "us", "ss", "s", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "e", "ll", "l"]
    words = {*FORMS[::2], *st.WHOLE_WORDS, *st.KEPT_AFTER_1A, *(p + e for p in st.R1_PREFIXES for e in ends), "zürich", "naïvely", "yyy", "ayyya"}
    for _ in range(20_000):
        words.add("".join(rng.choice("abcdeghilmnoprstuwxyyaeio") for _ in range(rng.randrange(1, 7))) + "".join(rng.choice(ends) for _ in range(rng.choice([0, 1, 1, 2]))))
    con = duckdb.connect()
    con.register("words", pd.DataFrame({"w": sorted(words)}))
    for word, stem in con.execute(f"SELECT w, {st.stem_sql('w')} FROM words").fetchall():
        assert st.stem(word) == stem, word


def plain(text):
    found = {}
    for at, w in enumerate(regex.findall(lexical.TOKEN, (text or "").lower()), 1):
        if (lex := st.lexeme(w)) is not None:
            found.setdefault(lex, []).append(at)
    return found


DOCS = "id long, text string, lexeme string, bucket int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = "the growing grows market markets of price prices 2024 q3 rate rates a loyalty customers customer é zürich common".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 40])))) for i in range(150)]
    rows = [(i, f"{t} common") for i, t in rows]
    return [*rows, (200, None), (201, ""), (202, "the of a"), (203, "market price"), (204, "price of the market"), (205, "markets, prices!"), (206, "word " * 5000 + "loyalty")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], DOCS)
    return lexical.LexicalIndex.write(df, "id", "text", str(tmp_path_factory.mktemp("index") / "i"), buckets=8)


QUERIES = [(1, "Market prices"), (2, '"price of the market"'), (3, "common"), (4, "common growing"), (5, "unknownword common"), (6, "the of"), (7, None), (8, 'ＬＯＹＡＬＴＹ rates "growing market" "of the"'), (9, '"market price" "market price" "the"'), (10, "2024 q3")]


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id int, text string")


def plain_lane(corpus, text, k, bonus=2.0):
    import unicodedata

    text = unicodedata.normalize("NFKC", text or "")[:1000].lower()
    docs, n = {i: plain(t) for i, t in corpus}, len(corpus)
    df = {w: sum(w in d for d in docs.values()) for w in {w for d in docs.values() for w in d}}
    terms = [w for w in plain(text) if df.get(w, 0) / n <= 0.9] or list(plain(text))
    phrases = [plain(p) for p in dict.fromkeys(p.strip() for p in regex.findall('"([^"]{2,200})"', text)) if plain(p)]
    out = []
    for i, d in docs.items():
        if not any(w in d for w in terms):
            continue
        score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in terms if w in d)
        for p in phrases:
            starts = [{at - place for at in d.get(w, [])} for w, places in p.items() for place in places]
            score += bonus * bool(set.intersection(*starts))
        tie = 0.1 * sum(len(d[w]) for w in terms if w in d) / math.log(sum(map(len, d.values())) + 1)
        out.append((-round(score, 9), -round(tie, 9), i))
    return [(i, -s, -t) for s, t, i in sorted(out)[:k]]


def test_lexical_lane(spark, corpus, index):
    got = {}
    for r in lexical.lexical_lane(queries(spark), index, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score, abs=2e-9), pytest.approx(r.tiebreak, abs=2e-9)))
    for q, text in QUERIES:
        assert got.get(q, []) == plain_lane(corpus, text, 7), text
    assert 6 not in got and 7 not in got


def test_frequent_lexemes_go_unless_all_would(spark, index):
    got = lexical.query_terms(lexical.normalised_queries(queries(spark)), index).groupBy("query_id").agg(F.sort_array(F.collect_list("lexeme")).alias("w")).collect()
    by = {r.query_id: r.w for r in got}
    assert by[3] == ["common"] and by[4] == ["grow"] and by[5] == ["unknownword"]


def test_only_the_buckets_of_a_query_are_read(spark, index):
    terms = spark.createDataFrame([(1, "loyalti", 1.0)], "query_id int, lexeme string, idf double")
    plan = lexical.hits(terms, index)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:200]
    assert len(index.needed(terms)) == 1


def plain_covers(places, wanted):
    """Minimal intervals by trying every one. places: (position, lexeme, weight)."""
    at = {p: (lex, w) for p, lex, w in places}
    holds = {(b, e): {at[p][0] for p in at if b <= p <= e} for b, e in itertools.combinations_with_replacement(sorted(at), 2)}
    whole = [k for k, v in holds.items() if len(v) == wanted]
    least = [(b, e) for b, e in whole if not any((x, y) != (b, e) and b <= x and y <= e for x, y in whole)]
    return sorted((b, e, sum(b <= p <= e for p in at), round(sum(1 / at[p][1] for p in at if b <= p <= e), 6)) for b, e in least)


def test_covers_equal_those_of_every_interval(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for q in range(60):
        m = rng.choice([1, 2, 3, 4])
        places = [(p, f"w{rng.randrange(m)}", rng.choice([0.1, 0.2, 0.3])) for p in sorted(rng.sample(range(40), rng.randrange(1, 14)))]
        m = len({x[1] for x in places}) if q % 3 else m
        rows += [(q, m, lex, p, w) for p, lex, w in places]
        want[q] = plain_covers(places, m)
    df = spark.createDataFrame(rows, "q int, wanted int, lexeme string, position int, weight double")
    found = lexical.covers(df, ["q"], "wanted").cache()
    got = {q: [] for q in want}
    for r in found.collect():
        got[r.q].append((r.begin, r.end, r.entries, round(r.inverse, 6)))
    assert {q: sorted(v) for q, v in got.items()} == want
    density = {r.q: r.density for r in lexical.cover_density(found, ["q"]).collect()}
    for q, intervals in want.items():
        plain_sum = sum(n / inv / (1 + (e - b - (n - 1))) for b, e, n, inv in intervals)
        assert density.get(q, 0) == pytest.approx(plain_sum, rel=1e-6)


def test_all_lexemes_lane(spark, corpus, index):
    got = {}
    for r in lexical.all_lexemes_lane(queries(spark), index, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, text in QUERIES:
        lex = plain((text or "").lower().replace("ｌｏｙａｌｔｙ", "loyalty").replace("ＬＯＹＡＬＴＹ", "loyalty"))
        out = []
        for i, t in corpus:
            d = plain(t)
            if lex and all(w in d for w in lex):
                places = [(p, w, 0.1) for w in lex for p in d[w]]
                if len(places) > 60:
                    continue
                s = sum(n / inv / (1 + (e - b - (n - 1))) for b, e, n, inv in plain_covers(places, len(lex)))
                out.append((-round(s / math.log(sum(map(len, d.values())) + 1), 9), i))
        assert got.get(q, []) == [i for _, i in sorted(out)[:5]], text


def test_index_of_nothing(spark, tmp_path):
    empty = lexical.LexicalIndex.write(spark.createDataFrame([], DOCS), "id", "text", str(tmp_path / "e"))
    assert lexical.lexical_lane(queries(spark), empty, 3).count() == 0


def plain_floor(rows, wanted, top):
    """Moves one by one: the last spare place goes to the best of each absent class."""
    rows = sorted(rows, key=lambda r: r[1])
    first, rest, new = rows[:top], rows[top:], []
    for name in dict.fromkeys(wanted):
        held = [r for r in first if r[2] == name]
        best = [r for r in rest if r[2] == name]
        spare = [r for r in first if r[2] not in wanted or r != min((x for x in first if x[2] == r[2]), key=lambda x: x[1])]
        if not held and best and spare:
            new.append(best[0])
            rest = sorted([r for r in rest if r != best[0]] + [spare[-1]], key=lambda r: r[1])
            first.remove(spare[-1])
    return [(r[0], i + 1, r in new) for i, r in enumerate(first + new + rest)]


def test_class_floor(spark):
    rng = random.Random(31)
    for _ in range(4):
        rows = [(q, 100 * q + i, rank, rng.choice("abcd")) for q in range(8) for i, rank in enumerate(rng.sample(range(40), rng.randrange(1, 14)))]
        wanted, top = rng.sample("abcde", 3), rng.choice([1, 3, 5])
        df = spark.createDataFrame(rows, "query_id int, id int, r int, class string")
        got = sorted((r.query_id, r.id, r.floor_rank, r.promoted) for r in re_.class_floor(df, "id", "class", "r", wanted, top).collect())
        want = sorted((q, *x) for q in range(8) for x in plain_floor([r[1:] for r in rows if r[0] == q], wanted, top))
        assert got == want


def test_dense_lane_in_blocks(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(80)], "id int, v array<double>")
    q = vectors.where("id < 30").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    one = sorted(map(tuple, re_.dense_lane(q, vectors, "id", "v", 3).collect()))
    assert sorted(map(tuple, re_.dense_lane(q, vectors, "id", "v", 3, most_queries=7).collect())) == one


def test_a_search_deals_no_postings(spark, corpus, tmp_path):
    """Frequencies and lanes come from the stored texts: no posting is written or shuffled for them."""
    index = lexical.LexicalIndex.write(spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], DOCS), "id", "text", str(tmp_path / "i"), buckets=8)
    lane = lexical.lexical_lane(queries(spark), index, 7)
    assert lane.count() and lexical.all_lexemes_lane(queries(spark), index, 7).count() and index.frequencies().count()
    assert {p.name for p in (tmp_path / "i").iterdir()} == {"texts", "lexemes", "size"}
    assert lane._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1 and "hashpartitioning(query_id" in lane._jdf.queryExecution().executedPlan().toString()


def test_slices_of_a_batch(monkeypatch):
    """What a worker holds at once does not change frequencies, places or counts."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [[rng.choice(["a", "b", "c", None]) for _ in range(rng.choice([0, 1, 4, 30]))] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([1] * 40), pa.array(texts, pa.list_(pa.string()))], ["id", "n_places", "lexemes"])
    block = lexical._Block([1], pa.array(["c", "a", "zz"]), None, [])
    seen = []
    for most in (10**6, 7):
        monkeypatch.setattr(lexical, "MOST_PLACES", most)
        df, places = {}, []
        for part in lexical._frequencies(iter([batch.select([2])])):
            for lex, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                df[lex] = df.get(lex, 0) + n
        for part, text, place, number, counts in block.read(iter([batch])):
            ids = part.column(0).to_pylist()
            places += [(ids[t], p, "ca"[n]) for t, p, n in zip(text, place, number, strict=True)]
            assert counts.sum() == len(text)
        seen.append((df, sorted(places)))
    assert seen[0] == seen[1]
    assert seen[0][0] == {w: n for w in "abc" if (n := sum(w in t for t in texts))}
    assert seen[0][1] == sorted((i, at, w) for i, t in enumerate(texts) for at, w in enumerate(t, 1) if w in ("a", "c"))


def test_stored_texts_are_strings(spark, corpus, tmp_path, monkeypatch):
    """One string a text goes between rows and columns; places, stop words and odd texts are those of the lists, whatever a worker remembers."""
    import pyarrow as pa

    texts = ["", None, "the", "the the market", "market the", " , ", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = lexical.sequences(df, "id", "text").orderBy("id").collect()
    assert [r["lexemes"] for r in rows] == ["", "", "", "  market", "market ", "", "x"] and [r["n_places"] for r in rows] == [0, 0, 0, 1, 1, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([r["lexemes"] for r in rows])], ["lexemes"])
    for most in (10**6, 5):
        monkeypatch.setattr(lexical, "MOST_CHARS", most)
        got = [x for part in lexical._listed(iter([batch, batch.slice(3, 2)])) for x in part.column(0).to_pylist()]
        assert got == [[None], [None], [None], [None, None, "market"], ["market", None], [None], ["x"], [None, None, "market"], ["market", None]]
