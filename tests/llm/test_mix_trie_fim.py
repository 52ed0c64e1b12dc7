"""Pareto mixing, the prefix trie and fill-in-middle against plain Python, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, size long, place string, target int"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, 7, "x", 0) for i, s, t in rows], DOCS)


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Target of each source by resharing the excess again and again, then theta by bisection and the sample by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (_, x, _) in zip(size, rows) if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:
        free = share * sum(total.values()) - sum(target[s] for s in names if s not in open_)
        for s in open_:
            target[s] = free * weight[s] / sum(weight[x] for x in open_)
        full = {s for s in open_ if target[s] > most * total[s]}
        if not full:
            break
        for s in full:
            target[s] = float(most * total[s])
        open_ -= full
    out = []
    for s in names:
        own = [(i, n) for (i, x, _), n in zip(rows, size) if x == s]
        low, high = 0.0, 1e9
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(most, mid * n**0.5) for _, n in own if n) < target[s] else (low, mid)
        copies = [min(most, high * n**0.5) if n else 0 for _, n in own]
        copies = [round(c) if abs(c - round(c)) < 1e-9 else c for c in copies]
        left = target[s] - sum(floor(c) * n for c, (_, n) in zip(copies, own))
        ranked = []
        for k, (c, (i, n)) in enumerate(zip(copies, own)):
            p = c - floor(c)
            if p:
                u = (int(hashlib.sha256(f"11:{'' if i is None else i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (p / (1 - p)), n, -1 if i is None else i, k))
        got, rest, full = 0, [], set()
        for _, n, _, k in sorted(ranked):
            got += n
            if got <= left:
                full.add(k)
            else:
                rest.append((n, k))
        gap = left - sum(own[k][1] for k in full)
        best = min(rest, key=lambda x: abs(x[0] - gap), default=None)
        if best and abs(best[0] - gap) < gap:
            full.add(best[1])
        out += [(i, n, total[s], round(target[s], 6), (floor(c) + (k in full)) * n) for k, (c, (i, n)) in enumerate(zip(copies, own))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    from marlstone.llm.mixing import mix_sources

    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "b", "b", "é", "", None, "Z"]), " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 5, 9, 40, 300])))) for i in range(120)]
    rows += [(200, "a", None), (201, "b", ""), (202, "b", " \t\x0b\n"), (203, "only empty", None), (204, "big", "long word " * 4000), (5, "b", "a b c"), (5, "b", "a b c"), (None, "b", "x y"), (None, None, "x y z"), (None, None, "x y z")]
    df = documents(spark, rows)
    got = mix_sources(df).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(plain_mix(rows), key=key)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=repr)
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_mix_follows_the_odds(spark):
    """Over many seeds a document is drawn as often as its copies expect, so odds decide and not sizes alone."""
    from marlstone.llm.mixing import mix_sources

    rows = [(i, "s", "w " * (1 + i % 4 * 5)) for i in range(60)] + [(100 + i, "t", "w " * 30) for i in range(60)]
    df = documents(spark, rows).cache()
    mean = defaultdict(list)
    for seed in range(12):
        got = mix_sources(df, seed=seed, weights=(1, 2), share=0.6).collect()
        words = defaultdict(int)
        for r in got:
            words[r.source] += r.taken
            mean[r.source, r["size"]].append(r.copies)
            goal = r.target
            assert r.source == "t" or goal
        for s in "st":
            assert abs(words[s] - next(r.target for r in got if r.source == s)) <= 15
    by = {k: np.mean(v) for k, v in mean.items()}
    assert by["s", 1] < by["s", 6] < by["s", 11] < by["s", 16]
    assert by["s", 16] / by["s", 1] == pytest.approx(4, rel=0.35)


def test_mix_of_nothing(spark):
    from marlstone.llm.mixing import mix_sources

    assert mix_sources(documents(spark, [])).count() == 0
    got = mix_sources(documents(spark, [(1, "a", None), (2, None, "")])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_targets_with_many_sources_and_salts(spark, monkeypatch):
    from marlstone.llm import mixing

    rows = [(i, f"s{i % 37}", "w " * (i % 11 + 1)) for i in range(300)]
    want = sorted(map(tuple, mixing.mix_sources(documents(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    assert sorted(map(tuple, mixing.mix_sources(documents(spark, rows)).collect())) == want


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, k1 int, path string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p") for r in rows], CONVERSATIONS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed):
    from marlstone.llm.prefix_trie import prefix_trie

    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(0, 420), 45), 0, 100, 200, -100, -105, -203, 2**40, 2**40 + 1]:
        for t in range(rng.choice([0, 1, 2, 3, 6, 9, 14])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é🙂", "b\nb", "", None])))
    rows += rng.sample(rows, 12)  # repeated rows and ties
    rows += [(300, 1, "user", "long " * 20_000), (None, 0, "user", "nobody's")]
    got = prefix_trie(talk(spark, rows).repartition(5))
    assert ordered(got.collect()) == ordered(plain_trie(rows))


def test_trie_of_growing_copies(spark):
    """Conversations that grow from each other, and one long one: few rounds of messages, the same result."""
    from marlstone.llm.prefix_trie import prefix_trie

    rows = [(c, t, "user", f"t{t}") for c in range(6, 30) for t in range(c)]
    rows += [(700, t, "user", f"t{t % 7}") for t in range(150)]
    assert ordered(prefix_trie(talk(spark, rows)).collect()) == ordered(plain_trie(rows))


def test_trie_of_nothing(spark):
    from marlstone.llm.prefix_trie import prefix_trie

    assert prefix_trie(talk(spark, [])).count() == 0
    assert prefix_trie(talk(spark, [(None, 1, "user", "x")])).count() == 0
    # 1 takes over turns of an absent conversation and loses its own: it has no turns
    assert zlib.crc32(b"1") % 6 > 0
    assert ordered(prefix_trie(talk(spark, [(1, 0, "user", "x")])).collect()) == ordered(plain_trie([(1, 0, "user", "x")]))


def test_peeling_needs_few_rounds(spark):
    """A chain of paths peels from the end; each round finishes all that wait for nothing."""
    from marlstone.llm.prefix_trie import peeled

    rows = [(0, None, 2, 1, 5), (1, 0, 1, 0, 7), (2, 0, 0, 1, 11), (3, 1, 0, 1, 13)]
    paths = spark.createDataFrame(rows, "path long, up_path long, waiting long, leaves long, saved long")
    assert sorted((r.path, r.leaves, r.saved) for r in peeled(paths).collect()) == [(0, 3, 36), (1, 1, 20), (2, 1, 11), (3, 1, 13)]


def test_ends_of_many_conversations(spark):
    from marlstone.llm.prefix_trie import ends_digest

    ids = [-5, -70_000, *range(0, 200_000, 3), 2**50]
    got = ends_digest(spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9)], "depth long, k1 long, k2 long, conv_id long")).collect()
    want = {3: ",".join(map(str, sorted(ids))), 4: "9"}
    assert {r.k2: r.ends_sha256 for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_running_totals_of_split_groups(spark):
    from marlstone.llm.running import running

    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randrange(-(2**62), 2**62)) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, z long").repartition(6)
    total, mixed = defaultdict(int), defaultdict(int)
    want = {}
    for g, i, z in sorted(rows):
        total[g] += i
        mixed[g] ^= z
        want[g, i] = (total[g], mixed[g])
    got = running(df, "g", [F.col("i")], {"s": F.col("i")}, {"x": F.col("z")}).collect()
    assert {(r.g, r.i): (r.s, r.x) for r in got} == want


def test_bits():
    from marlstone.llm.fill_middle import Bits

    rng = np.random.default_rng(1)
    for size, share in [(1, 1.0), (64, 0.5), (511, 0.02), (512, 0.9), (5000, 0.3), (20_000, 0.001), (700, 0.0)]:
        bits = rng.random(size) < share
        packed, ones = Bits(bits), np.flatnonzero(bits)
        at = np.arange(size + 1)
        assert (packed.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        if len(ones):
            assert (packed.select(np.arange(1, len(ones) + 1)) == ones).all()


def plain_fim(i, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    spm = h[3] % 100 < spm_rate
    return i, n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate", [100, 60])
def test_fill_in_middle(spark, rate):
    from marlstone.llm.fill_middle import fill_in_middle, restored

    rng = random.Random(rate)
    rows = [(i, "s", "".join(rng.choice(["a", "é", "🙂x", "\n", "\n", "\r\n", " ", "<", "P>", "<S", " "]) for _ in range(rng.choice([0, 1, 2, 9, 60, 700])))) for i in range(250)]
    rows += [(300, "s", None), (301, "s", "\n"), (302, "s", "\n\n\n"), (303, "s", "no end"), (304, "s", "a<M>b\n"), (None, None, "x\ny"), (5, "s", "a\nb"), (5, "s", "a\nb"), (306, "s", "line é\n" * 400_000), (307, "s", "<" * 50 + "\n<P" * 9), (308, "s", ">S>\nP>\n" * 5)]
    got = fill_in_middle(documents(spark, rows), rate=rate).withColumn("text", restored(F.col("output"), F.col("form"))).collect()
    assert ordered(r[:6] for r in got) == ordered(plain_fim(i, t, rate=rate) for i, _, t in rows)
    texts = defaultdict(set)
    for i, _, t in rows:
        texts[i].add(t or "")
    assert all(r.text in texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    from marlstone.llm.fill_middle import fill_in_middle

    assert fill_in_middle(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(documents(spark, []), sentinels=("<P>", "<<S>", "<M>"))


@pytest.mark.parametrize("name", ["op11_pareto_mix", "op12_prefix_trie", "op13_fill_in_middle"])
def test_queries_against_sql(spark, name):
    from oracle import compare, connect

    from marlstone.llm.oracles import ORACLES
    from marlstone.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""
