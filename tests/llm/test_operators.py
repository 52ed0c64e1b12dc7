"""The ten operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import gzip
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(14):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                j = rng.randrange(len(w))
                w[j] = f"zz{rng.randrange(999)}"
            rows.append((i, " ".join(w) if rng.random() < 0.9 else "\t ".join(w).upper()))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \t"), (i + 2, " \t"), (i + 3, "é日🙂 " * 40), (i + 4, "long " * 3000 + "tail"), (i + 5, "x y z"), (i + 6, "x y z")]


def test_warc(spark, tmp_path):
    from marlstone.llm.warc import archived_pages, chunked, dechunked, read_records, reassemble, write_archives

    pages = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, "http://a/ 3\n", "short"), (4, None, "short"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" + "é" * 60000), (6, "u", "WARC/1.1\r\n\r\n" + "é" * 60000), (None, None, "")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    write_archives(df, str(tmp_path / "w"))
    found = read_records(spark, str(tmp_path / "w")).cache()
    assert found.where("kind = 'continuation'").count() > 0
    got = sorted((tuple(r) for r in archived_pages(reassemble(found)).collect()), key=repr)
    want = []
    for i, _, html in pages:
        p = (html or "").encode()
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None, "whole"))
    assert got == sorted(want, key=repr)
    states = {r["state"] for r in reassemble(found.where("segment IS NULL OR segment <> 2")).where("record_id IS NOT NULL").collect()}
    assert "segments missing" in states
    assert {r["state"] for r in reassemble(found.where("segment > 1")).collect()} == {"no first segment"}
    for n in (0, 1, 8191, 8192, 20000):
        assert dechunked(chunked(b"q" * n)) == b"q" * n
    with pytest.raises(ValueError):
        dechunked(b"5\r\nab\r\n")
    write_archives(df.limit(0), str(tmp_path / "none"))
    assert archived_pages(reassemble(read_records(spark, str(tmp_path / "none")))).count() == 0


def test_warc_large_files(spark, tmp_path):
    """Archives larger than a row may be: files of several members, and payloads with separators of records in them."""
    from marlstone.llm.warc import archived_pages, parse, read_records, reassemble, write_archives

    odd = ["\r\n\r\n", "\r\n\r\r\n\r\n\n", "\r\n" * 9 + "\r", "a\r\n\r", "WARC/1.1\r\n\r\n", "\r\n\r\n" * 20000]
    pages = [(i, f"u/{i}", odd[i % len(odd)] + random.Random(i).randbytes(700).hex()) for i in range(60)]
    write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.txt.gz")
    both = tmp_path / "both"
    both.mkdir()
    (both / "a.txt.gz").write_bytes(file.read_bytes() * 2)
    (both / "b.txt").write_bytes(gzip.decompress(file.read_bytes())[:-4])
    want = sorted((i, len(h), hashlib.sha1(h.encode()).hexdigest(), "whole") for i, _, h in pages)

    def read(path):
        return sorted(tuple(r) for r in archived_pages(reassemble(read_records(spark, str(path)))).select("page_id", "payload_bytes", "payload_digest", "state").collect())

    assert read(both) == sorted(want * 3)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", file.stat().st_size - 1)
    try:
        assert read(tmp_path / "w") == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    data = gzip.decompress(file.read_bytes())
    whole = list(parse([data]))
    assert list(parse(data[i : i + 7] for i in range(0, len(data), 7))) == whole and len(whole) >= 60
    for cut in (data[:-9], data[:40]):
        with pytest.raises(ValueError):
            list(parse([cut]))


def test_packing(spark, odd, tmp_path):
    from marlstone.llm.packing import best_fit_decreasing, matrix, pack

    rows = [*odd, (None, "nobody")]
    got = pack(table(spark, rows), length=256).collect()
    parts: dict = {}
    for r in got:
        ids, positions = matrix([bytes(r["ids"])], 256)[0], matrix([bytes(r["positions"])], 256)[0]
        assert r["cu_seqlens"][-1] == r["n_tokens"] <= 256
        for k, key in enumerate(r["doc_ids"]):
            a, b = r["cu_seqlens"][k : k + 2]
            assert (positions[a:b] == np.arange(b - a)).all()
            parts.setdefault(key, []).append((r["doc_offsets"][k], ids[a:b].tolist()))
    texts = {i: t for i, t in rows}
    assert sum(p[0] == 0 for x in parts.values() for p in x) == len(rows)
    for key, text in texts.items():
        seen = {o: x for o, x in parts[key]}
        assert sum((seen[o] for o in sorted(seen)), []) == [*(text or "").encode(), 256]
    sizes = np.array([random.Random(1).randrange(1, 65) for _ in range(500)])
    place = best_fit_decreasing(sizes, 64)
    loads = np.bincount(place, weights=sizes)
    assert loads.max() <= 64
    # the same by a plain search
    room, want = [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        fit = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if not fit:
            room.append(64)
            fit = [(64, len(room) - 1)]
        least = min(r for r, _ in fit)
        want[i] = next(k for r, k in fit if r == least)
        room[want[i]] -= sizes[i]
    assert len(loads) == len(room)
    assert pack(table(spark, []), length=256).count() == 0
    # ids of a tokenizer, written and read: every document can be decoded from the matrices
    tokenizers = pytest.importorskip("public_tokenizers")
    from marlstone.llm.packing import _encoding, read_matrices, token_ids, write_matrices

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = _encoding(path, tokenizers.PATTERN)
    end = own.n_vocab
    write_matrices(pack(table(spark, rows), length=64, end_id=end, pad_id=end + 1, ids=token_ids(path, tokenizers.PATTERN)), str(tmp_path / "m"))
    parts = {}
    for r in read_matrices(spark, str(tmp_path / "m")).collect():
        for k, key in enumerate(r["doc_ids"]):
            parts.setdefault(key, {})[r["doc_offsets"][k]] = matrix([bytes(r["ids"])], 64)[0][r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    for key, text in texts.items():
        whole = sum((parts[key][o] for o in sorted(parts[key])), [])
        assert whole[-1] == end and own.decode(whole[:-1]) == (text or "")


def test_quality(spark):
    from marlstone.llm.quality import STATISTICS, score, statistics, train

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = table(spark, [(900_001, None), (900_002, ""), (None, "text without an id")]).select("doc_id", "text")
    trees = train(docs, labels)
    got = {r["doc_id"]: r for r in score(docs.select("doc_id", "text").union(extra), trees).collect()}
    assert len(got) == docs.count() + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and not got[None]["held_out"]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) >= 0.95
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    assert np.isfinite(statistics(np.zeros(0, np.uint8), np.zeros(3, np.int64))).all()
    assert statistics(np.frombuffer(b"a\n\nb", np.uint8), np.array([0, 0, 4, 4])).shape == (3, len(STATISTICS))


def test_bpe(spark, odd):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from marlstone.llm.bpe import StreamDecoder, decode, encode, load_ranks, tokenizer

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    docs = table(spark, [*odd, (None, "no id")]).unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet"), allowMissingColumns=True)
    want = {(r["doc_id"], r["text"]): own.encode_ordinary(r["text"] or "") for r in docs.collect()}
    tokens = encode(docs, path, tokenizers.PATTERN)
    got = decode(tokens, path, tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(((r["doc_id"], want[r["doc_id"], r["text"]], r["text"] or "") for r in docs.collect()), key=repr)
    rng, t = random.Random(1), tokenizer(path, tokenizers.PATTERN)
    for _ in range(500):
        x = "".join(rng.choice(["a", "é", "日", "\n", " ", "  ", "x1", "🙂", "the", "́", "\x00", "\r\n", "'s"]) for _ in range(rng.randint(0, 40)))
        ids = t.encode(x)
        assert ids == own.encode_ordinary(x)
        s = t.decoder()
        parts = [s.feed([i]) for i in ids]
        assert b"".join(parts).decode() == x and all(p.decode() is not None for p in parts)
    # emitted at certain boundaries: the same for any distance of looks, in a window that does not grow with the pre-token
    transducer = t.known.transducer
    for x in ["x" * 40_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(40_000)), "日本" * 9000, "ab" * 30_000 + "c"]:
        want = own.encode_ordinary(x)
        assert t.encode(x) == want
        for look in (1, 7, 64):
            runs = list(transducer.stream(x[:3000].encode(), look))
            assert [i for r in runs for i in r] == own.encode_ordinary(x[:3000]) and len(runs) > 10 and max(map(len, runs)) < 300
    transducer.size = 1 << 40  # full memories are emptied amid a pre-token
    assert [i for r in transducer.stream(b"qwertyuiopasdfg" * 400, 64) for i in r] == own.encode_ordinary("qwertyuiopasdfg" * 400) and transducer.size < 1 << 30
    assert decode(encode(docs.limit(0), path, tokenizers.PATTERN), path, tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        StreamDecoder([b"\xff"]).feed([0])
    cut = StreamDecoder([b"\xc3"])
    cut.feed([0])
    with pytest.raises(ValueError):
        cut.finish()


def test_bpe_in_one_worker(spark, odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    from marlstone.llm import bpe

    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    docs = table(spark, [*odd, (None, "no id")]).unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet"), allowMissingColumns=True)
    for digests in (False, True):
        got = bpe.encode_decode(docs, path, pattern, digests=digests)
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted(got.collect(), key=repr) == sorted(bpe.decode(bpe.encode(docs, path, pattern), path, pattern, digests=digests).collect(), key=repr)
    # the transducer's memories stay near their estimate
    t = bpe.Transducer(bpe.load_ranks(path))
    text = " ".join(r["text"] or "" for r in docs.where("doc_id < 150").collect()).split()
    tracemalloc.start()
    for word in set(text):
        t.encode(word.encode())
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert t._step and len(t._beside) <= bpe.MOST_PAIRS and held <= 1.2 * t.size + (1 << 20)


def test_quotes(spark):
    from marlstone.llm.quotes import link_quotes

    rows = [
        (1, 0, "u", "Hello there friend\nsecond line here"), (1, 1, "a", "> Hello there friend\n> second line here\nI agree with you"),
        (1, 2, "u", "On Monday X wrote:\n> I agree with you\n>> hello   there FRIEND\nFine then"), (2, 0, "u", "> Fine then\nother"), (2, 1, "u", None), (None, None, "x", "> Fine then"), (3, 5, "u", "alone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(df).collect()}
    assert got[1, 1]["text"] == "I agree with you" and got[1, 2]["text"] == "Fine then" and got[2, 1]["text"] is None
    link = {k: (r["n_linked"], r["reply_conv"], r["reply_turn"], r["reply_by"], r["thread_id"]) for k, r in got.items()}
    assert link == {
        (1, 0): (0, None, None, None, 1), (1, 1): (1, 1, 0, "quote", 1), (1, 2): (2, 1, 1, "quote", 1), (2, 0): (1, 1, 2, "quote", 1),
        (2, 1): (0, 2, 0, "turn", 1), (None, None): (0, None, None, None, None), (3, 5): (0, None, None, None, 3),
    }
    assert link_quotes(df.limit(0)).count() == 0
    # against brute force: quotes of own later turns, of later conversations, and circles
    from marlstone.llm.quotes import _prints, fingerprint, passages

    rng = random.Random(8)
    said = [f"line {k} says {rng.random()}" for k in range(12)]
    rows = {(1, 0): f"> {said[0]}\nx1", (1, 3): said[0], (5, 0): said[0], (7, 0): f"> {said[1]}\n{said[2]}", (9, 0): f"{said[1]}\n> {said[2]}", (8, 0): "word " * 60_000}
    for c in range(20, 50):
        for t in range(rng.randrange(1, 5)):
            rows[c, t] = "\n".join(rng.choice(["> ", ">> ", "", ""]) + rng.choice(said) for _ in range(rng.randrange(1, 4)))
    df = spark.createDataFrame([(c, t, "u", x, "clash", 1) for (c, t), x in rows.items()], "conv_id long, turn long, role string, text string, id string, position int")
    holds = {}
    for k, x in rows.items():
        clean, _ = passages(x)
        for p in {p for p, _ in _prints([y for y in clean.split("\n") if y.strip()])} | {p for part in re.split(r"\n\s*\n", clean) if (p := fingerprint([part]))}:
            holds.setdefault(p, set()).add(k)
    want = {}
    for k, x in rows.items():
        links = []
        for level, lines in passages(x)[1]:
            found = []
            for p, n in _prints(lines):
                at = holds.get(p, set())
                own, other = sorted(y for y in at if y[0] == k[0] and y < k), sorted(y for y in at if y[0] != k[0])
                if own or other:
                    found.append((-n, *(own or other)[0]))
            if found:
                n, *to = min(found)
                links.append((level, n, tuple(to)))
        want[k] = (len(links), min(links)[2] if links else ((k[0], k[1] - 1) if (k[0], k[1] - 1) in rows else None))
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(df).collect()}
    assert {k: r["n_linked"] for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
    assert got[1, 0]["reply_conv"] == 5 and len(got[8, 0]["text"]) == 300_000
    cuts = {k for k, r in got.items() if r["reply_by"] == "cut"}
    assert cuts and {k: (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if k not in cuts} == {k: to or (None, None) for k, (_, to) in want.items() if k not in cuts}
    for k in cuts:  # a cut message is the smallest of a circle
        circle, at = [], k
        while not circle or at != k:
            circle.append(at)
            at = want[at][1]
        assert k == min(circle)
    for k, r in got.items():
        to = None if k in cuts else want[k][1]
        assert r["reply_position"] == (got[to]["reply_position"] + 1 if to else 0) and (not to or got[to]["thread_id"] == r["thread_id"])


def test_html(spark):
    from marlstone.llm.html_text import extract, main_text

    page = "<html><body><nav><a>home</a></nav><div class='x1'>Buy now</div><article><h1>T &lt;{0}&gt;</h1><p>one {0}<br>two <b>bold</b>.<p>three &amp; {0}<div class=box>Join us</div></article><form>q</form><section class='comments'><article class=comment><p>hey {0}</p></article></section><footer>f</footer>"
    rows = [(i, "http://h.example/%d" % i, page.replace("{0}", f"w{i}")) for i in range(12)] + [(12, "http://one.example/", page), (13, None, None), (14, "http://h.example/", ""), (15, "x", "<p>a < b\n and c</p><script>var x='</p>';</script>z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, low int")
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert got[3]["text"] == "T <w3>\n\none w3 two bold.\n\nthree & w3"  # the box that all pages of the host share is gone
    assert got[12]["text"].endswith("Join us")  # one page tells nothing
    assert got[13]["text"] == "" and got[14]["n_chars"] == 0 and got[15]["text"] == "a < b and c\n\nz"
    assert extract(df.limit(0)).count() == 0
    assert main_text("<div id='cookieNotice'>c</div><p>plain", set()) == "plain"
    # nesting of any depth, math and object, several articles, class names whose other words say something
    deep = "<div id=page><article><p>begin" + "<div>" * 3000 + "<nav>MENU</nav><p>deep" + "</div>" * 3000 + "<p>after</article></div>"
    assert main_text(deep, set()) == "begin\n\ndeep\n\nafter"
    assert main_text("<article><p>so <math><mi>x</mi>=<mn>2</mn></math> and <object>o</object></article>", set()) == "so x=2 and o"
    assert main_text("<main><article><p>one</article><article><p>two two</article></main><p>out", set()) == "one\n\ntwo two"
    assert main_text("<div class='sharing-economy'><p>kept</div><div class='share-buttons'>x</div><div class='ad slot'>y</div>", set()) == "kept"
    # a host of copies of one article: they are one article, which tells nothing; with other articles the shared box goes
    copies = [(i, f"http://c.example/{i}", "<article><h1>Same</h1><ul><li>first<li>second</ul></article>", 1) for i in range(30)]
    got = {r["text"] for r in extract(spark.createDataFrame(copies, "page_id long, url string, html string, low int")).collect()}
    assert got == {"Same\n\nfirst\n\nsecond"}
    long_ = spark.createDataFrame([(1, "u", "<p>" + "word " * 200_000 + "</p>" + "<p>x" * 20_000)], "page_id long, url string, html string")
    assert extract(long_).first()["n_chars"] == 5 * 200_000 - 1 + 3 * 20_000


def plain_repeats(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a table of all strings of this length."""
    first: dict = {}
    key = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, key(i)), key(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        lost = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < key(i):
                lost[j : j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~lost])
        spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()) if len(b) else 0
        want.append((i, len(b), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=repr)


def test_repeats(spark, odd):
    from marlstone.llm import repeats

    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef ghij") for _ in range(90))
    rows = [*odd, (1000, shared), (1001, "x" + shared[10:80] + "y"), (1002, "y" * 30 + shared[:60] + "z" * 60 + shared[30:]), (1003, "z" * 200), (1003, "z" * 200), (1004, "z" * 51), (None, shared), (None, shared)]
    docs = table(spark, rows).repartition(3)
    assert sorted((tuple(r) for r in repeats.remove_repeats(docs).drop("kept").collect()), key=repr) == plain_repeats(rows, 50)
    # many short repeats, periods and common triggers, in blocks and chunks of a few entries
    rows = []
    for i in range(160):
        parts = [rng.choice([shared[a : a + 17], "".join(rng.choice("ab") for _ in range(20)), "ab" * rng.randrange(30), "é" * 9, "x" * 40, str(rng.random())]) for a in [rng.randrange(60)] * 4]
        rows.append((i % 140, "".join(rng.sample(parts, 3))))
    docs2 = table(spark, rows).repartition(3)
    for common, block, entries in ((repeats.COMMON, 2000, 50), (3, 700, 7)):
        got = repeats.remove_repeats(docs2, length=12, triggers=(4, 8), common=common, block=block, sample=1, entries=entries).drop("kept").collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_repeats(rows, 12)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_exact(spark, odd):
    from marlstone.llm.exact_dedup import drop_exact_copies, exact_dedup, misra_gries

    rows = [*odd, *[(2000 + i, "hot  text") for i in range(60)], (None, "hot\ttext"), (None, "only null")]
    docs = table(spark, rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for counters in (1000, 4):
        assert sorted((tuple(r) for r in exact_dedup(docs, counters=counters).collect()), key=repr) == sorted(want, key=repr)
    assert drop_exact_copies(docs).columns == docs.columns
    twice = table(spark, [(1, "A"), (5, "A"), (5, "B"), (None, "B"), (None, "C"), (7, None), (8, "")])
    assert sorted(((r["doc_id"], r["text"]) for r in drop_exact_copies(twice).collect()), key=repr) == sorted([(1, "A"), (5, "B"), (None, "C"), (7, None)], key=repr)
    assert drop_exact_copies(twice.limit(0)).count() == 0
    assert exact_dedup(docs.limit(0)).count() == 0
    assert misra_gries(iter("abacadaa"), 1) == {"a": 2}


def test_leaks(spark):
    from marlstone.llm.decontaminate import common_subsequence, drop_leaks, find_leaks

    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    extra = [(900_000, None), (900_001, ""), (None, "before " + items[3] + " after")]
    all_ = docs.select("doc_id", "text").union(table(spark, extra).select("doc_id", "text"))
    odd_bench = bench.union(spark.createDataFrame([(None, "nothing"), (9_999, None), (9_998, " ")], "item_id long, text string"))
    truth = {(r["doc_id"], i) for r in all_.collect() for i, t in items.items() if t in (r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(all_, odd_bench).collect()}
    assert truth <= set(got) and (None, 3) in got
    assert all(got[k]["lcs_share"] >= 0.8 for k in set(got) - truth)  # truncated items
    words = items[5].split()
    loose = " ".join(w for i, w in enumerate(words) if i % 9)
    assert {r["item_id"] for r in find_leaks(table(spark, [(1, f"we begin {loose} we end")]).select("doc_id", "text"), bench).collect()} == {5}
    assert drop_leaks(docs, bench).columns == docs.columns
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs.limit(5), bench.limit(0)).count() == 0
    for _ in range(50):
        a, b = ([random.randrange(4) for _ in range(random.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(a, b) == t[-1][-1]


def test_leaks_full_block(spark):
    """A full block has more items than the basis has vectors; paraphrases are found all the same."""
    from marlstone.llm.decontaminate import BLOCK, find_leaks

    rnd = random.Random(5)
    items = [[f"w{rnd.randrange(250)}" for _ in range(25)] + ["."] + [f"w{rnd.randrange(250)}" for _ in range(4)] + ["."] for _ in range(BLOCK)]
    kept = [[w if k % 13 < 7 or k > 25 else f"other{rnd.randrange(10**6)}" for k, w in enumerate(x)] for x in items]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = [(i, " ".join([f"f{rnd.randrange(10**6)}" for _ in range(24)] + x + [f"f{rnd.randrange(10**6)}" for _ in range(24)])) for i, x in enumerate(kept)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(BLOCK)}


def test_jaccard(spark, odd):
    from marlstone.llm.jaccard_join import drop_near_copies, jaccard_classes

    rows = [*odd, (None, "x y z")]
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    docs = table(spark, rows)
    for options in ({}, {"stars": 0}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(docs, **options).collect()}
        assert {i: got[i] for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
        assert got[None] == (1, find(ids[-1]))
    assert drop_near_copies(docs).columns == docs.columns
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_jaccard_groups(spark):
    """Sets of one prefix and size: copies of a text with one word changed, against all pairs by brute force."""
    import random

    from marlstone.llm.jaccard_join import jaccard_classes

    rnd = random.Random(5)
    rows = []
    for start in range(2):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
        for i in range(40):
            copy = list(words)
            for at in rnd.sample(range(90), 1 if i < 20 else 3):
                copy[at] = f"c{rnd.randrange(10**6)}"
            rows.append((start * 40 + i, " ".join(copy)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(86)} for i, t in rows}
    least = {i: i for i in sets}
    links = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for _ in sets:
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert len(set(least.values())) > 2
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(table(spark, rows)).collect()}
    assert got == least


def test_pipeline(spark):
    import corpus_pipeline
    from marlstone.llm.decontaminate import find_leaks
    from marlstone.llm.exact_dedup import exact_dedup
    from marlstone.llm.jaccard_join import jaccard_classes
    from marlstone.llm.quality import score, train

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = score(docs, train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).where("predicted = 1").select("doc_id")
    a = docs.join(good, "doc_id").select(docs.columns)
    b = a.join(exact_dedup(a).where("kept").select("doc_id"), "doc_id").select(docs.columns)
    c = b.join(jaccard_classes(b).where("doc_id = component_id").select("doc_id"), "doc_id").select(docs.columns)
    d = c.join(find_leaks(c, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).select("doc_id"), "doc_id", "left_anti")
    out = corpus_pipeline.run(spark, FOLDER)
    want = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in d.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "benchmark_leaks", "tokens"]


def test_sql(spark):
    from oracle import compare, connect

    from marlstone.llm.oracles import ORACLES
    from marlstone.llm.queries import QUERIES

    con = connect(FOLDER)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, FOLDER), con, sql) == "", name
    assert set(ORACLES) <= set(QUERIES)
    assert F is not None


def test_leak_recall(spark):
    """Candidates by latent cosine against all stretches, for paraphrases of items of 16 to 1,000 words; and the SVD."""
    from marlstone.llm import decontaminate
    from marlstone.llm.decontaminate import find_leaks, randomised_svd

    rnd = random.Random(4)
    lexicon = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 5) for k in range(3000)]
    items = [rnd.choices(lexicon, weights, k=n) for n in (16, 24, 40, 90, 200, 400, 1000) for _ in range(6)]
    texts = []
    for x in items:
        kept = [w if rnd.random() < 0.78 else rnd.choice(lexicon) for w in x]
        texts.append(" ".join(rnd.choices(lexicon, weights, k=60) + kept + rnd.choices(lexicon, weights, k=60)))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (900, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found, all_ = ({(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, cosine=c).collect()} for c in (0.35, -2.0))
    assert found <= all_ and len(found) >= 0.9 * len(all_) and len(all_) >= 20
    lists = [rnd.sample(range(40), 6) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in lists], "cells array<int>")
    vectors, values = randomised_svd(rows, np.ones(40, np.float32), 5, turns=20)
    a = decontaminate._dense([np.array(x) for x in lists], np.ones(40, np.float32)).astype(float)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(values, s[:5], rtol=0.02) and abs(np.linalg.norm(vt[0] @ vectors[:, :1]) - 1) < 0.01


def test_leaks_common_short_and_long(spark):
    """Items are found in passages that many documents share, in the midst of longer texts, and across many windows."""
    from marlstone.llm.decontaminate import find_leaks

    rnd = random.Random(9)

    def foreign(n):
        return " ".join(f"f{rnd.randrange(10**7)}" for _ in range(n))

    common, short, long_ = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("c", 15), ("s", 3), ("l", 600)))
    bench = spark.createDataFrame([(1, common), (2, short), (3, long_)], "item_id long, text string")
    texts = [foreign(40 + i % 16) + (f" {common} " if i % 3 else " ") + foreign(60) for i in range(60)]
    texts += [foreign(37) + f" {short} " + foreign(70), foreign(30) + f" {long_} " + foreign(30), foreign(9) + " s0 x s1 y s2 " + foreign(70)]
    got = find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i in range(60) if i % 3} | {(60, 2), (61, 3)}


def test_the_latent_basis_counts_every_document(spark):
    import pyarrow as pa

    from marlstone.llm import decontaminate
    from marlstone.llm.common import text_bytes, words

    texts = [f"word{i} common" for i in range(6000)]
    h = words(*text_bytes(pa.array(texts)))[0]
    cells, held = np.unique(decontaminate._cell(h), return_counts=True)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.passage_sketch(docs, cells, np.ones(len(cells), np.float32)).collect()
    got = np.stack([np.frombuffer(r["dense"], np.float32) for r in rows])
    # every word that has a cell of its own has left something there
    assert len(got) <= decontaminate.SKETCH and got[:, held == 1].any(axis=0).all()
    few = np.stack([np.frombuffer(r["dense"], np.float32) for r in decontaminate.passage_sketch(docs.limit(1), cells, np.ones(len(cells), np.float32)).collect()])
    assert np.isclose((few**2).sum(), 1)
