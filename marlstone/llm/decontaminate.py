"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the IDF weights.
2. All passages of all documents and items are TF-IDF rows over the cells of the items' words. Each is added, with a sign by
   its hash, to one of a fixed number of rows: a sketch whose Gram matrix is that of all rows in expectation. A randomised
   SVD of the sketch, with all products over its rows computed by Spark, gives the latent basis: a range finder by power
   turns, then the singular vectors of the small matrix.
3. Every document is read in whole. A stretch that shares enough words with an item holds some of the item's rarest
   words, as many as its length says; only where they meet is a stretch looked at.
4. Stretches begin and end at words of the item, so they have its length and neither foreign words around nor the length
   of the item dilute their latent cosine with it. Those with enough of it are the candidates.
5. Candidates are confirmed on the words themselves: longest common subsequence with the item, and, for looser
   matches, the words of the item's answer (the rarest words of its last sentence).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, long_column, materialise, mix, slices, text_bytes, words

#: Cells of the table of document frequencies (4 bytes each in a task).
CELLS = 1 << 16
#: Items of one block, and the most items of a benchmark; what is sent to tasks is bounded by them.
BLOCK, MOST_ITEMS = 256, 20_000
#: Words of a passage of the basis, and of the window around the words of a short item.
WINDOW, STRIDE = 32, 16
#: Words of a document that are compared with an item at once, and its reach.
PART = 8192
#: Least cosine of such a window.
SHORT = 0.35
#: Rows of the sketch of all passages, at most, and its numbers (4 bytes each in a task).
SKETCH, NUMBERS = 1024, 1 << 22


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def idf_weights(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """IDF of each cell, ln(1 + N / df), and the number of documents, from all documents: one row for each cell and task is shuffled.

    It is above 0 even for a word of every document; a word of none counts as one of half a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for part, data, off in slices(batch):
                h, owner, _ = words(data, off)
                at = np.unique(owner * CELLS + _cell(h))
                total += np.bincount(at % CELLS, minlength=CELLS)
                n += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[n, total[used]])], ["cell", "df"])

    rows = docs.select(docs[text].alias("text")).mapInArrow(run, "cell long, df long").groupBy("cell").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(CELLS)
    n = int(rows.loc[rows["cell"] < 0, "df"].sum())
    rows = rows[rows["cell"] >= 0]
    df[rows["cell"].to_numpy()] = rows["df"].to_numpy()
    return np.log1p(max(n, 1) / np.maximum(df, 0.5)).astype(np.float32), n


@dataclass(frozen=True)
class Block:
    """Items of a block: ids, words, answers, vocabulary (sorted hashes), latent vectors of words (with IDF) and items; and for the search
    member (item x word), need (the least common words), reach (words of a stretch), least (rare words that a stretch
    with enough common words holds at least) and the items of each rare word (slot_items from slots on).
    """

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    member: np.ndarray
    need: np.ndarray
    reach: np.ndarray
    least: np.ndarray
    slots: np.ndarray
    slot_items: np.ndarray


def passage_sketch(docs: DataFrame, cells: np.ndarray, weights: np.ndarray) -> DataFrame:
    """dense (float32 row over ``cells``, the sorted cells of the items) of the sketch of the passages of all documents (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((cells, weights))
    width, height = len(cells), min(SKETCH, max(128, NUMBERS // max(len(cells), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        own, idf = sent.value
        z = np.zeros(height * width, np.float32)
        for batch in batches:
            for part, data, off in slices(batch):
                keys, _ = long_column(part.column("doc_id"))
                h, owner, _ = words(data, off)
                cell = _cell(h)
                at = np.minimum(np.searchsorted(own, cell), width - 1)
                known = np.flatnonzero(own[at] == cell)
                if not len(known):
                    continue
                count = np.bincount(owner, minlength=part.num_rows)
                number = (np.arange(len(h)) - (np.cumsum(count) - count)[owner])[known] // WINDOW
                text = owner[known]
                passage = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (number[1:] != number[:-1])])
                first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                spot, times = np.unique(passage * width + at[known], return_counts=True)
                passage, place = spot // width, spot % width
                value = times * idf[place].astype(np.float64)
                value /= np.sqrt(np.maximum(np.bincount(passage, value * value), 1e-18))[passage]
                tag = mix(mix(keys[text[first]].astype(np.uint64)) + number[first].astype(np.uint64))
                sign = np.where(tag >> np.uint64(63), 1.0, -1.0)
                np.add.at(z, (tag % np.uint64(height)).astype(np.int64)[passage] * width + place, (value * sign[passage]).astype(np.float32))
        z = z.reshape(height, width)
        used = np.flatnonzero(z.any(axis=1))
        for lo in range(0, len(used), 256):
            yield pa.RecordBatch.from_arrays([pa.array(used[lo : lo + 256], pa.int64()), pa.array([z[i].tobytes() for i in used[lo : lo + 256]], pa.binary())], ["row", "dense"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [frame["row"].iloc[0]], "dense": [sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["dense"]).astype(np.float32).tobytes()]})

    kind = "row long, dense binary"
    # a group holds the rows of 64 tasks at most in the first sum
    parts = docs.select("doc_id", "text").mapInArrow(run, kind).withColumn("part", F.floor(F.spark_partition_id() / 64))
    return parts.groupBy("row", "part").applyInPandas(total, kind).groupBy("row").applyInPandas(total, kind).select("dense")


def _dense(lists: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one of lists of places."""
    out = np.zeros((len(lists), len(weights)), np.float32)
    for i, x in enumerate(lists):
        np.add.at(out[i], x, weights[x])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def randomised_svd(rows: DataFrame, weights: np.ndarray, rank: int, turns: int = 2, more: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (places x rank) and singular values of the TF-IDF rows of ``rows`` (cells), or of its rows as they are (dense).

    Turns multiply a random start by the transpose of the rows and the rows; partitions give partial products, which are
    summed by slabs, so no task holds more than one product. The small matrix of the rows in the basis found, again
    summed over partitions, has the singular values and turns the basis into singular vectors.
    """
    spark, slab = rows.sparkSession, 4096
    sent = spark.sparkContext.broadcast(weights)
    width = min(rank + more, len(weights))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(weights), width)))[0].astype(np.float32)

    def summed(q: np.ndarray, small: bool) -> np.ndarray:
        start = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.zeros((q_width, q_width) if small else (len(sent.value), q_width), np.float64)
            step = max(1, (4 << 20) // len(sent.value))
            for batch in batches:
                given = "dense" in batch.schema.names
                lists = batch.column("dense" if given else "cells").to_pylist()
                for lo in range(0, len(lists), step):
                    some = lists[lo : lo + step]
                    a = np.stack([np.frombuffer(x, np.float32) for x in some]) if given else _dense([np.asarray(x, np.int64) for x in some], sent.value)
                    b = a @ start.value
                    z += (b.T @ b) if small else (a.T @ b)
            at = list(range(0, len(z), slab))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([z[i : i + slab].tobytes() for i in at], pa.binary())], ["slab", "z"])

        q_width = q.shape[1]

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"slab": [frame["slab"].iloc[0]], "z": [sum(np.frombuffer(x, np.float64) for x in frame["z"]).tobytes()]})

        got = rows.mapInArrow(run, "slab long, z binary").groupBy("slab").applyInPandas(total, "slab long, z binary").toPandas().sort_values("slab")
        return np.concatenate([np.frombuffer(x, np.float64) for x in got["z"]]).reshape(-1, q_width)

    for _ in range(turns):
        q = np.linalg.qr(summed(q, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(summed(q, True))
    order = np.argsort(-values)[:rank]
    return (q @ vectors[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0))


def _blocks(base: DataFrame, benchmark: DataFrame, idf: np.ndarray, rank: int, share: float) -> list[Block]:
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"], F.lit("")).alias("text"))
    rows = items.where("item_id IS NOT NULL").groupBy("item_id", "text").count().drop("count").orderBy("item_id", "text").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a benchmark of more than {MOST_ITEMS} items: split it")
    held = []
    for r in rows:
        data, off = text_bytes(pa.array([r["text"]], pa.string()))
        h, _, starts = words(data, off)
        if len(h):
            # the last sentence begins after the last full stop that is not the end
            raw = r["text"].encode()
            stop = raw[: max(raw.rstrip().rfind(b"."), 0)].rfind(b".")
            last = h[starts > stop] if stop >= 0 else h
            held.append((r["item_id"], h, last[np.argsort(-idf[_cell(last)], kind="stable")][:3]))
    if not held:
        return []
    cells = np.unique(_cell(np.concatenate([h for _, h, _ in held])))
    # items beside the documents: their words have a place even where no document has them
    every = base.select("doc_id", "text").unionByName(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    rows_ = materialise(passage_sketch(every, cells, idf[cells]), "leak-sketch")
    basis, _ = randomised_svd(rows_.repartition(max(1, min(8, len(cells) // 500))), idf[cells], rank)
    out = []
    for lo in range(0, len(held), BLOCK):
        ids, texts, answers = (list(x) for x in zip(*held[lo : lo + BLOCK], strict=True))
        vocabulary = np.unique(np.concatenate(texts))
        vectors = basis[np.searchsorted(cells, _cell(vocabulary))] * idf[_cell(vocabulary)][:, None]
        latent = np.stack([vectors[np.searchsorted(vocabulary, x)].sum(axis=0, dtype=np.float64) for x in texts])
        out.append(Block(ids, texts, answers, vocabulary, vectors, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9), *_rare_words(texts, vocabulary, idf, share)))
    return out


def _rare_words(items: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray, share: float) -> tuple:
    """member, need, reach, least, slots and slot_items of Block.

    A stretch with need of the m words of an item lacks m - need of them at most, so of any m - need + least words of
    the item it holds least: the rarest are taken, however common they are.
    """
    size = np.array([len(x) for x in items])
    need = np.where(size < 8, size, np.ceil(size * share - 1e-9)).astype(np.int64)
    least = np.minimum(need, 3)
    member = np.zeros((len(items), len(vocabulary)), bool)
    pairs = []
    for j, x in enumerate(items):
        at = np.searchsorted(vocabulary, x)
        member[j, at] = True
        rare = np.unique(at[np.argsort(-idf[_cell(x)], kind="stable")][: size[j] - need[j] + least[j]])
        pairs.append(np.stack([rare, np.full(len(rare), j)]))
    word, item = np.concatenate(pairs, axis=1)
    order = np.lexsort((item, word))
    slots = np.searchsorted(word[order], np.arange(len(vocabulary) + 1))
    return member, need, WINDOW + 2 * size, least, slots, item[order]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro, 2004)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", cosine: float = 0.35, near: float = 0.8, loose: float = 0.6, answer: float = 0.6, rank: int = 64
) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word of every benchmark item found in a document.

    An item is found where its words have a common subsequence with a stretch of the document of ``near`` of them, or
    of ``loose`` of them with ``answer`` of its answer words; a stretch begins and ends at words of the item, has WINDOW
    words and twice the item's at most, and its latent cosine with the item is ``cosine`` or more. Items of fewer than 8
    words must be there whole, in one run or in a window whose cosine by words is enough. Null and
    empty texts, items without words and null item ids match nothing. Repeated rows of docs give repeated results, a
    null key a null doc_id. Other columns are not read; an empty table of either side gives no rows.
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    base = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    idf, _ = idf_weights(base)
    blocks = _blocks(base, benchmark, idf, rank, min(near, loose))
    model = docs.sparkSession.sparkContext.broadcast((idf, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        weights, parts = model.value
        for batch in batches:
            for part, data, off in slices(batch):
                keys, null = long_column(part.column("doc_id"))
                h, owner, _ = words(data, off)
                rows = []
                if len(h):
                    count = np.bincount(owner, minlength=part.num_rows)
                    first = np.cumsum(count) - count
                    for block in parts:
                        rows += _search(block, h, weights, first, count, owner, cosine, near, loose, answer)
                rows = pd.DataFrame(rows, columns=["row", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])
                at = rows["row"].to_numpy(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at], mask=null[at]), pa.array(rows["item_id"].to_numpy(np.int64)), *(pa.array(rows[c].to_numpy(np.float64)) for c in ("cosine", "lcs_share", "answer_share")), pa.array(rows["first_word"].to_numpy(np.int64))],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"],
                )

    return base.mapInArrow(run, schema)


def _cosine(item: np.ndarray, window: np.ndarray, weights: np.ndarray) -> float:
    """Cosine of an item and a window by their words; the window's norm counts each of its words by itself."""
    words_, counts = np.unique(item, return_counts=True)
    v = counts * weights[_cell(words_)].astype(np.float64)
    at = np.minimum(np.searchsorted(words_, window), len(words_) - 1)
    w = weights[_cell(window)].astype(np.float64)
    return float((w * v[at])[words_[at] == window].sum() / max(np.linalg.norm(v), 1e-9) / np.sqrt(max((w**2).sum(), 1e-12)))


def _search(block, h, weights, first, count, owner, cosine, near, loose, answer) -> list[tuple]:
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == h
    # places of the rare words of each item, item by item and in the order of the texts
    size = np.where(known, block.slots[at + 1] - block.slots[at], 0)
    place = np.repeat(np.arange(len(h)), size)
    item = block.slot_items[np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.slots[at], size)]
    order = np.argsort(item, kind="stable")
    place, item = place[order], item[order]
    text, reach = owner[place], block.reach[item]
    # a stretch with enough of the item's words holds block.least rare ones
    hi = np.arange(len(place)) + block.least[item] - 1
    to = np.minimum(hi, len(place) - 1)
    some = np.flatnonzero((hi < len(place)) & (item[to] == item) & (text[to] == text) & (place[to] - place < reach))
    place, item, text, reach = place[some], item[some], text[some], reach[some]
    begin, end = np.maximum(place - reach + 1, first[text]), np.minimum(place + reach, first[text] + count[text])
    fresh = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (begin[1:] > end[:-1]) | (text[1:] != text[:-1])]) if len(place) else np.zeros(0, np.int64)
    best: dict[tuple[int, int], tuple] = {}
    for x, y in zip(fresh, np.r_[fresh[1:], len(place)][: len(fresh)] - 1, strict=True):
        t = int(text[x])
        j, to = int(item[x]), int(end[y])
        for lo in range(int(begin[x]), to, PART):  # a stretch begins in one part and may end in the next
            row = _confirm(block, j, h, at, known, weights, lo, min(to, lo + PART + int(block.reach[j])), int(first[t]), int(first[t] + count[t]), cosine, near, loose, answer)
            if row is None:
                continue
            key = t, block.ids[j]
            if key not in best or (row[1], row[0], -row[3]) > (best[key][1], best[key][0], -best[key][3]):
                best[key] = row
    return [(*k, *best[k]) for k in sorted(best)]


def _confirm(block, j, h, at, known, weights, lo, hi, first, last, cosine, near, loose, answer) -> tuple | None:
    """cosine, lcs_share, answer_share, first_word of the best stretch of h[lo:hi] that holds item j, if one does."""
    item, need, reach = block.words[j].tolist(), block.need[j], int(block.reach[j])
    places = lo + np.flatnonzero(known[lo:hi] & block.member[j, at[lo:hi]])
    if len(places) < need:
        return None
    ends = np.searchsorted(places, places + reach)
    begins = np.flatnonzero(ends - np.arange(len(places)) >= need)
    if not len(begins):
        return None
    # latent vectors of the stretches that begin at a word of the item, by sums over the words before
    sums = np.zeros((hi - lo + 1, block.basis.shape[1]))
    np.cumsum(np.where(known[lo:hi, None], block.basis[at[lo:hi]], 0), axis=0, out=sums[1:])
    # of the stretches that begin there, the item's own length and the whole reach
    own = np.minimum(np.searchsorted(places, places[begins] + len(item)), ends[begins])
    scores = []
    for e in (own, ends[begins]):
        dense = sums[places[np.maximum(e - 1, begins)] + 1 - lo] - sums[places[begins] - lo]
        scores.append(dense @ block.latent[j] / np.maximum(np.linalg.norm(dense, axis=1), 1e-9))
    scores = np.maximum(*scores)
    m, answers, best = len(item), set(block.answers[j].tolist()), None
    said = h[places].tolist()
    for i, score in zip(begins.tolist(), scores.tolist(), strict=True):
        if score < cosine:
            continue
        e = int(ends[i])
        got = common_subsequence(item, said[i:e])
        if got < need:
            continue
        replies = len(answers.intersection(said[i:e])) / len(answers)
        if got >= near * m - 1e-9 or replies >= answer or m < 8:
            if best is None or (got, replies, score) > best[:3]:
                best = got, replies, score, i, e
    if best is None:
        return None
    got, replies, score, i, e = best
    if m < 8 and not any(said[k : k + m] == item and places[k + m - 1] - places[k] == m - 1 for k in range(len(said) - m + 1)):
        # the words of a short item that stand apart count only in a window that is like it
        a, b, final = int(places[i]) - first, int(places[e - 1]) + 1 - first, max(0, -(-(last - first - WINDOW) // STRIDE) * STRIDE)
        grid = {min(g, final) for g in range(max(0, a - WINDOW) // STRIDE * STRIDE, b, STRIDE)}
        if max(_cosine(block.words[j], h[first + g : min(first + g + WINDOW, last)], weights) for g in grid) < SHORT:
            return None
    return score, got / m, replies, int(places[i]) - first


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a benchmark item; columns as given.

    All rows of a key are one document and go together; rows with a null key stay. Null and empty texts stay; empty
    tables of either side drop nothing.
    """
    gone = find_leaks(docs, benchmark, text, key, **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
