"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed on the UTF-8 bytes of whole texts, a batch at a time. Trees are grown on histograms of binned
statistics, from a bounded sample of labelled rows, and kept as flat arrays of complete binary trees, which numpy walks
for all rows of a batch and all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, mix, slices, span_hashes, words

#: Labelled rows that training takes at most, chosen by the hash of their ids.
SAMPLE = 20_000

_KINDS = [
    ("lower", [(97, 122)]),
    ("upper", [(65, 90)]),
    ("digit", [(48, 57)]),
    ("blank", [(32, 32), (9, 9)]),
    ("newline", [(10, 13)]),
    ("stop", [(46, 46)]),
    ("comma", [(44, 44)]),
    ("bang", [(33, 33)]),
    ("pipe", [(124, 124)]),
    ("mark", [(35, 38), (42, 42), (64, 64), (94, 94), (126, 126)]),
    ("other", [(34, 34), (39, 41), (43, 43), (45, 45), (47, 47), (58, 63), (91, 93), (95, 96), (123, 123), (125, 125)]),
    ("high", [(128, 255)]),
]
_TABLE = np.zeros(256, np.int64)
for _i, (_, _spans) in enumerate(_KINDS):
    for _lo, _hi in _spans:
        _TABLE[_lo : _hi + 1] = _i

_TABLE8 = _TABLE.astype(np.int8)

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", *(f"share_{k}" for k, _ in _KINDS), "marked_words", "upper_words", "pure_marks",
    "distinct_words", "repeats", "distinct_pairs", "top_word", "lines", "line_words", "distinct_lines", "marked_line", "upper_line", "piped_line", "stop_gap",
]


def _sums(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=x, minlength=n)


def _most(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Largest value of each owner (0 without one); owner is sorted."""
    out = np.zeros(n)
    if len(x):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.maximum.reduceat(x, first)
    return out


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and the count of its most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    most = _most(np.diff(np.r_[first, len(h)]).astype(float), owner[first], n)
    return np.bincount(owner[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix with a row of STATISTICS for each text; finite for empty texts too."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    kinds = np.zeros((n, len(_KINDS)))
    if len(data):
        of = np.repeat(np.arange(n), np.diff(off))
        kinds = np.bincount(of * len(_KINDS) + _TABLE[data], minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    shares = kinds / np.maximum(size, 1)[:, None]
    h, owner, starts = words(data, off)
    count = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(count, 1)
    sums = np.zeros((4, len(data) + 1), np.int32)
    kind = _TABLE8[data]
    for i, name in enumerate(("mark", "upper", "bang", "pipe")):
        np.cumsum(kind == [k for k, _ in _KINDS].index(name), out=sums[i, 1:])
    # a word ends before the white space that follows it
    blank = np.r_[np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13))), len(data)] if len(data) else np.zeros(1, np.int64)
    ends = np.minimum(blank[np.searchsorted(blank, starts)] if len(starts) else starts, off[owner + 1] if len(starts) else starts)
    length = (ends - starts).astype(float)
    mark, upper, bang, pipe = (sums[i][ends] - sums[i][starts] for i in range(4))
    mean = _sums(length, owner, n) / some
    spread = np.sqrt(np.maximum(_sums(length**2, owner, n) / some - mean**2, 0))
    distinct, most = _distinct(h, owner, n)
    same = np.zeros(n)
    pairs = np.zeros(n)
    if len(h) > 1:
        inner = owner[1:] == owner[:-1]
        same = np.bincount(owner[1:][inner & (h[1:] == h[:-1])], minlength=n).astype(float)
        pairs, _ = _distinct(mix(h[:-1][inner] * np.uint64(3) + h[1:][inner]), owner[1:][inner], n)
    # lines: a line belongs to the text that its first byte belongs to
    cuts = np.unique(np.r_[off[:-1][size > 0], (np.flatnonzero(data == 10) + 1)[: None]]) if len(data) else np.zeros(0, np.int64)
    cuts = cuts[cuts < len(data)]
    rows = np.searchsorted(off, cuts, side="right") - 1
    until = np.r_[cuts[1:], len(data)].astype(np.int64) if len(cuts) else cuts
    lines = np.bincount(rows, minlength=n).astype(float)
    line_distinct, _ = _distinct(span_hashes(data, cuts, until) if len(cuts) else np.zeros(0, np.uint64), rows, n)
    in_line = np.searchsorted(cuts, starts, side="right") - 1
    per_line = np.maximum(np.bincount(in_line, minlength=len(cuts)), 1).astype(float) if len(cuts) else np.zeros(0)
    worst = []
    for flag in (mark > 0, (upper == length) & (length > 2) | (bang > 1), pipe > 0):
        share = np.bincount(in_line, weights=flag, minlength=len(cuts)) if len(cuts) else np.zeros(0)
        worst.append(_most(share / np.maximum(per_line, 4) if len(cuts) else share, rows, n))
    flagged = [_sums(x.astype(float), owner, n) / some for x in (mark > 0, (upper + bang >= length - 1) & (length > 2), mark + bang + pipe == length)]
    out = [np.log1p(size), np.log1p(count), mean, spread, *shares.T, *flagged, distinct / some, same / some, pairs / some, most / some, np.log1p(lines)]
    out += [count / np.maximum(lines, 1), line_distinct / np.maximum(lines, 1), *worst, count / (1 + kinds[:, 5])]
    return np.stack(out, axis=1)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node i has the children 2 i + 1 and 2 i + 2; x <= threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        z = np.full(len(x), self.prior)
        row = np.arange(len(x))
        for t in range(n_trees):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows stand on one level
                node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.threshold[t, node])
            z += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic boosting on histograms. Balances the two labels by weight; one label or no rows give a constant score."""
    inner = 2**depth - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y) or y.min() == y.max():
        return Trees(empty.feature, empty.threshold, empty.leaf, 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    z = np.zeros(len(y))
    features, thresholds, leaves = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, hess = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                at = (node - base) * k + binned[:, j]
                gs = np.bincount(at, weights=g, minlength=width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(at, weights=hess, minlength=width * k).reshape(width, k).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least / 4) | (ha - hl < least / 4)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[base : base + width][better] = j
                threshold[base : base + width][better] = cuts[j][top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = -rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=hess, minlength=inner + 1) + ridge)
        z += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), 0.0)


def is_held_out(key) -> F.Column:
    """Rows that no label is learnt from: crc32 of the key as text, modulo 3, is 1. Null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Trees from at most ``sample`` labelled rows that are not held out.

    Labels other than 0 and 1, null labels and ids labelled both ways teach nothing. Of more labelled rows those with
    the smallest hash of the id are taken, whatever the order of the input.
    """
    taught = (
        labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & ~is_held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where("quality = _most")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
        .select("_id", "quality")
    )
    base = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("text"))
    rows = base.join(F.broadcast(taught), "_id")  # at most ``sample`` rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for part, data, off in slices(batch):
                x = statistics(data, off)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("quality"), lists], ["id", "quality", "x"])

    got = rows.select("_id", "quality", "text").mapInArrow(run, "id long, quality int, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0), **options)
    got = got.sort_values("id", kind="stable").head(2 * sample)
    return fit(np.stack(got["x"].to_list()), got["quality"].to_numpy(float), **options)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null and empty texts are scored by their statistics like others. Rows that repeat are scored alike. Other columns
    of docs are not read; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)  # a few ten kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for part, data, off in slices(batch):
                p = model.value.scores(statistics(data, off))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    base = base.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs whose predicted quality is 1, in one pass without a join; columns as given."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for part, data, off in slices(batch):
                keep = trees.value.scores(statistics(data, off)) >= 0.5
                yield part.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, schema)
