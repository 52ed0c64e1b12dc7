"""Removal of repeated substrings by prefix-free parsing.

1. Parse. A rolling hash over strings of 16 bytes makes the triggers: in each 50-byte window the (leftmost) least hash.
   The windows of one trigger, side by side, make a phrase; equal text is parsed into equal phrases wherever it stands.
   No window is without a trigger, which triggers by a remainder do not assure.
2. Dictionary. Equal phrases are sorted next to each other by trigger and hash; one entry stays of each, with the
   smallest document that has it. Phrases of a trigger that stands once in the corpus leave first, by their hashes alone;
   what repeats as a whole goes here; only distinct phrases of triggers that other phrases have too come with their text.
3. Suffix arrays. A window is the end of what stands before a trigger and the begin of what follows it. What follows the
   trigger is sorted with longest common prefixes: the suffix array of the parse, cut at 50 bytes, as suffixes of the
   parse are the suffixes of the corpus that begin at triggers. What stands before it is sorted from its end: the order
   of the dictionary's proper suffixes that end at a trigger. Windows are equal exactly if both their runs are equal, so
   the two orders combined are the corpus order of all windows without a comparison of windows.
4. The parse brings the answers back to the documents.

A trigger that very many phrases share (found from an even sample, so results do not depend on it) is no key for its
phrases: their windows are parsed again with longer triggers, at last with the window itself, of which a block of
documents sends one at most. Texts lie in compressed blocks; what a block sends to a bucket is one row of packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, lean_memory, long_column, materialise, mix, span_hashes, text_bytes

#: Bytes of a block of documents; a longer document has a block of its own.
BLOCK = 2 << 20
#: Bytes of text for which one bucket of triggers is made, and for which one partition of blocks is made.
PER_BUCKET, PER_PARTITION = 8 << 20, 64 << 20
#: Phrases of one trigger, of all phrases, from which on it is too common; at most this many triggers can be.
COMMON, MOST_COMMON = 100_000, 1 << 20
#: Of SAMPLE pieces of this many bytes the triggers of one are counted.
SAMPLE_PIECE, SAMPLE = 1 << 14, 128
#: Dictionary entries whose suffixes are sorted at once; the entries of one trigger stay together.
ENTRIES = 60_000
_PIECE = 1 << 19
_PLACE, _MASK = np.uint64((1 << 20) - 1), np.uint64((1 << 48) - 1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Doc id that null stands for: after all others.
_LAST = np.iinfo(np.int64).max


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each string of k bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE, len(data))[: len(data) - k + 1])


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < w:
        h = np.minimum(h[: len(h) - (w - size)], h[w - size :])
    return h


def phrases(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each phrase of the texts data[off[i]:off[i+1]]: trigger, phrase hash, first window, windows, bytes before the trigger.

    Triggers are 63-bit hashes. Long data is parsed in pieces; a phrase cut by the end of a piece is two, which costs no result.
    """
    out = []
    ends = off[1:]
    for lo in range(0, max(len(data) - length + 1, 0), _PIECE):
        part = data[lo : lo + _PIECE + length - 1]
        roll = _rolling(part, k)
        place = (_smallest(roll & ~_PLACE | np.arange(len(roll), dtype=np.uint64), length - k + 1) & _PLACE).astype(np.int64)
        first = np.arange(lo, lo + len(place))
        valid = ends[np.searchsorted(ends, first, side="right").clip(max=len(ends) - 1)] - first >= length
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        change[off[(off >= lo) & (off < lo + len(place))] - lo] = True
        at = np.flatnonzero(change)
        n = np.diff(np.r_[at, len(place)])
        keep = valid[at]
        at, n = at[keep], n[keep]
        if len(at):
            trigger = mix(roll[place[at]] + np.uint64(k)) >> np.uint64(1)
            out.append((trigger, span_hashes(part, at, at + length + n - 1), at + lo, n, place[at] - at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def parse(data: np.ndarray, off: np.ndarray, length: int, triggers: tuple[int, ...], common: np.ndarray) -> list[np.ndarray]:
    """Phrases of the texts, as of phrases(), where those of common triggers (sorted) are parsed with longer ones instead."""
    done = []
    got = phrases(data, off, length, triggers[0])
    for k in triggers[1:]:
        if not len(common):
            break
        at = np.minimum(np.searchsorted(common, got[0]), len(common) - 1)
        hot = common[at] == got[0]
        done.append([x[~hot] for x in got])
        start, n = got[2][hot], got[3][hot]
        size = n + length - 1
        cut = np.r_[0, np.cumsum(size)]
        h, g, first, n, left = phrases(data[_spread(start, size)], cut, length, k)
        first += (start - cut[:-1])[np.searchsorted(cut, first, side="right") - 1] if len(first) else 0
        got = h, g, first, n, left
    done.append(got)
    return [np.concatenate(x) for x in zip(*done, strict=True)]


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Integer arrays of one length, by byte planes, and a text; compressed. Constant planes take no room."""
    planes = [np.frombuffer(np.ascontiguousarray(x.astype(np.int64)).tobytes(), np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *planes, text]))


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8)[8:]
    arrays = [np.ascontiguousarray(p.reshape(8, n).T).reshape(-1).view(np.int64) for p in planes[: 8 * n * count].reshape(count, 8 * n)] if n else [np.zeros(0, np.int64)] * count
    return [*arrays, planes[8 * n * count :]]


def _block_rows(length: int, triggers: tuple[int, ...], size: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        task, number = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            keys, null = long_column(batch.column(0))
            keys = np.where(null, _LAST, keys)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
                own, cut = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                seen = []
                for a in range(number % sample * SAMPLE_PIECE, len(own), sample * SAMPLE_PIECE):
                    piece = own[a : a + SAMPLE_PIECE]
                    for k in triggers[:-1]:
                        h, g, *_ = phrases(piece, np.r_[0, (cut - a)[(cut > a) & (cut < a + len(piece))], len(piece)], length, k)
                        seen.append(h[np.unique(g, return_index=True)[1]])
                columns = [
                    pa.array([task << 32 | number], pa.int64()), pa.array([keys[lo:hi]], pa.list_(pa.int64())), pa.array([np.diff(cut)], pa.list_(pa.int64())),
                    pa.array([compress(own.tobytes())], pa.binary()), pa.array([np.concatenate(seen).view(np.int64) if seen else []], pa.list_(pa.int64())), pa.array([len(own)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "data", "seen", "size"])
                number += 1
                lo = hi

    return run


def _texts(keys, sizes, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, offsets and bytes of a block."""
    return keys.values.to_numpy(), np.r_[0, np.cumsum(sizes.values.to_numpy())].astype(np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8)


#: Columns that a phrase has in a blob: trigger (differences), phrase hash, doc, start, windows, repetitions, bytes before
#: the trigger, and 1 where it has a text of its own (0: that of the phrase before, or none).
_SENT = 8


def _dictionary(keys: np.ndarray, cut: np.ndarray, data: np.ndarray, length: int, triggers: tuple[int, ...], common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of a block by trigger, phrase hash and doc: those, start, windows, bytes before the trigger, repetitions, and
    whether a row is the first of its phrase. Neighbours that are one phrase again and again, as in periods, are one row.
    """
    h, g, start, n, left = parse(data, cut, length, triggers, common)
    order = np.argsort(start)
    h, g, start, n, left = (x[order] for x in (h, g & _MASK, start, n, left))
    of = np.searchsorted(cut, start, side="right") - 1
    same = np.zeros(len(h), bool)
    same[1:] = (g[1:] == g[:-1]) & (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (start[1:] == start[:-1] + n[:-1]) & (of[1:] == of[:-1])
    at = np.flatnonzero(~same)
    reps = np.diff(np.r_[at, len(h)])
    h, g, start, n, left, doc = h[at], g[at], start[at], n[at], left[at], keys[of[at]]
    order = np.lexsort((doc, g, h))
    h, g, start, n, left, doc, reps = (x[order] for x in (h, g, start, n, left, doc, reps))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h, g, doc, start, n, left, reps, new


def _buckets(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of sorted triggers: numbers, and where each begins and ends."""
    bucket = (h >> np.uint64(31)).astype(np.int64) * buckets >> 32
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], at, np.r_[at[1:], len(bucket)].astype(np.int64)


def _rows(bucket: list[int], block: int, kind: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int64()), pa.array([block] * len(bucket), pa.int64()), pa.array(kind, pa.int8()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "kind", "blob"])


def _hashes(length: int, triggers: tuple[int, ...], buckets: int, common):
    """Rows (bucket, block, kind, blob): trigger and hash of each distinct phrase of a block, in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for row in range(batch.num_rows):
                h, g, *_, new = _dictionary(*_texts(*(batch.column(c)[row] for c in ("doc_ids", "sizes", "data"))), length, triggers, common.value)
                h, g = h[new], g[new]
                number, at, to = _buckets(h, buckets)
                yield _rows(number.tolist(), batch.column("block")[row].as_py(), [0] * len(at), [_pack(np.diff(h[a:b].astype(np.int64), prepend=0), g[a:b]) for a, b in zip(at, to, strict=True)])

    return run


def _shared(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what _hashes sent to a bucket: number of the blob, and 1 for a trigger that several blocks or phrases have, 2 for
    one of several phrases.
    """
    parts = [(np.cumsum(d), g, np.full(len(d), i, np.int32)) for i, (_, blob) in enumerate(blobs) for d, g, _ in [_unpack(blob, 2)]]
    h, g, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.r_[True, h[1:] != h[:-1]]
    at, which = np.flatnonzero(new), np.cumsum(new) - 1
    rows, kinds = np.diff(np.r_[at, len(h)]), np.add.reduceat((new | np.r_[True, g[1:] != g[:-1]]).astype(np.int64), at)
    marks = np.empty(len(h), np.int64)
    marks[order] = np.where(kinds > 1, 2, np.where(rows > 1, 1, 0))[which]
    return of, marks, marks


def _send(length: int, triggers: tuple[int, ...], buckets: int, common):
    """Rows (bucket, block, kind, blob): the shared phrases of a block (kind 0), and what goes for its own sake (1).

    What a smaller document of the same block has goes at once, so a frequent phrase is sent once a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for row in range(batch.num_rows):
                keys, cut, data = _texts(*(batch.column(c)[row] for c in ("doc_ids", "sizes", "data")))
                h, g, doc, start, n, left, reps, new = _dictionary(keys, cut, data, length, triggers, common.value)
                phrase = np.cumsum(new) - 1
                gone = doc > doc[np.flatnonzero(new)][phrase] if len(h) else new
                marks = batch.column("state")[row]
                marks = np.concatenate([_unpack(x["blob"], 2)[0] for x in sorted(marks.as_py(), key=lambda x: x["bucket"])]) if marks.is_valid else np.zeros(0, np.int64)
                number, _, _ = _buckets(h[:1], buckets)
                out = [(int(number[0]), 1, _pack(start[gone], (n * reps)[gone]))] if gone.any() else []
                kept = ~gone & (marks[phrase] > 0)
                mixed = (marks[phrase] > 1)[kept]
                h, g, doc, start, n, left, reps, new = (x[kept] for x in (h, g, doc, start, n, left, reps, new))
                for b, lo, hi in zip(*_buckets(h, buckets), strict=True):
                    own = (new & mixed)[lo:hi]
                    text = data[_spread(start[lo:hi][own], n[lo:hi][own] + length - 1)]
                    out.append((int(b), 0, _pack(np.diff(h[lo:hi].astype(np.int64), prepend=0), g[lo:hi], *(x[lo:hi] for x in (doc, start, n, reps, left)), own, text=text.tobytes())))
                yield _rows([x[0] for x in out], batch.column("block")[row].as_py(), [x[1] for x in out], [x[2] for x in out])

    return run


def _orders(text: np.ndarray, trigger: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by trigger and the text from it on (or, back, before it, read backwards), and the length of
    the common prefix with the one before in this order (-1 for another trigger). Texts are cut at depth and at their ends.
    """
    step = np.arange(depth)
    place = at[:, None] - 1 - step if back else at[:, None] + step
    inside = place >= begin[:, None] if back else place < end[:, None]
    chars = np.zeros((len(at), -(-depth // 8) * 8), np.uint8)
    chars[:, :depth] = np.where(inside, text[np.where(inside, place, 0)], 0)
    keys = chars.view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], trigger))
    chars, trigger = chars[order], trigger[order]
    common = np.full(len(at), -1)
    if len(at) > 1:
        differs = chars[1:] != chars[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
        common[1:] = np.where(trigger[1:] == trigger[:-1], first, -1)
    return order, common


def _seen_before(text: np.ndarray, trigger: np.ndarray, doc: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """For each window of each dictionary entry: whether an entry of a smaller document has the same window.

    A window begins o bytes before its trigger. Two are equal if their entries stand in one run of the order of what
    follows the trigger, with length - o common bytes, and in one run of the order of what stands before, with o.
    """
    end = begin + n + length - 1
    first = np.cumsum(n) - n
    lost = np.zeros(int(n.sum()), bool)
    after, after_common = _orders(text, trigger, begin, end, begin + left, length, False)
    before, before_common = _orders(text, trigger, begin, end, begin + left, int(left.max()) if len(left) else 0, True)
    run_after, run_before = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    alone = np.empty(len(n), bool)
    for o in range(int(left.max()) + 1 if len(left) else 0):
        breaks = after_common < length - o
        run_after[after] = np.cumsum(breaks)
        alone[after] = breaks & np.r_[breaks[1:], True]
        have = np.flatnonzero((left >= o) & (left - o < n) & ~alone)
        if not len(have):
            continue
        run_before[before] = np.cumsum(before_common < o)
        key = run_after[have] << 32 | run_before[have]
        order = np.argsort(key, kind="stable")
        have, key = have[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        least = np.minimum.reduceat(doc[have], np.flatnonzero(new))[np.cumsum(new) - 1]
        have = have[doc[have] > least]
        lost[first[have] + left[have] - o] = True
    return lost


def _bucket_answers(blobs: list[tuple[int, bytes]], length: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the blob, first window and windows of all that goes of the phrases of one bucket."""
    parts, texts, base = [], [], 0
    for i, (_, blob) in enumerate(blobs):
        h, g, doc, start, n, reps, left, own, text = _unpack(blob, _SENT)
        size = np.where(own > 0, n + length - 1, 0)
        begin = np.cumsum(size) - size
        begin = begin[np.maximum.accumulate(np.where(own > 0, np.arange(len(own)), 0))] if len(own) else begin
        parts.append((np.cumsum(h), g, doc, start, n, reps, left, begin + base, np.full(len(h), i, np.int32)))
        texts.append(text)
        base += len(text)
    h, g, doc, start, n, reps, left, begin, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    text = np.concatenate(texts)
    del texts
    order = np.lexsort((doc, g, h))
    h, g, doc, start, n, reps, left, begin, of = (x[order] for x in (h, g, doc, start, n, reps, left, begin, of))
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_g = new_h | np.r_[True, g[1:] != g[:-1]]
    entry, at = np.cumsum(new_g) - 1, np.flatnonzero(new_g)
    gone = doc > doc[at][entry]
    out = [(of[gone], start[gone], (n * reps)[gone])]
    # dictionary entries whose trigger other entries of other documents have
    at_h, of_h = np.flatnonzero(new_h), np.cumsum(new_h) - 1
    several = (np.add.reduceat(new_g.astype(np.int64), at_h) > 1) & (np.minimum.reduceat(doc, at_h) != np.maximum.reduceat(doc, at_h))
    dictionary = at[several[of_h[at]]]
    del new_h, g
    trigger = h[dictionary]
    lo = 0
    while lo < len(dictionary):
        hi = int(np.searchsorted(trigger, trigger[min(lo + entries, len(trigger)) - 1], side="right"))
        own = dictionary[lo:hi]
        lost = _seen_before(text, h[own], doc[own], begin[own], n[own], left[own], length)
        # runs of lost windows, for each place of the entry in its document and each repetition
        first = np.cumsum(n[own]) - n[own]
        run = lost & ~np.r_[False, lost[:-1]]
        run[first] |= lost[first]
        stop = lost & ~np.r_[lost[1:], False]
        stop[first[1:] - 1] |= lost[first[1:] - 1]
        a, b = np.flatnonzero(run), np.flatnonzero(stop) + 1
        whose = np.searchsorted(first, a, side="right") - 1
        runs = np.bincount(whose, minlength=len(own))
        at_run = np.cumsum(runs) - runs
        # the rows of the entries at hand stand together: all are ordered by trigger
        span = np.arange(own[0], at[entry[own[-1]] + 1] if entry[own[-1]] + 1 < len(at) else len(h))
        span = span[several[of_h[span]] & ~gone[span]]
        mine = np.searchsorted(own, at[entry[span]])
        rows, mine = span[runs[mine] > 0], mine[runs[mine] > 0]
        r = np.repeat(rows, runs[mine])
        w = _spread(at_run[mine], runs[mine])
        off, size = a[w] - first[whose[w]], b[w] - a[w]
        whole = size == n[r]
        times = np.where(whole, 1, reps[r])
        size = np.where(whole, n[r] * reps[r], size)
        turn = _spread(np.zeros(len(times), np.int64), times)
        r, off, size = np.repeat(r, times), np.repeat(off, times), np.repeat(size, times)
        out.append((of[r], start[r] + off + turn * n[r], size))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_bucket(tell):
    """Rows (block, bucket, blob) from rows sorted by bucket; tell gives for the blobs of a bucket the number of the blob
    and two values of each row of the answer. Rows of kind 1 pass as they are.
    """

    def finish(bucket: int | None, blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if blobs:
            of, *values = tell(blobs)
            order = np.argsort(of, kind="stable")
            of, values = of[order], [x[order] for x in values]
            at = np.searchsorted(of, np.arange(len(blobs) + 1))
            some = [i for i in range(len(blobs)) if at[i] < at[i + 1]]
            yield _answers([blobs[i][0] for i in some], [bucket] * len(some), [_pack(*(x[at[i] : at[i + 1]] for x in values)) for i in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        now, blobs = None, []
        for batch in batches:
            for bucket, block, kind, blob in zip(*(batch.column(c) for c in ("bucket", "block", "kind", "blob")), strict=True):
                if kind.as_py():
                    yield _answers([block.as_py()], [bucket.as_py()], [blob.as_py()])
                    continue
                if bucket.as_py() != now:
                    yield from finish(now, blobs)
                    now, blobs = bucket.as_py(), []
                blobs.append((block.as_py(), blob.as_py()))
        yield from finish(now, blobs)

    return run


def _answers(block: list[int], bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["block", "bucket", "blob"])


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for row in range(batch.num_rows):
                keys, cut, data = _texts(*(batch.column(c)[row] for c in ("doc_ids", "sizes", "data")))
                state = batch.column("state")[row]
                sizes = np.diff(cut)
                edge = np.zeros(len(data) + 1, np.int64)
                if state.is_valid:
                    start, n = (np.concatenate(x) for x in list(zip(*(_unpack(x["blob"], 2) for x in state.as_py()), strict=True))[:2])
                    edge += np.bincount(start, minlength=len(edge))
                    edge -= np.bincount(start + n + length - 1, minlength=len(edge))
                lost = np.cumsum(edge[:-1]) > 0
                begin = lost.copy()
                begin[1:] &= ~lost[:-1]
                begin[cut[:-1][sizes > 0]] |= lost[cut[:-1][sizes > 0]]
                total, spans = (np.r_[0, np.cumsum(x)] for x in (lost, begin))
                removed, spans = total[cut[1:]] - total[cut[:-1]], spans[cut[1:]] - spans[cut[:-1]]
                kept = [(data[a:b][~lost[a:b]] if r else data[a:b]).tobytes() for a, b, r in zip(cut[:-1], cut[1:], removed, strict=True)]
                digest = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == _LAST), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, triggers: tuple[int, ...] = (16, 40), common: int = COMMON, block: int = BLOCK, sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row of docs.

    Each byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller key;
    strings are judged on the input and never cross documents. Null texts are empty; texts shorter than ``length`` stay
    whole. Rows that share a key do not remove from each other. Null keys come after all others. Other columns are not
    read; an empty table gives no rows. kept may end a character: it is bytes. Whole phrases are equal when 111 bits of
    two hashes are; windows are compared byte by byte. ``triggers`` are the lengths of rolled strings, the next for
    triggers that ``common`` phrases share; the last is the window itself. ``block`` bytes, one of ``sample`` pieces and
    ``entries`` of the dictionary are the sizes of the work; no result depends on them.
    """
    spark = docs.sparkSession
    levels = (*triggers, length)
    base = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    blocks = materialise(base.mapInArrow(_block_rows(length, levels, block, sample), "block long, doc_ids array<long>, sizes array<long>, data binary, seen array<long>, size long"), "repeats-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets, parts = max(64, -(-total // PER_BUCKET)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_PARTITION))
    # the triggers that are common share all phrases, about one for 18 bytes, so they are MOST_COMMON at most
    enough = max(common, total // 18 // MOST_COMMON) / sample
    hot = blocks.select(F.explode("seen").alias("h")).groupBy("h").count().where(F.col("count") >= enough).select("h").toPandas()["h"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(np.sort(hot).astype(np.uint64))
    texts = blocks.select("block", "doc_ids", "sizes", "data")

    def asked(rows: DataFrame, tell, name: str) -> DataFrame:
        """What the buckets tell of the rows that are sent to them, as one list for each block."""
        told = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(tell), "block long, bucket long, blob binary")
        return texts.repartition(parts, "block").join(materialise(told, name).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("state")), "block", "left")

    schema = "bucket long, block long, kind byte, blob binary"
    marked = asked(texts.mapInArrow(_hashes(length, levels, buckets, sent), schema), _shared, "repeats-shared")
    answered = asked(marked.mapInArrow(_send(length, levels, buckets, sent), schema), lambda blobs: _bucket_answers(blobs, length, entries), "repeats-answers")
    return answered.select("doc_ids", "sizes", "data", "state").mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
