"""Fill-in-middle transformation with succinct rank and select.

The ends of lines of a slice of texts are one packed bit vector with a directory of the ones before each block. The ones
of a text count its lines, and two selects give the bytes where prefix and middle end; a second vector over the first
bytes of characters turns bytes into code points. Texts of a slice are handled at once by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, slices

SENTINELS = ("<P>", "<S>", "<M>")
_WORDS = 8  # words of 64 bits in a block


class Bits:
    """Packed bits with the ones before each block of 512; rank and select for arrays of positions."""

    def __init__(self, bits: np.ndarray):
        room = np.zeros((len(bits) // (64 * _WORDS) + 1) * 64 * _WORDS, bool)
        room[: len(bits)] = bits
        self.words = np.packbits(room, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        at = np.asarray(at, np.int64)
        word, block = at >> 6, (at >> 6) // _WORDS
        out = self.before[block].copy()
        for j in range(_WORDS):
            here = block * _WORDS + j
            out += np.where(here < word, np.bitwise_count(self.words[here]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, k from 1 to the number of ones."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="left") - 1
        left, word = k - self.before[block], block * _WORDS
        for _ in range(_WORDS - 1):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            go = left > ones
            left, word = np.where(go, left - ones, left), word + go
        rest, at = self.words[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left > ones
            left, at = np.where(go, left - ones, left), at + go * width
            rest = np.where(go, rest >> np.uint64(width), rest)
        return word * 64 + at


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a line ends with each byte: at line feeds, and at the last byte of a text."""
    bits = data == 10
    bits[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return bits


def cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: lines n, byte after the smaller and after the larger of one % (n + 1) and two % (n + 1) lines, and the code points up to each."""
    ends = Bits(line_ends(data, offsets))
    begin = ends.rank(offsets)
    n = np.diff(begin)
    points = Bits((data & 0xC0) != 0x80)
    first = points.rank(offsets[:-1])
    found = []
    for units in (np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))):
        cut, some = offsets[:-1].copy(), units > 0
        cut[some] = ends.select(begin[:-1][some] + units[some]) + 1
        found += [cut, points.rank(cut) - first]
    return n, found[0], found[2], found[1], found[3]


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Sentinels in bytes. Each begins with a character that none has elsewhere, so joined parts hold no other one."""
    if len(set(sentinels)) != 3 or any(not s or s[0] in "".join(t[1:] for t in sentinels) for s in sentinels):
        raise ValueError("sentinels must differ and begin with a character that stands nowhere else in them")
    return tuple(s.encode() for s in sentinels)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row for each row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    A text (null: empty) has n lines, each with its line feed. Numbers h1 to h4 are the first four groups of 8 digits of the
    SHA-256 of ``seed:doc_id`` (nothing after the colon for a null id). The prefix ends after the smaller of h1 and h2
    modulo n + 1 lines, the middle after the larger. form is plain for empty texts, texts that hold a sentinel, and where
    h3 % 100 >= rate; else spm where h4 % 100 < spm_rate, else psm. prefix_chars and middle_chars count code points, null
    if plain. Repeated rows give repeated results; other columns are not read; an empty table gives no rows. No text is
    cut short, and a text longer than a slice is a slice of its own.
    """
    p, s, m = _checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("long").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for part, data, off in slices(batch):
                h = [part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
                n, a, b, to_a, to_b = cuts(data, off, h[0], h[1])
                raw, forms, outputs = data.tobytes(), [], []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if lo == hi or h[2][i] % 100 >= rate or any(raw.find(x, lo, hi) >= 0 for x in (p, s, m)):
                        forms.append("plain")
                        outputs.append(raw[lo:hi])
                        continue
                    prefix, middle, suffix = raw[lo : a[i]], raw[a[i] : b[i]], raw[b[i] : hi]
                    spm = h[3][i] % 100 < spm_rate
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(to_a, pa.int64(), mask=plain), pa.array(to_b - to_a, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).view(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone: the parts between the sentinels in the order prefix, middle, suffix."""
    _checked(sentinels)
    p, s, m = sentinels

    def part(after: Column, size: int, until: Column | None = None) -> Column:
        begin = after + size
        return F.substr(output, begin, until - begin) if until is not None else F.substr(output, begin)

    at_s, at_p, at_m = (F.locate(x, output).cast("int") for x in (s, p, m))
    middle, one = part(at_m, len(m)), F.lit(1)
    psm = F.concat(part(one, len(p), at_s), middle, part(at_s, len(s), at_m))
    spm = F.concat(part(at_p, len(p), at_m), middle, part(one, len(s), at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
