"""Figures of a column of texts as arrays, and their support by the figures of other texts of the same row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .mentions import REL_TOL, Figure, Mention, figures, figures_of, form

#: Plain texts of a form from which on arrays are faster than one text after the other; pairs of figures compared at once.
LEAST, PAIRS = 16, 1 << 20


@dataclass
class Figures:
    """Figures in the order of their texts: begin has the place of the first one of each text, and their number at the end.

    kinds has what mentions say, by the numbers in kind. A figure's words are those of its Figure in odd, or those around its digits.
    """

    begin: np.ndarray
    value: np.ndarray
    mantissa: np.ndarray
    kind: np.ndarray
    kinds: list[tuple[Mention, str, str]]
    span: np.ndarray
    data: bytes
    odd: dict[int, Figure]

    def says(self) -> tuple[np.ndarray, ...]:
        """Arrays of unscaled, percent, labelled, temporal and the currency as a number, 0 for none."""
        said = [m for m, _, _ in self.kinds]
        code = {None: 0, "USD": 1, "EUR": 2, "GBP": 3}
        columns = [m.scale == 1 for m in said], [m.percent for m in said], [m.labelled for m in said], [m.temporal for m in said]
        return *(np.array(c, bool)[self.kind] for c in columns), np.array([code[m.currency] for m in said], np.int8)[self.kind]

    def text(self, i: int) -> str:
        if i in self.odd:
            return self.odd[i].text
        _, before, after = self.kinds[self.kind[i]]
        return before + self.data[self.span[i, 0] : self.span[i, 1]].decode() + after

    def signed(self, i: int) -> float:
        return -float(self.value[i]) if i in self.odd and self.odd[i].negative else float(self.value[i])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the numbers d+ or d+.d+ in bytes of texts: text, begin and end, value, and whether the text is left to the scalar way (years, many digits)."""
    digit = (data >= 48) & (data <= 57)
    at = np.flatnonzero(digit)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, np.zeros((0, 2), np.int64), np.zeros(0), none
    owner = np.searchsorted(offsets, at, side="right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(first)
    length = np.diff(np.append(place, len(at)))
    start, own = at[place], owner[place]
    weight = 10 ** np.minimum(np.repeat(length, length) - 1 - (np.arange(len(at)) - np.repeat(place, length)), 18)
    whole = np.add.reduceat((data[at].astype(np.int64) - 48) * weight, place)
    # a run of digits behind a stop and a digit is the fraction of the run before
    part = np.zeros(len(place), bool)
    part[1:] = (own[1:] == own[:-1]) & (start[1:] == start[:-1] + length[:-1] + 1) & (data[start[1:] - 1] == 46)
    head = np.flatnonzero(~part)
    has = np.append(part[1:], False)[head]
    tail = np.minimum(head + 1, len(place) - 1)
    places = np.where(has, length[tail], 0)
    long = length[head] + places > 15
    k = np.where(long, 0, places)
    value = (whole[head] * 10**k + np.where(has & ~long, whole[tail], 0)) / (10**k).astype(np.float64)
    odd = long | (~has & (length[head] == 4) & np.isin(whole[head] // 100, (19, 20)))
    end = np.where(has, start[tail] + length[tail], start[head] + length[head])
    return own[head], np.stack([start[head], end], 1), value, own[head][odd]


def of_texts(texts: pa.Array) -> Figures:
    """Figures of texts; a null text has none."""
    column = texts.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return _joined(0, [], [], {}, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    shapes = pc.replace_substring_regex(column, "[0-9]+", "0").dictionary_encode()
    codes = shapes.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(shapes.dictionary))
    forms = {c: f for c in np.flatnonzero(counts >= LEAST).tolist() if (f := form(shapes.dictionary[c].as_py())) is not None}
    known = np.isin(codes, list(forms))
    owner, span, value, odd = _tokens(data, offsets)
    known[odd] = False
    begin = np.searchsorted(owner, np.arange(n))
    parts, kinds = [], []
    for c, numbers in forms.items():
        rows = np.flatnonzero(known & (codes == c))
        if len(numbers) and len(rows):
            token = (begin[rows][:, None] + np.array([k for k, *_ in numbers])[None, :]).ravel()
            scale = np.tile(np.array([m.scale for _, m, _, _ in numbers]), len(rows))
            parts.append((np.repeat(rows, len(numbers)), value[token] * scale, value[token], np.tile(np.arange(len(numbers)) + len(kinds), len(rows)), span[token]))
            kinds += [(m, before, after) for _, m, before, after in numbers]
    left = np.flatnonzero(~known)
    other = {int(i): f for i, t in zip(left, column.take(pa.array(left)).to_pylist(), strict=True) if (f := figures(t))}
    return _joined(n, parts, kinds, other, data.tobytes())


def of_mentions(rows: list[list[dict] | None]) -> Figures:
    """Figures of arrays of mentions."""
    return _joined(len(rows), [], [], {i: f for i, r in enumerate(rows) if (f := figures_of([Mention(**m) for m in r or ()]))}, b"")


def _joined(n: int, parts: list[tuple], kinds: list, other: dict[int, list[Figure]], data: bytes) -> Figures:
    """Figures of arrays and of single texts in the order of the texts."""
    single = [(i, f) for i, fs in other.items() for f in fs]
    if single:
        rows, values, mantissas = (np.array(x, t) for x, t in zip(zip(*((i, f.value, f.mantissa) for i, f in single), strict=True), (np.int64, float, float), strict=True))
        # mentions that say the same share a kind
        keys: dict = {}
        numbers = np.array([keys.setdefault((f.says.scale == 1, f.says.percent, f.says.labelled, f.says.temporal, f.says.currency), (len(keys), f.says))[0] for _, f in single], np.int64)
        parts = [*parts, (rows, values, mantissas, numbers + len(kinds), np.full((len(rows), 2), -1))]
        kinds = [*kinds, *((m, "", "") for _, m in keys.values())]
    if not parts:
        return Figures(np.zeros(n + 1, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), [], np.zeros((0, 2), np.int64), data, {})
    owner, value, mantissa, kind, span = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, span = owner[order], span[order]
    odd = dict(zip(np.flatnonzero(span[:, 0] < 0).tolist(), (f for _, f in sorted(single, key=lambda x: x[0])), strict=True))
    return Figures(np.searchsorted(owner, np.arange(n + 1)), value[order], mantissa[order], kind[order], kinds, span, data, odd)


def unbacked(claims: Figures, evidence: Figures, row: np.ndarray) -> np.ndarray:
    """Places of the claims that no evidence backs, years of dates and periods aside; row has the evidence's text for each text of claims."""
    n = len(claims.value)
    text = np.repeat(np.arange(len(row)), np.diff(claims.begin))
    low = evidence.begin[row[text]]
    length = evidence.begin[row[text] + 1] - low
    ok = np.zeros(n, bool)
    c_plain, c_percent, c_label, c_time, c_code = claims.says() if n else (np.zeros(0, bool),) * 5
    if n and len(evidence.value):
        e_plain, e_percent, e_label, _, e_code = evidence.says()
        e_bare, c_bare = e_plain & (e_code == 0) & ~e_label, c_plain & (c_code == 0) & ~c_label
        near = lambda a, b: np.abs(a - b) <= REL_TOL * np.maximum(a, b)
        some = np.flatnonzero(length > 0)
        chunk = np.cumsum(length[some]) // PAIRS
        for these in np.split(some, np.flatnonzero(np.diff(chunk)) + 1) if len(some) else []:
            sizes = length[these]
            first = np.cumsum(sizes) - sizes
            c = np.repeat(these, sizes)
            e = np.repeat(low[these] - first, sizes) + np.arange(len(c))
            same = near(evidence.value[e], claims.value[c]) | (c_plain[c] | e_plain[e]) & near(evidence.mantissa[e], claims.mantissa[c])
            units = np.where(c_percent[c] != e_percent[e], np.where(c_percent[c], e_bare[e], c_bare[c]), (c_code[c] == 0) | (e_code[e] == 0) | (c_code[c] == e_code[e]))
            ok[these] = np.logical_or.reduceat(same & units, first)
    return np.flatnonzero(~ok & ~c_time)
