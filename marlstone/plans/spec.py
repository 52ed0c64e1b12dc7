"""Requests of the analytics engine: closed enums, validated before any plan is built. No SQL text is accepted."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

OPERATORS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "between", "is_null", "not_null")
FUNCTIONS = ("count", "count_distinct", "sum", "mean", "median", "min", "max", "share")
MAX_FILTERS, MAX_VALUES, MAX_METRICS, MAX_GROUPS_BY, MAX_GROUPS, MAX_COLUMNS, MAX_ROWS = 5, 20, 4, 2, 50, 8, 20
# Words of a column name that tell its unit, in the order in which units are looked for, and its scale.
UNIT_WORDS = {
    "percent": {"pct", "percent", "percentage"},
    "currency_usd": {"usd"},
    "rating": {"rating", "nps", "stars", "score"},
    "ratio": {"ratio"},
    "count": {"count", "units", "orders", "sessions", "qty", "quantity", "returns", "respondents"},
}
SCALE_WORDS = {
    "k": "thousand", "thousand": "thousand", "thousands": "thousand", "m": "million", "mn": "million", "million": "million", "millions": "million",
    "bn": "billion", "billion": "billion", "billions": "billion",
}
SCALED_UNITS = ("currency_usd", "count", "number")
UNITS = ("date", "text", *UNIT_WORDS, "number")
EXACT = frozenset({"count", "count_distinct", "min", "max"})


def _shown() -> dict[tuple[str, str], tuple[str, bool, int | None, int | None]]:
    """For each function and unit of its column: unit of the result, whether the column's scale holds, and places of whole and of broken sums (None: exact)."""
    places = {"percent": 1, "currency_usd": 2, "ratio": 3}
    table = {}
    for unit in UNITS:
        for fn in FUNCTIONS:
            result, scaled = {"count": ("count", False), "count_distinct": ("count", False), "share": ("percent", False)}.get(fn, (unit, True))
            if (fn, unit) in (("mean", "count"), ("median", "count")):  # an average of counts is no count
                result = "number"
            broken = None if fn in EXACT else places.get(result, 2)
            table[fn, unit] = result, scaled, broken if fn != "sum" or result in places else None, broken
    return table


SHOWN = _shown()


class SpecError(ValueError):
    """A request that names what is not there or is not allowed."""


@dataclass(frozen=True)
class ColumnInfo:
    """A dataset column: kind numeric, date, categorical or text; its levels where their list is complete."""

    name: str
    kind: str
    levels: tuple[str, ...] | None = None

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.name.lower())

    @property
    def unit(self) -> str:
        if self.kind != "numeric":
            return "date" if self.kind == "date" else "text"
        return next((u for u, known in UNIT_WORDS.items() if known.intersection(self.words)), "number")

    @property
    def scale(self) -> str:
        """Scale that the name tells; its last word wins. Only amounts and counts have one."""
        told = "" if self.unit not in SCALED_UNITS else reduce(lambda scale, word: SCALE_WORDS.get(word, scale), self.words, "")
        return told


@dataclass(frozen=True)
class Filter:
    column: ColumnInfo
    op: str
    values: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Metric:
    fn: str
    column: ColumnInfo | None = None
    condition: Filter | None = None

    @property
    def key(self) -> str:
        return self.fn if self.column is None else f"{self.fn}_{self.column.name}"

    @property
    def _rule(self) -> tuple[str, bool, int | None, int | None]:
        return SHOWN[self.fn, self.column.unit if self.column else "number"]

    @property
    def unit(self) -> str:
        return self._rule[0]

    @property
    def scale(self) -> str:
        return self.column.scale if self.column and self._rule[1] else ""

    def places(self, integral: bool) -> int | None:
        """Decimal places of the shown value; None is exact."""
        return self._rule[2 if integral else 3]


@dataclass(frozen=True)
class Aggregate:
    metrics: tuple[Metric, ...]
    filters: tuple[Filter, ...] = ()
    group_by: tuple[ColumnInfo, ...] = ()
    order_by: str = "group"
    order_metric: int = 0
    descending: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Compare:
    metric: Metric
    column: ColumnInfo
    a: Any
    b: Any
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Listing:
    columns: tuple[ColumnInfo, ...]
    filters: tuple[Filter, ...] = ()
    order_by: ColumnInfo | None = None
    descending: bool = False
    limit: int = MAX_ROWS


@dataclass(frozen=True)
class Schema:
    """Columns of a dataset, and the builders that check requests against them."""

    columns: dict[str, ColumnInfo] = field(default_factory=dict)

    @classmethod
    def of(cls, **kinds: str) -> Schema:
        return cls({k: ColumnInfo(k, v) for k, v in kinds.items()})

    def column(self, name: str) -> ColumnInfo:
        if name not in self.columns:
            raise SpecError(f"no column {name!r}; there are {', '.join(self.columns)}")
        return self.columns[name]

    def filter(self, spec: dict) -> Filter:
        self._only(spec, {"column", "op", "value", "values"})
        col, op = self.column(spec["column"]), spec["op"]
        if op not in OPERATORS:
            raise SpecError(f"no operator {op!r}")
        values = list(spec["values"]) if "values" in spec else [spec["value"]] if "value" in spec else []
        least, most = {"is_null": (0, 0), "not_null": (0, 0), "between": (2, 2), "in": (1, MAX_VALUES), "not_in": (1, MAX_VALUES)}.get(op, (1, 1))
        if not least <= len(values) <= most:
            raise SpecError(f"{op} takes {least} to {most} values")
        ordered = op in ("gt", "gte", "lt", "lte", "between")
        if ordered and col.kind not in ("numeric", "date"):
            raise SpecError(f"{op} needs a numeric or date column")
        typed = tuple(self._operand(col, v, ordered) for v in values)
        if op == "between" and typed[0] > typed[1]:
            raise SpecError("between needs its lower value first")
        return Filter(col, op, typed)

    def _operand(self, col: ColumnInfo, value: Any, ordered: bool) -> Any:
        if col.kind == "numeric":
            try:
                got = Decimal(str(value))
            except InvalidOperation:
                raise SpecError(f"{value!r} is not a number") from None
            if not got.is_finite():
                raise SpecError("numbers must be finite")
            return got
        text = canonical_text(value)
        if col.kind == "date" and ordered:
            if not re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", text):
                raise SpecError(f"{text!r} is not YYYY-MM or YYYY-MM-DD")
            try:
                date.fromisoformat(text if len(text) == 10 else f"{text}-01")
            except ValueError:
                raise SpecError(f"{text!r} is not a date") from None
        if col.levels is not None and text not in col.levels:
            raise SpecError(f"{col.name} has no level {text!r}")
        return text

    def metric(self, spec: dict) -> Metric:
        self._only(spec, {"fn", "column", "condition", "label"})
        fn = spec["fn"]
        if fn not in FUNCTIONS:
            raise SpecError(f"no function {fn!r}")
        if fn == "share":
            if "condition" not in spec:
                raise SpecError("share needs a condition")
            cond = self.filter(spec["condition"])
            if cond.op in ("is_null", "not_null"):
                raise SpecError("share is over rows that have a value")
            return Metric(fn, cond.column, cond)
        if "condition" in spec:
            raise SpecError("only share has a condition")
        col = self.column(spec["column"]) if spec.get("column") else None
        if col is None and fn != "count":
            raise SpecError(f"{fn} needs a column")
        if fn in ("sum", "mean", "median") and col.kind != "numeric" or fn in ("min", "max") and col.kind not in ("numeric", "date"):
            raise SpecError(f"{fn} cannot read a {col.kind} column")
        return Metric(fn, col)

    def aggregate(self, spec: dict) -> Aggregate:
        self._only(spec, {"metrics", "filters", "group_by", "order_by", "order_metric", "descending", "limit"})
        metrics = tuple(self.metric(m) for m in spec["metrics"])
        group_by = tuple(self.column(c) for c in spec.get("group_by", ()))
        if not 1 <= len(metrics) <= MAX_METRICS or len(group_by) > MAX_GROUPS_BY or len(set(group_by)) < len(group_by):
            raise SpecError(f"1 to {MAX_METRICS} metrics and at most {MAX_GROUPS_BY} different group columns")
        order, at, limit = spec.get("order_by", "group"), spec.get("order_metric", 0), spec.get("limit")
        if order not in ("group", "value") or not 0 <= at < len(metrics) or limit is not None and not 1 <= limit <= MAX_GROUPS:
            raise SpecError("order or limit out of range")
        return Aggregate(metrics, self._filters(spec), group_by, order, at, bool(spec.get("descending")), limit)

    def compare(self, spec: dict) -> Compare:
        self._only(spec, {"metric", "compare_column", "group_a", "group_b", "filters"})
        col = self.column(spec["compare_column"])
        a, b = (self._operand(col, spec[k], False) for k in ("group_a", "group_b"))
        if a == b:
            raise SpecError("two different groups are compared")
        return Compare(self.metric(spec["metric"]), col, a, b, self._filters(spec))

    def listing(self, spec: dict) -> Listing:
        self._only(spec, {"filters", "columns", "order_by", "descending", "limit"})
        names = spec.get("columns") or list(self.columns)[:MAX_COLUMNS]
        if len(set(names)) < len(names) or len(names) > MAX_COLUMNS:
            raise SpecError(f"at most {MAX_COLUMNS} different columns")
        limit = spec.get("limit", MAX_ROWS)
        if not 1 <= limit <= MAX_ROWS:
            raise SpecError(f"limit is from 1 to {MAX_ROWS}")
        order = self.column(spec["order_by"]) if spec.get("order_by") else None
        return Listing(tuple(self.column(n) for n in names), self._filters(spec), order, bool(spec.get("descending")), limit)

    def _filters(self, spec: dict) -> tuple[Filter, ...]:
        given = spec.get("filters", ())
        if len(given) > MAX_FILTERS:
            raise SpecError(f"at most {MAX_FILTERS} filters")
        return tuple(self.filter(f) for f in given)

    @staticmethod
    def _only(spec: dict, known: set[str]) -> None:
        if more := set(spec) - known:
            raise SpecError(f"unknown fields: {', '.join(sorted(more))}")


def canonical_text(value: Any) -> str:
    """Text of an operand as functions.cells.canonical makes it of a cell."""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    text = str(value)
    return re.sub(r"\.$", "", re.sub(r"0+$", "", text)) if re.fullmatch(r"-?\d+\.\d+", text) else text


def request_key(tool: str, spec: dict) -> str:
    """One key for equivalent requests: canonical JSON, hashed."""
    return hashlib.sha256(json.dumps([tool, spec], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def dataset_id(text: str) -> tuple[str, int]:
    """Source code and sheet of an id such as ``SURV:1``."""
    m = re.fullmatch(r"([A-Z][A-Z0-9-]{0,31}):(\d{1,3})", text)
    if not m:
        raise SpecError(f"{text!r} is not CODE:sheet")
    return m[1], int(m[2])
