"""Column expressions for typed cells: null rules, canonical text, date periods, rounding and clipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric cells: 18 integer digits, so that sums of 10 ** 10 rows stay exact in 38 digits.
NUMBER = "decimal(28,10)"
#: Longest text that a result shows.
CLIP = 160


def present(c: Column) -> Column:
    """Text of a cell; blank and white-space text is null."""
    text = c.cast("string")
    return F.when(F.trim(text) != "", text)


def number(c: Column) -> Column:
    """Exact number of a cell; what is not a number, or not finite, is null."""
    return c.try_cast(NUMBER)


def canonical(c: Column) -> Column:
    """Text for equality: plain numbers lose trailing zeros, so 2023, "2023" and 2023.0 are one."""
    text = present(c)
    plain = text.rlike(r"^-?\d+\.\d+$")
    bare = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(plain, F.when(bare == "-0", "0").otherwise(bare)).otherwise(text)


def exact_text(c: Column) -> Column:
    """Decimal as plain text without trailing zeros."""
    text = c.cast("string")
    short = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(short.isin("-0", ""), "0").otherwise(short)


def half_even(c: Column, places: int | None) -> Column:
    """Number rounded half to even; places None keeps it exact. There is no negative zero."""
    value = (c if places is None else F.bround(c, places)).cast("double")
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def period_start(c: Column) -> Column:
    """First day of a cell YYYY-MM-DD or YYYY-MM; null for what is no real date."""
    text = present(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))


def period_end(c: Column) -> Column:
    """Last day of a cell YYYY-MM-DD or YYYY-MM."""
    return F.when(F.length(present(c)) == 7, F.last_day(period_start(c))).otherwise(period_start(c))


def clipped(c: Column, limit: int = CLIP) -> Column:
    """Text cut to ``limit`` characters, the last of which is an ellipsis."""
    text = c.cast("string")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def contains_literal(c: Column, part: str) -> Column:
    """Case-insensitive substring without patterns: % and _ stand for themselves."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def json_number(c: Column, path: str) -> Column:
    """Number at a JSON path; a value of another type, a text of digits too, reads as null."""
    value = F.try_variant_get(F.try_parse_json(c), path, "variant")
    return F.when(F.schema_of_variant(value).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def collapsed(c: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; 0 and 1 where n is 0."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
