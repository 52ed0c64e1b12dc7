r"""Numbers in a text: a span grammar in regular expressions, ranges and years.

Regular expressions read \d, \s and case as ASCII and letters before a number as Unicode. A search begins only at the characters that
can open a number, and words are tried only if the text has a word of magnitude or percent: most texts need no more.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

# The words, signs and contexts of the number grammar.
SCALES = {
    "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mn": 1e6, "mm": 1e6,
    "billion": 1e9, "b": 1e9, "bn": 1e9, "trillion": 1e12, "t": 1e12, "tn": 1e12,
}
CURRENCIES = {"$": "USD", "US$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP"}
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SMALL = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
MAGNITUDES = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
YEAR_BEFORE = (
    "in|since|during|through|thru|until|till|before|after|between|for|early|late|mid|end|start|fiscal|calendar|year|fy|cy|h[12]|q[1-4]|edition|survey|report|review|plan|strategy|outlook|index|"
    "barometer|tracker|study|wave|deck|budget|forecast|season|census|cohort"
)
YEAR_AFTER = (
    "edition|survey|report|review|study|wave|season|fiscal|financials?|results|budget|plan|strategy|outlook|forecast|guidance|baseline|cohort|campaign|launch|catalog(?:ue)?|collection|census|annual|"
    "q[1-4]|h[12]|deck|update|tracker|index|barometer|benchmark|panel|programme|program"
)
COUNT_NOUNS = (
    "respondents?|people|persons?|users?|customers?|clients?|units?|stores?|employees?|staff|orders?|shoppers?|buyers?|consumers?|participants?|interviewees?|households?|companies|firms?|brands?|"
    "products?|items?|visits?|visitors?|sessions?|downloads?|installs?|transactions?|accounts?|members?|subscribers?|patients?|students?|votes?|sites?|locations?|outlets?|countries|markets?|"
    "times|years?|months?|weeks?|days?|hours?|x|bps?|pp|pts?"
)
COUNT_COLUMNS = "n|count|counts|num|number|sample|base|population|headcount|qty|quantity"
PERCENT_CUES = "%|percent|pct|share|rate|margin|ratio|proportion"
MARKERS = r"\[\[[^\[\]]*\]\]|\[[ER][0-9]{1,4}\]"
ORDINALS = r"[ \t]*(?:[-*+•][ \t]+)?\d{1,3}[.)][ \t]+"
POINTS_AFTER = r"[ \t]*(?:percentage[ \t-]+points?|points?|pts?|ppts?|pp)"
REL_TOL = 1e-6

_ALL = lambda words: "|".join(sorted(words, key=len, reverse=True))
#: Numeric characters that are no digits, as the sign of a half: to Python they are of the characters of words, here they are not.
_OTHER = "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))
#: Begin and end of a word.
_OPEN, _CLOSE = rf"(?:(?<!(?u:\w))|(?<=[{_OTHER}]))", rf"(?:(?!(?u:\w))|(?=[{_OTHER}]))"
_CARDINAL, _MAGNITUDE, _DIGIT = _ALL(SMALL), _ALL(MAGNITUDES), _ALL(UNITS[:10])
_NUM = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_CUR = r"US\$|[$€£]|(?:USD|EUR|GBP)[ \t]?"
_SIGN = r"(?<!(?u:[^\W_]))[-−](?=(?:US\$|[$€£])?\d)"
# the characters looked ahead for spare most numbers the words
_TAIL = r"(?:(?=[ \t]?[kKmMbBtT])(?:[ \t]?((?i:thousand|million|billion|trillion)|bn|mn|mm|tn)|([kKmMbBtT])))?([x×])?((?=[bp])(?:bps|bp|ppts|ppt|pp|pts|pt))?(?:(?=[ \t]?[%p])[ \t]?(%|percent(?!age)|per[ \t]cent|pct))?(?![A-Za-z0-9_]|[.,]\d)"
_FREE = rf"(?<!(?u:\w))(?<!\d[.,])(?:(?<!(?u:[^\W\d_])[-/])|(?<=[{_OTHER}][-/]))"
#: Groups: sign before a currency, currency, sign, digits, scale, its letter, times, points, percent.
_DIGITS = rf"(?:({_SIGN})?({_CUR})|({_SIGN})|{_FREE})({_NUM}){_TAIL}"
_SEP, _ITEM, _PCT = r"(?:[ \t]+and)?[ \t-]+", rf"(?:point(?:[ \t]+(?:{_DIGIT}))+|{_CARDINAL})", r"[ \t]+(?:percent(?!age)|per[ \t]cent)"
_SPELLED = rf"{_OPEN}(?i:(?:{_CARDINAL})(?:{_SEP}{_ITEM})*(?:{_SEP}(?:{_MAGNITUDE})(?:{_SEP}(?:{_ITEM}|{_MAGNITUDE}))*(?:{_PCT})?|{_PCT})){_CLOSE}"
_SPELLED_BARE = rf"{_OPEN}(?i:(?:{_CARDINAL})(?:{_SEP}(?:{_ITEM}|{_MAGNITUDE}))*(?:{_PCT})?){_CLOSE}"
_ENDS = "\n\r\x85\u2028\u2029"
_SPAN_JOINTS = ("to", "-", "–", "—")
_JOINTS = ("", "and", "or", *_SPAN_JOINTS)

_re = lambda p, flags=0: re.compile(p, re.ASCII | flags)
_opener, _digits, _spelled, _bare = _re(r"[-−$€£UEG\d]"), _re(_DIGITS), _re(rf"{_SPELLED}|{_DIGITS}"), _re(rf"{_SPELLED_BARE}|{_DIGITS}")
_markers, _ordinal, _ordinals = _re(MARKERS), _re(ORDINALS), _re(rf"(?:\A|(?<=[{_ENDS}])){ORDINALS}")
_plain, _run, _token = _re(r"[A-Za-z0-9 .;$€£%]*\Z"), _re(r"\d+"), _re(r"\d+(?:\.\d+)?")
_line_end = _re(f"[{_ENDS}]")
_word, _follows = _re("[a-z]+"), _re(r"[ \t]*([A-Za-z]+)")
_label = _re(r"(?<![A-Za-z0-9_])([A-Za-z][^:=;|\n]{0,40}?)[ \t]*[:=][ \t]*\Z")
_percent_cues, _counting = _re(PERCENT_CUES, re.I), _re(rf"(?<![a-z0-9])(?:{COUNT_COLUMNS}|{COUNT_NOUNS})(?![a-z0-9])", re.I)
_code, _long, _abbr, _pct = _re("(usd|eur|gbp)"), _re(r"(?<![a-z0-9])(thousand|million|billion)s?(?![a-z0-9])"), _re(r"(?<![a-z0-9])(mn|bn)(?![a-z0-9])"), _re(r"(?<![a-z0-9])(?:pct|percent|perc)(?![a-z0-9])")
_short = _re(r"(?<![a-z0-9])([kmb])(?:usd|eur|gbp)"), _re(r"(?:usd|eur|gbp)[^a-z0-9]?([kmb])(?![a-z0-9])")
_day_after, _day_before, _month_before = _re(r"-\d{1,2}-\d{1,2}(?![\d-])"), _re(r"(?<![\d/])\d{1,2}/\d{1,2}/\Z"), _re(rf"{_OPEN}(?:{MONTHS})\.?[ \t]+\d{{1,2}}(?:st|nd|rd|th)?,?[ \t]+\Z", re.I)
_placed_before, _placed_after = _re(rf"(?:{_OPEN}(?:{YEAR_BEFORE}|{MONTHS})\.?,?|\()[ \t]*\Z", re.I), _re(rf"[ \t]*(?i:['’]s{_CLOSE}|\)|(?:{YEAR_AFTER}){_CLOSE})")
_bps, _points = _re(r"\d[ \t]?bps?\Z"), _re(r"\d[ \t]?(?:pp|ppts?|pts?)\Z")
_noun, _points_after = _re(rf"(?:{COUNT_NOUNS})\Z"), _re(rf"(?i:{POINTS_AFTER}{_CLOSE})")
_other_after, _usd_after = _re(rf"(?i:[ \t]*(?:EUR|GBP|JPY|CNY|INR|CHF|euros?|pounds?|yen|yuan|rupees?|francs?){_CLOSE})"), _re(rf"(?i:[ \t]*(?:USD|US[ \t]+dollars?|dollars?|bucks){_CLOSE})")
#: Words with which what follows a number tells its kind.
_TELLING = frozenset("percentage point points pt pts ppt ppts pp eur gbp jpy cny inr chf euro euros pound pounds yen yuan rupee rupees franc francs usd us dollar dollars bucks".split())

#: Fields of a mention and their types.
FIELDS = {"text": "string", "digits": "string", "mantissa": "double", "value": "double", "percent": "boolean", "currency": "string", "scale": "double", "labelled": "boolean", "temporal": "boolean", "kind": "string", "before": "string", "after": "string"}


class Mention(NamedTuple):
    text: str
    digits: str | None
    mantissa: float | None
    value: float | None
    percent: bool
    currency: str | None
    scale: float
    labelled: bool
    temporal: bool
    kind: str
    before: str
    after: str


class _Whole(NamedTuple):
    total: float
    current: float
    last: float


_new = tuple.__new__  # a mention by its fields in order


def _whole(words: list[str]) -> _Whole:
    total, current, last = 0.0, 0.0, 1.0
    for w in words:
        one = current or 1.0
        if w in SMALL:
            current += SMALL[w]
        elif w == "hundred":
            current = one * 100
        elif w in MAGNITUDES:
            total, current, last = total + one * MAGNITUDES[w], 0.0, MAGNITUDES[w]
    return _Whole(total, current, last)


def _in_words(span: str) -> tuple[float, float]:
    """Mantissa and scale of a cardinal in words: "nine hundred million" is 900 and 1e6, "one point two billion" 1.2 and 1e9."""
    words = _word.findall(span.lower())
    if "point" in words:
        cut = words.index("point")
        head, tail = _whole(words[:cut]), words[cut + 1 :]
        factor = 1.0
        for w in tail:
            factor *= MAGNITUDES.get(w, 1.0)
        return float(f"{int(head.total + head.current)}.{''.join(str(SMALL[w]) for w in tail if SMALL.get(w, 10) < 10)}"), factor
    state = _whole(words)
    if state.total > 0 and state.current == 0:
        return state.total / state.last, state.last
    return state.total + state.current, 1.0


def _first(pattern: re.Pattern, text: str) -> str | None:
    found = pattern.search(text)
    return found[1] if found else None


def _label_units(label: str) -> tuple[float, str | None, bool]:
    """Scale, currency and percent that the name of a column tells: revenue_musd is millions of USD, growth_pct is percent."""
    low = label.lower()
    code = _first(_code, low)
    word = _first(_short[0], low) or _first(_short[1], low) or _first(_long, low) or _first(_abbr, low)
    return SCALES.get(word, 1.0), code and code.upper(), bool(_pct.search(low))


def _spans(text: str, bare: bool) -> list[re.Match]:
    """Matches of the numbers of a text; the group of digits is None for those in words."""
    low = text.lower()
    if bare or "cent" in low or "hundred" in low or "thousand" in low or "illion" in low:
        return list((_bare if bare else _spelled).finditer(text))
    found, at = [], 0
    while m := _opener.search(text, at):
        at = m.start()
        if span := _digits.match(text, at):
            found.append(span)
            at = span.end()
        else:
            at += 1
    return found


@lru_cache(4096)
def _is_noun(word: str) -> bool:
    return bool(_noun.match(word))


def _kind(span: str, percent: bool, currency: str | None, after: str, telling: bool) -> str:
    """telling: whether the word after the number may tell its kind."""
    last = span[-1]
    if last in "ps" and _bps.search(span):
        return "bps"
    if last in "pst" and _points.search(span):
        return "points"
    if last in "x×":
        return "multiple"
    if percent:
        return "percent"
    if telling and _points_after.match(after):
        return "points"
    if currency is not None and currency != "USD" or telling and _other_after.match(after):
        return "other_currency"
    return "currency" if currency is not None or telling and _usd_after.match(after) else "plain"


def _temporal(before: str, after: str) -> bool:
    """Whether what stands around a year makes it one of a date or period."""
    if _day_after.match(after) and not (before and before[-1] in "0123456789-") or _day_before.search(before) and not (after and after[0] in "0123456789/"):
        return True
    return bool(_month_before.search(before) or _placed_before.search(before) or _placed_after.match(after))


def _joint(gap: str) -> str | None:
    """The word or sign that joins two numbers, "" if nothing stands between them, else None."""
    if len(gap) > 64 and len(gap.strip()) > 4:
        return None
    if (mark := gap.strip(" ")) in (",", "/"):
        return mark
    if gap and gap[-1] in _ENDS:
        gap = gap[: -2 if gap.endswith("\r\n") else -1]
    word = gap.strip(" \t").lower()
    return word if word in _JOINTS and (word or not gap) else None


def _one(match: re.Match, before: str, after: str) -> tuple[Mention, bool]:
    """A number with what its own text and the text around it say, and whether it may be a year."""
    span, (minus, code, sign, digits, scaled, letter, times, points, share) = match[0], match.groups()
    follows = _follows.match(after)
    word = follows[1].lower() if follows else ""
    label, currency, unit, words = "", None, False, digits is None
    if before and before[-1] in ":= \t" and before.rstrip(" \t")[-1:] in (":", "="):
        label = _first(_label, before) or ""
    if words:
        mantissa, scale = _in_words(span)
        digits = re.sub(r"\.?0+\Z", "", f"{Decimal(repr(mantissa)).quantize(Decimal('1e-9'), ROUND_HALF_UP):f}")
        percent = span[-7:].lower() == "percent" or span[-8:-4].lower() in ("per ", "per\t") and span[-4:].lower() == "cent"
    else:
        digits = digits.replace(",", "")
        mantissa = -float(digits) if minus or sign else float(digits)
        scale = SCALES[(scaled or letter).lower()] if scaled or letter else 1.0
        currency = CURRENCIES.get(code.strip(" ")) if code else None
        unit, percent = times is not None or points is not None, share is not None
    own, counted = currency, False
    if label:
        counted = not _percent_cues.search(label) and bool(_counting.search(label))
        if not (words or currency or percent or unit) and scale == 1:
            scale, currency, percent = _label_units(label)
    labelled = unit or counted or word != "" and _is_noun(word)
    year = len(span) == 4 and not labelled and span[:2] in ("19", "20") and span.isdecimal()
    # the currency that a label gives counts for the number, not for its kind
    kind = _kind(span, percent, own, after, word in _TELLING)
    return _new(Mention, (span.strip(" "), digits, mantissa, mantissa * scale, percent, currency, scale, labelled, year and _temporal(before, after), kind, before, after)), year


def read(text: str | None, bare: bool = False, context: int = 64) -> list[Mention]:
    """The number mentions of a text; figures.with_mentions tells what they hold."""
    if not text:
        return []
    if "\x01" in text or "\x02" in text:
        text = text.replace("\x01", "").replace("\x02", "")
    if "[" in text:
        text = _markers.sub(" ", text)
    if _line_end.search(text):
        text = _ordinals.sub("", text)
    elif m := _ordinal.match(text):
        text = text[m.end() :]
    spans = _spans(text, bare)
    n, out, years, joints = len(spans), [], [], []
    at = [m.start() for m in spans]
    for i, m in enumerate(spans):
        # the text around a number goes no further than the fourth number from it
        a, b = at[i], m.end()
        low, high = max(at[i - 4] if i >= 4 else 0, a - context), b + context
        mention, year = _one(m, text[low:a], text[b : min(high, at[i + 4]) if i + 4 < n else high])
        out.append(mention)
        years.append(year)
        joints.append(_joint(text[b : at[i + 1] if i + 1 < n else len(text)]))
    if any(j is not None for j in joints[:-1]):
        out, years = _in_ranges(out, years, joints)
    return _in_runs(out, years, joints) if any(years) else out


def _in_ranges(found: list[Mention], years: list[bool], joints: list[str | None]) -> tuple[list[Mention], list[bool]]:
    """Numbers with the percent or scale that the second number of a range gives the first, and the currency that the first gives the second."""
    out, still = [], []
    for i, m in enumerate(found):
        low, high = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        scale, currency, kind, shared = m.scale, m.currency, m.kind, False
        if high:
            shared = joints[i] in _JOINTS and high.percent and scale == 1 and currency is None and not m.percent
            if joints[i] in _SPAN_JOINTS and scale == 1 and not (m.percent or m.labelled or m.temporal) and abs(m.mantissa) < 1000 and abs(m.mantissa) <= abs(high.mantissa) and high.scale > 1:
                scale = high.scale
        if low and joints[i - 1] in _SPAN_JOINTS and currency is None and not m.percent and not m.labelled and low.currency is not None:
            currency = low.currency
            kind = "currency" if currency == "USD" else "other_currency"
        kind = "percent" if shared else kind
        still.append(years[i] and scale == 1 and currency is None and not m.percent and not shared)
        out.append(m._replace(value=m.mantissa * scale, percent=m.percent or shared, currency=currency, scale=scale, labelled=m.labelled and not shared, kind=kind))
    return out, still


def _in_runs(found: list[Mention], years: list[bool], joints: list[str | None]) -> list[Mention]:
    """Years joined by and, to, a dash, a comma or a slash are one run; a run is temporal as a whole."""
    runs, timed, run = [], set(), 0
    for i, m in enumerate(found):
        run += not (i and joints[i - 1] is not None and years[i] and years[i - 1])
        runs.append(run)
        if m.temporal:
            timed.add(run)
    return [m._replace(temporal=m.temporal or years[i] and runs[i] in timed) for i, m in enumerate(found)]


class Figure(NamedTuple):
    """A number for the comparison of texts. value and mantissa are without signs; says has its scale, percent, currency and label."""

    value: float
    mantissa: float
    unscaled: bool
    says: Mention
    negative: bool
    before: str
    digits: str
    after: str

    @property
    def text(self) -> str:
        return self.before + self.digits + self.after


@lru_cache(4096)
def form(shape: str) -> list[tuple[int, Mention, str, str]] | None:
    """Place among the tokens, mention, and text beside the digits of the numbers of a text whose runs of digits are one zero each.

    None where lengths or values of digits may change more than the values: texts that are not plain, ordinals, words, versions, numbers
    that are joined.
    """
    if not _plain.match(shape) or "0.0.0" in shape:
        return None
    found = read(shape)
    if _ordinal.match(shape) or any(m.digits.strip("0.") for m in found):
        return None
    spans, tokens = _spans(shape, False), [m.start() for m in _token.finditer(shape)]
    if any(_joint(shape[a.end() : b.start()]) is not None for a, b in pairwise(spans)):
        return None
    return [(tokens.index(s.start(4)), m, shape[s.start() : s.start(4)].lstrip(" "), shape[s.end(4) : s.end()].rstrip(" ")) for s, m in zip(spans, found, strict=True)]


def figures(text: str | None) -> list[Figure]:
    """The numbers of a text, as read() finds them.

    In a plain text (letters, digits, blanks, stops, semicolons, signs of currency and percent) no rule looks at how many digits
    stand in a row or which, but those of ordinals, words, ranges and years. So plain texts that differ in digits only are read once,
    and just their digits are put in.
    """
    if not text:
        return []
    if _plain.match(text) and (numbers := form(_run.sub("0", text))) is not None:
        tokens, out = _token.findall(text), []
        for k, says, before, after in numbers:
            digits = tokens[k]
            if len(digits) == 4 and digits[:2] in ("19", "20"):
                break
            mantissa = float(digits)
            out.append(_new(Figure, (mantissa * says.scale, mantissa, says.scale == 1, says, False, before, digits, after)))
        else:
            return out
    return figures_of(read(text))


def figures_of(mentions: list[Mention]) -> list[Figure]:
    return [Figure(abs(m.value), abs(m.mantissa), m.scale == 1, m, m.value < 0, "", m.text, "") for m in mentions]
