"""English analysis for search: stop words and the Porter2 stemmer, as suffix automata over published rule tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

# The published English stop list of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# The rules of the Porter2 stemmer, in the order of its steps.
VOWELS = "aeiouy"
R1_PREFIXES = ("gener", "commun", "arsen")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


class Suffixes:
    """Automaton over reversed suffixes: the longest one that a word ends with, in one walk from its end."""

    def __init__(self, suffixes: Iterable[str]):
        self.root: dict = {}
        for suffix in suffixes:
            node = self.root
            for c in reversed(suffix):
                node = node.setdefault(c, {})
            node[""] = suffix

    def of(self, word: str) -> str:
        node, found = self.root, ""
        for c in reversed(word):
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return found


_1A, _1B = Suffixes(("sses", "ied", "ies", "us", "ss", "s")), Suffixes(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_2, _3, _4 = Suffixes(STEP_2), Suffixes(STEP_3), Suffixes(STEP_4)

_SYLLABLE = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _vowel(c: str) -> bool:
    return c in VOWELS


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from ``start`` on."""
    found = _SYLLABLE.search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return _vowel(word[0]) and not _vowel(word[1])
    return len(word) > 2 and not _vowel(word[-3]) and _vowel(word[-2]) and not _vowel(word[-1]) and word[-1] not in "wxY"


def _step_1a(w: str) -> str:
    end = _1A.of(w)
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and any(map(_vowel, w[:-2])) else w


def _step_1b(w: str, r1: int) -> str:
    end = _1B.of(w)
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    body = w[: len(w) - len(end)]
    if not end or not any(map(_vowel, body)):
        return w
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if body.endswith(DOUBLES):
        return body[:-1]
    return body + "e" if r1 >= len(body) and _short_end(body) else body


def _step_2(w: str, r1: int) -> str:
    end = _2.of(w)
    body = w[: len(w) - len(end)]
    if not end or len(body) < r1 or end == "ogi" and not body.endswith("l") or end == "li" and body[-1:] not in tuple(LI_ENDINGS):
        return w
    return body + STEP_2[end]


def _step_3(w: str, r1: int, r2: int) -> str:
    end = _3.of(w)
    body = w[: len(w) - len(end)]
    return body + STEP_3[end] if end and len(body) >= (r2 if end == "ative" else r1) else w


def _step_4(w: str, r2: int) -> str:
    end = _4.of(w)
    body = w[: len(w) - len(end)]
    return body if end and len(body) >= r2 and (end != "ion" or body.endswith(("s", "t"))) else w


def _step_5(w: str, r1: int, r2: int) -> str:
    body = w[:-1]
    if w.endswith("e"):
        return body if len(body) >= r2 or len(body) >= r1 and not _short_end(body) else w
    return body if w.endswith("ll") and len(body) >= r2 else w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word without apostrophes. Memories of a worker are bounded by the size of the cache."""
    if len(word) <= 2 or word in WHOLE_WORDS:
        return WHOLE_WORDS.get(word, word)
    w = "Y" + word[1:] if word[0] == "y" else word
    at = w.find("y", 1)
    while at > 0:
        if _vowel(w[at - 1]):
            w = w[:at] + "Y" + w[at + 1 :]
        at = w.find("y", at + 1)
    prefix = next((p for p in R1_PREFIXES if w.startswith(p)), None) if w.startswith(R1_PREFIXES) else None
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = _step_1a(w)
    if w in KEPT_AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    w = _step_2(w, r1)
    w = _step_3(w, r1, r2)
    w = _step_4(w, r2)
    return _step_5(w, r1, r2).replace("Y", "y")


_STOPPED = frozenset(STOP_WORDS)


def lexeme(token: str) -> str | None:
    """Lexeme of a lower-case token: words of letters are stemmed, stop words are none, numbers and mixed tokens stay."""
    if not token.isalpha():
        return token
    return None if token in _STOPPED else stem(token)


def stem_sql(word: str) -> str:
    """The stemmer in SQL with regular expressions, for checks: a scalar subquery over the column ``word`` in lower case."""
    vowel, other = "[aeiouy]", "[^aeiouy]"
    cut = lambda n, new="": f"left(x, length(x) - {n}) || '{new}'"

    def longest(rules: list[tuple[str, str]]) -> str:
        """rules: (suffix, SQL of the result); the longest suffix decides."""
        return "CASE " + " ".join(f"WHEN ends_with(x, '{s}') THEN {then}" for s, then in sorted(rules, key=lambda r: -len(r[0]))) + " ELSE x END"

    def in_region(suffix: str, region: str, new: str, more: str = "true") -> tuple[str, str]:
        return suffix, f"CASE WHEN length(x) - {len(suffix)} >= {region} AND {more} THEN {cut(len(suffix), new)} ELSE x END"

    short = "(regexp_full_match({0}, '[aeiouy][^aeiouy]') OR regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    region = lambda text: f"CASE WHEN regexp_matches({text}, '^{other}*{vowel}+{other}') THEN length(regexp_extract({text}, '^{other}*{vowel}+{other}')) ELSE length({text}) END"
    vowel_in = lambda n: f"regexp_matches(left(x, length(x) - {n}), '{vowel}')"
    gone = lambda n: f"CASE WHEN {vowel_in(n)} THEN '1' || {cut(n)} ELSE x END"
    step_1a = longest([("sses", cut(2)), ("ied", f"CASE WHEN length(x) > 4 THEN {cut(2)} ELSE {cut(1)} END"), ("ies", f"CASE WHEN length(x) > 4 THEN {cut(2)} ELSE {cut(1)} END"), ("us", "x"), ("ss", "x"), ("s", f"CASE WHEN {vowel_in(2)} THEN {cut(1)} ELSE x END")])
    step_1b = longest([in_region("eed", "r1", "ee"), in_region("eedly", "r1", "ee"), *((s, gone(len(s))) for s in ("ed", "edly", "ing", "ingly"))])
    mend = f"CASE WHEN NOT starts_with(x, '1') THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN substr(x, 2) || 'e' WHEN regexp_matches(x, '({'|'.join(DOUBLES)})$') THEN substr(left(x, length(x) - 1), 2) WHEN r1 >= length(x) - 1 AND {short.format('substr(x, 2)')} THEN substr(x, 2) || 'e' ELSE substr(x, 2) END"
    step_1c = f"CASE WHEN length(x) > 2 AND regexp_matches(x, '{other}[yY]$') THEN {cut(1, 'i')} ELSE x END"
    step_2 = longest([in_region(s, "r1", new, {"ogi": "ends_with(x, 'logi')", "li": f"regexp_matches(x, '[{LI_ENDINGS}]li$')"}.get(s, "true")) for s, new in STEP_2.items()])
    step_3 = longest([in_region(s, "r2" if s == "ative" else "r1", new) for s, new in STEP_3.items()])
    step_4 = longest([in_region(s, "r2", "", "regexp_matches(x, '[st]ion$')" if s == "ion" else "true") for s in STEP_4])
    step_5 = f"CASE WHEN ends_with(x, 'e') THEN CASE WHEN length(x) - 1 >= r2 OR length(x) - 1 >= r1 AND NOT {short.format('left(x, length(x) - 1)')} THEN {cut(1)} ELSE x END WHEN ends_with(x, 'll') AND length(x) - 1 >= r2 THEN {cut(1)} ELSE x END"
    marked = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"
    first = "CASE " + " ".join(f"WHEN starts_with(x, '{p}') THEN {len(p)}" for p in R1_PREFIXES) + f" ELSE {region('x')} END"
    kept = f"x IN ({', '.join(repr(w) for w in KEPT_AFTER_1A)})"
    inner = f"SELECT x, r1, r1 + {region('substr(x, r1 + 1)')} AS r2 FROM (SELECT x, {first} AS r1 FROM (SELECT {marked} AS x))"
    inner = f"SELECT {step_1a} AS x, r1, r2 FROM ({inner})"
    inner = f"SELECT x, r1, r2, {kept} AS kept FROM ({inner})"
    for step in (step_1b, mend, step_1c, step_2, step_3, step_4, step_5):
        inner = f"SELECT CASE WHEN kept THEN x ELSE {step} END AS x, r1, r2, kept FROM ({inner})"
    whole = "CASE " + " ".join(f"WHEN {word} = '{w}' THEN '{s}'" for w, s in WHOLE_WORDS.items())
    return f"{whole} WHEN length({word}) <= 2 THEN {word} ELSE (SELECT replace(x, 'Y', 'y') FROM ({inner})) END"
