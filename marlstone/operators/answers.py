"""Answers: sections and units, what must not leak, and citations fitted to a cap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of sections, line forms, abbreviations and markers.
HEADINGS = {"answer": "answer", "key findings": "findings", "conflicting evidence": "conflicts", "interpretation": "interpretation", "gaps and unknowns": "gaps"}
OTHER = "unrecognized"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
HEADING = r"^ {0,3}(#{2,4})[ \t]+(.+?)[ \t]*#*[ \t]*$"
FENCE = r"^ {0,3}(?:```|~~~)"
HANDLE = r"[A-Z][A-Z0-9]{1,15}/[A-Z0-9]{1,12}(?:-[A-Z0-9]{1,12}){0,5}@v\d{1,4}(?::[A-Z0-9]+(?:\.[A-Z0-9]+)*)?(?:#w\d+)?"
URL = r"(?:(?:https?|ftp)://|www\.)[^\s<>()\[\]]*[^\s<>()\[\].,;:!?'\"]"
ALIASISH = r"\[\s*[EeRr]\s*\d*(?:\s*,\s*[EeRr]?\s*\d+)*\s*\]"
#: Kind, pattern and what stays of a leak, in the order in which they are looked for. Each match is longer than what stays.
LEAKS = (
    ("format_char", r"\p{Cf}", ""),
    ("canonical_marker", r"\[\[[^\[\]\n]{0,120}\]\]", " "),
    ("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "),
    ("html", r"(?s)<!--.*?-->", " "),
    ("raw_handle", rf"\[{HANDLE}\]|(?<![A-Za-z0-9]){HANDLE}", " "),
    ("image", r"!\[[^\[\]\n]*\]\([^)\n]*\)", " "),
    ("link", r"\[([^\[\]\n]*)\]\([^)\n]*\)", "label"),
    ("url", rf"<{URL}/?>", " "),
    ("url", URL, " "),
    ("html", r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", " "),
    ("uuid", r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b", " "),
    ("uuid", r"\b[0-9a-fA-F]{32}\b", " "),
    ("child_id", r"#w\d+\b", " "),
)
ANSWER, FINDINGS, INTERPRETATION = "answer", "findings", "interpretation"
LEAST_FINDINGS = 3


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, place, body: canonical sections of answers in the order of their first heading.

    Lines below a heading of two to four signs belong to its section, those before any and below unknown ones to ``unrecognized``,
    which is there only if it holds text. Sections of one name are joined, with an empty line between. Headings inside
    fences are none. A known section stays even if empty. Null texts have no sections.
    """
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("_at", "_line"))
    order = Window.partitionBy(key).orderBy("_at")
    fences = F.sum(F.col("_line").rlike(FENCE).cast("int")).over(order)
    name = F.regexp_extract("_line", HEADING, 2)
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(name, "&amp;", "&"), "[*_`]", "")), ":+$", ""), "&", " and ")
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair)), F.trim(F.regexp_replace(F.lower(plain), r"\s+", " ")))
    marked = lines.withColumn("_head", (name != "") & (fences % 2 == 0)).withColumn("_name", F.when(F.col("_head"), F.coalesce(known, F.lit(OTHER))))
    placed = marked.withColumn("section", F.coalesce(F.last("_name", ignorenulls=True).over(order), F.lit(OTHER)))
    first = F.min("_at").over(Window.partitionBy(key, "section"))
    # a heading opens its section; a later one of the same name is an empty line
    kept = placed.withColumn("_first", first).where(~F.col("_head") | (F.col("_at") > F.col("_first"))).withColumn("_line", F.when(F.col("_head"), "").otherwise(F.col("_line")))
    bodies = kept.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n").alias("body"))
    names = placed.groupBy(key, "section").agg(F.min("_at").alias("_first"))
    out = names.join(bodies, [key, "section"], "left").withColumn("body", F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+\z", ""))
    out = out.where((F.col("section") != OTHER) | (F.col("body") != ""))
    return out.select(key, "section", F.row_number().over(Window.partitionBy(key).orderBy("_first")).alias("place"), "body")


def tidy(text: str) -> str:
    """Blanks that removals leave behind: inner runs as one, empty parentheses, blanks before punctuation and at ends of lines."""
    lines = []
    for line in text.splitlines():
        line = regex.sub(r"\(\s*\)", "", regex.sub(r"(?<=\S)[ \t]{2,}", " ", line))
        lines.append(regex.sub(r"(?<=\S)[ \t]+([.,;:!?])(?=\s|$)", r"\1", line).rstrip())
    return "\n".join(lines)


def _label(match: regex.Match) -> str:
    """What stays of a link: its text, in brackets if that makes a citation."""
    marked = f"[{match[1]}]"
    return marked if regex.fullmatch(ALIASISH, marked) else match[1]


def without_leaks(text: str) -> tuple[str, list[str]]:
    """Text without leaks and the kind of each one removed.

    A removal can bring the halves of another leak together, so passes go on until one finds nothing. Each removal leaves
    less than it took and tidying adds nothing, so the text gets shorter in each pass and the passes end.
    """
    kinds: list[str] = []
    while True:
        found = 0
        for kind, pattern, rest in LEAKS:
            text, n = regex.subn(pattern, _label if rest == "label" else rest, text)
            kinds += [kind] * n
            found += n
        if not found:
            return text, kinds
        text = tidy(text)


def strip_leaks(df: DataFrame, text: str, out: str = "clean", kinds: str = "leaks") -> DataFrame:
    """df with the text without invisible characters, markers, raw handles, links, images, addresses, markup and ids, and their kinds.

    A text without a leak stays as it is; a null text stays null without kinds.
    """
    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes if n not in (out, kinds))
    rows = df.drop(out, kinds) if text not in (out, kinds) else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, []) if t is None else without_leaks(t) for t in batch.column(text).to_pylist()]
            more = [pa.array([t for t, _ in got], pa.string()), pa.array([k for _, k in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, out, kinds])

    return rows.mapInArrow(run, f"{schema}, `{out}` string, `{kinds}` array<string>")


@dataclass
class _Unit:
    """A unit of an answer: proof gives the claims, as bits, that each citation backs; need those that all of them back."""

    at: int
    section: str
    text: str
    cited: list[str]
    proof: dict[str, int]
    fixed: set[str]
    kept: bool = True
    log: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.need = self.backed(self.cited)

    def backed(self, aliases: list[str]) -> int:
        out = 0
        for a in aliases:
            out |= self.proof.get(a, 0)
        return out

    def spares(self, alias: str) -> bool:
        rest = [a for a in self.cited if a != alias]
        return bool(rest) and alias not in self.fixed and self.backed(rest) == self.need

    def drop(self, alias: str, why: str) -> None:
        self.cited.remove(alias)
        self.text = " ".join(self.text.replace(f"[{alias}]", " ").split())
        self.log.append(f"removed citation {alias}: {why}")


def _offers(units: list[_Unit], parents: dict[str, str]) -> Iterator[tuple[_Unit, list[str], str]]:
    """Citations that may go, unit by unit, in the order of the steps; each offer is made from what the ones before left."""
    of = lambda *names: [u for n in names for u in units if u.kept and u.section == n]
    every = of(*dict.fromkeys(u.section for u in units))
    for u in every:
        holders = [parents.get(a, a) for a in u.cited]
        yield u, [a for i, a in enumerate(u.cited) if holders[i] in holders[:i]], "same source as another citation"
    for name in (ANSWER, FINDINGS, INTERPRETATION):
        for before, u in pairwise(of(name)):
            yield u, [a for a in u.cited if a in before.cited], "repeated from the previous unit"
    told = {a for u in of(FINDINGS) for a in u.cited}
    for u in reversed(of(ANSWER)):
        yield u, [a for a in u.cited if a in told], "already cited in the findings"
    for name in (INTERPRETATION, FINDINGS, ANSWER):
        for u in reversed(of(name)):
            keep = next((a for a in u.cited if a in u.fixed), u.cited[0] if u.cited else None)
            yield u, [a for a in u.cited if a != keep], "extra citation"


def _fit(units: list[_Unit], cap: int, parents: dict[str, str]) -> None:
    """Bring the citations of an answer down to the cap as far as every unit keeps what proves it."""
    over = lambda: sum(len(u.cited) for u in units if u.kept) > cap
    seen = set()
    for u in units:
        same = (u.section, u.text, tuple(u.cited))
        if u.cited and same in seen and over():
            u.kept = False
            u.log.append("repeats an earlier unit")
        seen.add(same)
    for u, aliases, why in _offers(units, parents):
        for alias in reversed(aliases):
            if not over():
                return
            if u.spares(alias):
                u.drop(alias, why)
    findings = [u for u in units if u.kept and u.section == FINDINGS]
    while over() and len(findings) > LEAST_FINDINGS:
        u = findings.pop()
        u.kept = False
        u.log.append("trailing finding")


def fit_citations(units: DataFrame, key: str, cap: int, parents: DataFrame | None = None) -> DataFrame:
    """units with their text and citations after fitting each answer to ``cap`` citations, and kept, repairs.

    units: key, section, unit (order), text, cited array<string>, proof map<string,array<int>> (claims that a citation backs), fixed
    array<string> (citations that must stay). parents: key, alias, parent. Answers within the cap are left alone by
    Spark; the others, each packed into one row, are fitted one by one: repeated units go; then second citations of one parent, those of the
    unit before, those the findings have, extra ones; then findings beyond the third, from the end. A citation goes only
    while the unit keeps one and the rest back every claim that all backed. What cannot fit stays over the cap.
    """
    kinds = dict(units.dtypes)
    n = F.sum(F.coalesce(F.size("cited"), F.lit(0))).over(Window.partitionBy(key))
    counted = units.select(key, "section", "unit", "text", "cited", "proof", "fixed").withColumn("_n", n)
    calm = counted.where(F.col("_n") <= cap).select(key, "section", "unit", "text", "cited", F.lit(True).alias("kept"), F.expr("CAST(array() AS array<string>)").alias("repairs"))
    named = F.lit(None).cast("map<string,string>") if parents is None else None
    busy = counted.where(F.col("_n") > cap).drop("_n")
    if parents is not None:
        held = parents.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("alias", "parent"))).alias("parents"))
        busy = busy.join(held, key, "left")
    else:
        busy = busy.withColumn("parents", named)

    held = ["section", "unit", "text", "cited", "proof", "fixed"]
    packed = busy.groupBy(key).agg(F.collect_list(F.struct(*held)).alias("units"), F.any_value("parents").alias("parents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda ids: sum(1 << i for i in set(ids or ()))
        for batch in batches:
            rows, done = [], []
            for row, (units_, parents_) in enumerate(zip(batch.column("units").to_pylist(), batch.column("parents").to_pylist(), strict=True)):
                own = [_Unit(int(u["unit"]), u["section"], u["text"] or "", list(u["cited"] or ()), {a: bits(ids) for a, ids in u["proof"] or ()}, set(u["fixed"] or ())) for u in sorted(units_, key=lambda u: u["unit"])]
                _fit(own, cap, dict(parents_ or ()))
                rows += [row] * len(own)
                done += own
            texts, lists = pa.string(), pa.list_(pa.string())
            columns = [pa.array([u.section for u in done], texts), pa.array([u.at for u in done], pa.int64()), pa.array([u.text for u in done], texts), pa.array([u.cited for u in done], lists), pa.array([u.kept for u in done], pa.bool_()), pa.array([u.log for u in done], lists)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int32())), *columns], [key, "section", "unit", "text", "cited", "kept", "repairs"])

    fitted = packed.mapInArrow(run, f"{key} {kinds[key]}, section string, unit long, text string, cited array<string>, kept boolean, repairs array<string>")
    return calm.withColumn("unit", F.col("unit").cast("long")).unionByName(fitted)


def proofs(units: DataFrame, key: str, text: Column, cited: str, evidence: DataFrame) -> DataFrame:
    """units with proof: for each cited alias, the claims of the unit (by number) that its evidence backs.

    evidence: key, alias, body; the bodies of one alias back claims together. Numbers of a unit and of its evidence are
    compared by figures.supports.
    """
    from .figures import supports, with_mentions

    def read(df: DataFrame, column: str, out: str) -> DataFrame:
        """df with the mentions of a text; equal texts are read once, however many rows have them."""
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not fewer tasks than those
        return df.join(with_mentions(df.select(column).distinct().repartition(tasks, column), column, out), column).drop(column)

    said = read(units.withColumn("_said", F.coalesce(text, F.lit(""))), "_said", "_claims")
    known = read(evidence.select(key, F.col("alias").alias("_alias"), F.coalesce("body", F.lit("")).alias("_body")), "_body", "_stated")
    pairs = said.select(key, "unit", "_claims", F.explode(cited).alias("_alias")).join(known, [key, "_alias"])
    claims = F.filter(F.transform("_claims", lambda c, i: F.when(F.exists("_stated", lambda e: supports(c, e)), i)), lambda i: i.isNotNull())
    one = pairs.groupBy(key, "unit", "_alias").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(claims)))).alias("_claims"))
    per = one.groupBy(key, "unit").agg(F.map_from_entries(F.collect_list(F.struct("_alias", "_claims"))).alias("proof"))
    return said.drop("_claims").join(per, [key, "unit"], "left")
