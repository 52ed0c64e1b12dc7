"""Numbers of texts as claims, and their support by evidence or results. The grammar that finds them is in mentions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .figure_columns import of_mentions, of_texts, unbacked
from .mentions import FIELDS, REL_TOL, SCALES, read

# The words of direction and the kinds of results.
RISE = (
    "higher|more|greater|above|ahead|exceed(?:s|ed)?|increas(?:e|ed|es|ing)|rose|ris(?:e|es|en|ing)|up|grew|grow(?:th|s)?|gain(?:s|ed)?|larger|better|positive|plus|lead(?:s|ing)?|led|outperform\\w*|outpac\\w*"
)
FALL = (
    "lower|less|fewer|below|behind|trail(?:s|ed|ing)?|declin(?:e|ed|es|ing)|decreas(?:e|ed|es|ing)|drop(?:s|ped)?|(?:fell|fall(?:s|en)?)(?![ \\t]+into\\b)|down|negative|minus|smaller|worse|lag(?:s|ged)?|"
    "loss|shr[ai]nk|shrunk|contract(?:ed|ion)|deficit|under|underperform\\w*"
)
GAP_CUES = "gap|differen\\w*|differ\\w*|spread|margin|between|vs|versus|compared|apart"
CLAUSE_ENDS = r"[;:()–—]|,(?!\d)|[.!?](?=\s|$)|\s(?:but|while|whereas|although|though|yet)\s"
KINDS = {"percent": ("percent",), "currency_usd": ("currency", "plain"), "count": ("plain",), "number": ("plain", "points"), "rating": ("plain", "points"), "ratio": ("plain", "multiple")}

_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def with_mentions(df: DataFrame, text: str, out: str = "mentions", bare: bool = False, context: int = 64) -> DataFrame:
    """df with the number mentions of a text: array of structs text, digits, mantissa, value, percent, currency, scale, labelled, temporal, kind, before, after.

    digits are those written, without separators; value = mantissa * scale. Numbers inside identifiers, versions and citation
    markers and ordinals of lists are none. Numbers in words count with a magnitude or percent; with ``bare`` all do. In a
    range, the first number takes the percent of the second, its scale too if it is below 1,000 and not above the
    second, and gives it its currency. labelled: a unit, count noun or counting column says what is counted. temporal: a
    year in a date or period, and years joined to one. kind: bps, points, multiple, percent, currency, other_currency or
    plain. before and after hold ``context`` characters. A null text has no mentions.
    """

    def run(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for t in texts.to_pylist():
            found += read(t, bare, context)
            ends.append(len(found))
        columns = zip(*found, strict=True) if found else ([] for _ in FIELDS)
        structs = pa.StructArray.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    # not deterministic to the optimizer, which else copies the call into each of its uses
    called = F.arrow_udf(run, f"array<struct<{', '.join(f'{n}: {k}' for n, k in FIELDS.items())}>>").asNondeterministic()
    return (df.drop(out) if out != text else df).select("*", called(F.col(text).cast("string")).alias(out))


def supports(claim: Column, evidence: Column) -> Column:
    """Whether an evidence mention backs a claim mention; signs aside, equal to 1e-6.

    Percent must agree, or the side without it be a bare figure; currencies must not differ. Values agree, or mantissas where one
    side has no scale: a bare cell "612.0" backs "$612.0 million", but "612 million" never "612 billion".
    """
    near = lambda a, b: F.abs(F.abs(a) - F.abs(b)) <= REL_TOL * F.greatest(F.abs(a), F.abs(b))
    bare = lambda m: (m["scale"] == 1) & m["currency"].isNull() & ~m["labelled"]
    units = F.when(claim["percent"] != evidence["percent"], F.when(claim["percent"], bare(evidence)).otherwise(bare(claim))).otherwise(F.coalesce(claim["currency"] == evidence["currency"], F.lit(True)))
    mantissa = ((claim["scale"] == 1) | (evidence["scale"] == 1)) & near(claim["mantissa"], evidence["mantissa"])
    return units & (near(claim["value"], evidence["value"]) | mantissa)


def unsupported(df: DataFrame, answer: str, evidence: str, key: str) -> DataFrame:
    """key, text, value of the number mentions of answers that no mention of their evidence supports; years of dates and periods are left out.

    ``answer`` names a text, or an array of texts that share their evidence: then ``at`` is the place of each in it, from 0.
    ``evidence`` names a text, or an array of mentions for evidence that several answers share.
    """
    kinds = dict(df.dtypes)
    mentions, several = kinds[evidence] != "string", kinds[answer] != "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, by = batch.column("_answers"), batch.column("_evidence")
            row, said = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            claims, stated = of_texts(said), of_mentions(by.to_pylist()) if mentions else of_texts(by)
            bad = unbacked(claims, stated, row)
            if mentions and by.null_count:
                bad = bad[~by.is_null().to_numpy(zero_copy_only=False)[row[np.searchsorted(claims.begin, bad, side="right") - 1]]]
            text = np.searchsorted(claims.begin, bad, side="right") - 1
            at = text - np.searchsorted(row, row[text])
            columns = [batch.column(key).take(pa.array(row[text])), pa.array(at, pa.int32()), pa.array([claims.text(i) for i in bad.tolist()], pa.string()), pa.array([claims.signed(i) for i in bad.tolist()], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "at", "text", "value"])

    both = df.select(key, (F.col(answer) if several else F.array(answer)).alias("_answers"), F.col(evidence).alias("_evidence"))
    found = both.mapInArrow(run, f"`{key}` {kinds[key]}, at int, text string, value double")
    return found if several else found.drop("at")


def states(value: Column, text: str) -> Column:
    """Whether a mention array (``text`` names its column) has a number near ``value``, as written or scaled; a null value asks for nothing."""
    tolerance = 1e-6 * F.greatest(F.lit(1.0), F.abs(value))
    return value.isNull() | F.exists(text, lambda m: (F.abs(m["mantissa"] - value) <= tolerance) | (F.abs(m["value"] - value) <= tolerance))


def stated_as(digits: Column, value: Column, exact: Column | None = None) -> Column:
    """Whether written digits state a value: equal to it, to the exact one, or to that rounded half to even at the places written.

    A value that is not zero is never stated as zero. value and exact are decimals; signs are for the direction to judge.
    """
    stated = digits.cast("decimal(38,12)")
    places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
    whole = F.abs(value.cast("decimal(38,12)"))
    ok = stated == whole
    if exact is not None:
        full = F.abs(exact.cast("decimal(38,12)"))
        rounded = reduce(lambda out, n: F.when(places == n, F.bround(full, n).cast("decimal(38,12)")).otherwise(out), range(12), full)
        ok = ok | F.coalesce((stated == full) | (stated == rounded), F.lit(False))
    zero = (stated == 0) & (F.coalesce(exact, value) if exact is not None else value).cast("decimal(38,12)").isNotNull() & ((F.coalesce(exact, value) if exact is not None else value) != 0)
    return F.coalesce(ok & ~zero, F.lit(False))


def _clause(mention: Column) -> tuple[Column, Column]:
    """Text of the clause before and after a mention."""
    before = F.element_at(F.split(mention["before"], CLAUSE_ENDS), -1)
    return before, F.get(F.split(mention["after"], CLAUSE_ENDS), F.lit(0))


def direction_agrees(mention: Column, kind: Column, value: Column, group_a: Column, group_b: Column) -> Column:
    """Whether the words of the mention's clause go with the sign of a result.

    A written minus needs a negative value. A level that is not negative is told without words of change near it (four
    words before, three after); a negative one needs a word of fall. The difference A - B needs one direction: the group
    named last before the direction word, else the one after it turned round, is its subject; without a direction word only a
    positive difference with a word of comparison is told.
    """
    before, after = _clause(mention)
    near = F.concat_ws(" ", F.regexp_extract(before, r"((?:[A-Za-z][A-Za-z'/-]*[^A-Za-z\d]+){0,4})\z", 1), F.lit("#"), F.regexp_extract(after, r"^((?:[^A-Za-z\d]+[A-Za-z][A-Za-z'/-]*){0,3})", 1))
    rise, fall = rf"(?i)\b(?:{RISE})\b", rf"(?i)\b(?:{FALL})\b"
    clause = F.concat_ws(" # ", before, after)
    up, down = clause.rlike(rise), clause.rlike(fall)
    level = F.when(value < 0, near.rlike(fall)).otherwise(~near.rlike(rise) & ~near.rlike(fall))
    at = F.regexp_instr(clause, F.lit(rf"(?i)\b(?:{RISE}|{FALL})\b"))
    low = F.lower(clause)
    head, tail = F.substr(low, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(low, F.greatest(at, F.lit(1)))
    far = F.lit(10**9)
    label = lambda g: F.concat(F.lit(r"(?<!\w)\Q"), F.lower(g), F.lit(r"\E(?!\w)"))
    # characters between the label and the direction word
    before_ = lambda g: F.when(F.rlike(head, label(g)), F.length(head) - F.length(F.call_function("regexp_extract", head, F.concat(F.lit("(?s)^(.*)"), label(g)), F.lit(1))))
    after_ = lambda g: F.nullif(F.regexp_instr(tail, label(g)), F.lit(0))
    a_before, b_before, a_after, b_after = (F.coalesce(f(g), far) for f in (before_, after_) for g in (group_a, group_b))
    subject_a = F.when(F.least(a_before, b_before) < far, a_before < b_before).when(F.least(a_after, b_after) < far, a_after > b_after).otherwise(F.when(group_a.isNull(), True))
    told = F.when(up & down, False).when(value == 0, False).otherwise(subject_a.isNotNull() & ((up == subject_a) == (value > 0)))
    difference = F.when(up | down, told).otherwise((value > 0) & clause.rlike(rf"(?i)\b(?:{GAP_CUES})\b"))
    return F.coalesce(F.when(mention["mantissa"] < 0, value < 0).when(kind == "difference", difference).otherwise(level), F.lit(False))


def result_supports(mention: Column, kind: Column, unit: Column, scale: Column, value: Column, exact: Column, group_a: Column, group_b: Column) -> Column:
    """Whether a figure of a computed result backs a claim mention (of a text with a wide context).

    kind: metric, difference, count or label. The claim's kind must fit the unit (a difference of percents may be points), its
    scale be the result's, its direction agree, and its digits state the value. A null value backs nothing.
    """
    fits = F.when(kind.isin("count", "label"), mention["kind"] == "plain").when((kind == "difference") & (unit == "percent"), mention["kind"].isin("percent", "points"))
    for name, kinds in KINDS.items():
        fits = fits.when(unit == name, mention["kind"].isin(*kinds))
    factor = F.when(kind.isin("count", "label"), 1.0).otherwise(F.when(F.coalesce(scale, F.lit("")) == "", 1.0).otherwise(F.try_element_at(_map(SCALES), scale)))
    shown = F.when(kind.isin("count", "label"), stated_as(mention["digits"], value)).otherwise(stated_as(mention["digits"], value, exact))
    return F.coalesce(fits & (mention["scale"] == factor) & shown & direction_agrees(mention, kind, value, group_a, group_b), F.lit(False))


def recheck(answers: DataFrame, texts: DataFrame, key: str, content: str, handle: str, text: str) -> DataFrame:
    """key, unit, scope, numbers: the units of stored answers with numbers that the texts they cite do not have.

    A unit cites handles as [[handle]]; a handle without a text adds nothing. Units without a citation are not checked.
    Years of dates and periods are claims like others here, as the recheck trusts no other stage.
    """
    from .claims import units

    cite = r"\[\[([^\[\]]+)\]\]"
    cut = answers.select(key, F.posexplode(units(F.col(content))).alias("unit", "_text"))
    cited = cut.withColumn("_handles", F.array_distinct(F.regexp_extract_all("_text", F.lit(cite), F.lit(1)))).where(F.size("_handles") > 0)
    claimed = with_mentions(cited, "_text", "_claims").select(key, "unit", "_handles", F.posexplode("_claims").alias("_at", "_claim"))
    stated = with_mentions(texts.select(F.col(handle).alias("_handle"), F.col(text).alias("_body")), "_body", "_stated").select("_handle", "_stated")
    per = claimed.withColumn("_handle", F.explode("_handles")).join(stated, "_handle", "left")
    ok = F.coalesce(F.exists("_stated", lambda e: supports(F.col("_claim"), e)), F.lit(False))
    judged = per.groupBy(key, "unit", "_at").agg(F.bool_or(ok).alias("_ok"), F.first("_claim").alias("_claim")).where("NOT _ok")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("_claim.text").alias("text")))), lambda x: x["text"])
    return judged.groupBy(key, "unit").agg(listed.alias("numbers")).select(key, "unit", F.lit("cited").alias("scope"), "numbers")


def summary_status(df: DataFrame, text: str, status: str, allowed: str) -> DataFrame:
    """df with summary_status: absent for blank texts, verified where the analysis was computed and every number of the text, as written
    or scaled, is among the allowed ones (an array of doubles), else unverified."""
    read = with_mentions(df, text, "_said")
    near = lambda a, b: F.abs(F.abs(a) - F.abs(b)) <= REL_TOL * F.greatest(F.abs(a), F.abs(b))
    known = F.forall("_said", lambda m: F.exists(allowed, lambda x: near(m["value"], x) | ((m["scale"] == 1) & near(m["mantissa"], x))))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    return read.withColumn("summary_status", F.when(blank, "absent").when((F.col(status) == "computed") & F.coalesce(known, F.lit(False)), "verified").otherwise("unverified")).drop("_said")
