"""Quotation linking of messages: nested quotes, links to the messages they come from, and threads without quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_SAYS = re.compile(r"^\s*(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\b.{0,80}:\s*$")


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and text of each line; the level is the number of leading > marks."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """Text without quotes, and the quoted passages: level and lines of each run of lines of one level.

    A line that only says who wrote what follows goes with the quote that it introduces.
    """
    own, quoted, lines = [], [], levels(text)
    for i, (level, line) in enumerate(lines):
        if not level:
            if not (_SAYS.match(line) and i + 1 < len(lines) and lines[i + 1][0]):
                own.append(line)
            continue
        if _SAYS.match(line) and i + 1 < len(lines) and lines[i + 1][0] > level:
            continue
        if i and lines[i - 1][0] == level and quoted and quoted[-1][0] == level:
            quoted[-1][1].append(line)
        else:
            quoted.append((level, [line]))
    clean = "\n".join(own)
    if quoted:
        clean = re.sub(r"\n{3,}", "\n\n", clean).strip()
    return clean, quoted


def fingerprint(lines: list[str]) -> str | None:
    """Digest of lines with white space runs as one blank and letters folded; None without letters or digits."""
    text = " ".join(" ".join(lines).split()).casefold()
    return hashlib.sha256(text.encode(errors="surrogatepass")).hexdigest()[:32] if any(c.isalnum() for c in text) else None


def _prints(lines: list[str]) -> list[tuple[str, int]]:
    """Fingerprints of a passage as a whole and line by line, with the letters that each stands for."""
    got = {fingerprint(lines): sum(map(len, lines)) + 1}
    for line in lines:
        got.setdefault(fingerprint([line]), len(line))
    return [(k, n) for k, n in got.items() if k]


def reply_positions(replies: DataFrame) -> DataFrame:
    """conv_id, turn, position, cut of each message of replies (conv_id, turn, to_conv, to_turn; one row for each message).

    position counts the messages that the chain of replies passes before this one; it is found by doubling the steps of
    all chains at once, so a chain of n messages takes log2 n joins. Where chains close a cycle, the reply of its smallest
    message is cut (true), and positions count from there.
    """
    keys = ["conv_id", "turn"]
    known = replies.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.lit(True).alias("there"))
    steps = materialise(replies.join(known, ["to_conv", "to_turn"], "left").select(*keys, F.when(F.col("there"), F.struct(F.col("to_conv").alias("c"), F.col("to_turn").alias("t"))).alias("to")), "reply-steps")
    cut = None
    for _ in range(2):
        now = steps.select(*keys, "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.least(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "to").alias("low"))
        seen = None
        while True:
            # only chains that have not come to their begin; the smallest message of cycles is certain when nothing changes
            now = materialise(now, "reply-chains")
            mark = now.where("to IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()
            if not mark[0] or mark == seen:
                break
            seen = mark
            next_ = now.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("low").alias("_low"))
            moved = now.where("to IS NOT NULL").join(next_, (F.col("to.c") == F.col("_c")) & (F.col("to.t") == F.col("_t")))
            now = now.where("to IS NULL").unionByName(moved.select(*keys, F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low")))
        if not mark[0]:
            break
        # chains that never end come to lie on their cycles, and there the smallest message of a chain is that of its cycle
        on = now.where("to IS NOT NULL").select(F.col("to.c").alias("conv_id"), F.col("to.t").alias("turn")).distinct()
        cut = materialise(now.join(on, keys).select(F.col("low.c").alias("conv_id"), F.col("low.t").alias("turn"), F.lit(True).alias("cut")).distinct(), "reply-cuts")
        steps = materialise(steps.join(cut, keys, "left").select(*keys, F.when(F.col("cut").isNull(), F.col("to")).alias("to")), "reply-steps")
    out = now.select(*keys, F.col("hops").alias("position"))
    return out.withColumn("cut", F.lit(None).cast("boolean")) if cut is None else out.join(cut, keys, "left")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, reply_conv, reply_turn, reply_by, thread_id, reply_position of every message.

    text has no quotes. A quoted passage is linked to the first message of its own conversation that holds it and
    comes before, else to the first message of the other conversations that holds it, by the whole passage or by single
    lines. reply_conv and reply_turn name the message answered: that of the passage of the lowest level and most letters
    (reply_by ``quote``), else the message of the turn before (``turn``), else none (null). Conversations linked by quotes
    make a thread, named by its smallest conv_id. reply_position is the number of messages that the replies pass from the
    begin: ordered by thread_id, reply_position, conv_id and turn each reply comes after its message. Where replies would
    run in a circle, its smallest message answers none (``cut``).

    Null texts are empty and stay null; messages with a null conv_id or turn are never linked and have no position.
    Repeated rows stay; a message that stands twice has one reply, that of the smaller target. Each passage is looked up
    among first messages by fingerprint, one for each conversation and two of all, so a passage that many messages share
    gives one candidate. Texts of any length are read line by line. Other columns are not read, so their names may be any;
    an empty table gives no rows.
    """
    base = messages.select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"), messages["role"].cast("string").alias("role"), messages["text"].cast("string").alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, quoted, prints = [], [], []
            for text in batch["text"]:
                clean, quotes = passages(text) if text is not None else (None, [])
                own.append(clean)
                quoted.append([{"passage": i, "level": level, "print": p, "weight": n} for i, (level, lines) in enumerate(quotes) for p, n in _prints(lines)])
                lines = [x for x in (clean or "").split("\n") if x.strip()]
                prints.append(sorted({p for p, _ in _prints(lines)} | {p for part in re.split(r"\n\s*\n", clean or "") if (p := fingerprint([part]))}))
            yield batch.assign(text=own, quotes=quoted, prints=prints, n_quotes=[len({q["passage"] for q in x}) for x in quoted])

    schema = "conv_id long, turn long, role string, text string, quotes array<struct<passage:int,level:int,print:string,weight:long>>, prints array<string>, n_quotes long"
    parsed = materialise(base.mapInPandas(parse, schema).withColumn("id", F.expr("uuid()")), "quotes-parsed")
    quotes = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("id", "conv_id", "turn", F.explode("quotes").alias("q")).select("id", "conv_id", "turn", "q.*")
    wanted = quotes.select("print").distinct()
    holders = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("prints").alias("print")).join(wanted, "print", "left_semi")
    near = holders.groupBy("print", "conv_id").agg(F.min("turn").alias("near_turn"))
    first = near.groupBy("print").agg(F.min(F.struct("conv_id", F.col("near_turn").alias("turn"))).alias("far"))
    second = near.join(first, "print").where(F.col("conv_id") != F.col("far.conv_id")).groupBy("print").agg(F.min(F.struct("conv_id", F.col("near_turn").alias("turn"))).alias("far2"))
    far = first.join(second, "print", "left")
    found = (
        quotes.join(near, ["print", "conv_id"], "left")
        .join(far, "print", "left")
        .withColumn("to", F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn"))).when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("far2")))
        .where("to IS NOT NULL")
    )
    # of the fingerprints of a passage the weightiest decides: the whole passage if it is known
    best = found.groupBy("id", "conv_id", "passage", "level").agg(F.max_by("to", F.struct("weight", -F.col("to.conv_id"), -F.col("to.turn"))).alias("to"), F.max("weight").alias("weight"))
    links = materialise(best.select("id", "conv_id", "level", "weight", "to"), "quotes-links")
    reply = links.groupBy("id", "conv_id").agg(F.count(F.lit(1)).alias("n_linked"), F.min_by("to", F.struct("level", -F.col("weight"), "to.conv_id", "to.turn")).alias("to")).drop("conv_id")
    there = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "id")
    before = there.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has_before")).distinct()
    answers = (
        there.join(reply, "id", "left").groupBy("conv_id", "turn").agg(F.min(F.struct("to.conv_id", "to.turn")).alias("to")).join(before, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("to.conv_id", F.when(F.col("has_before"), F.col("conv_id"))).alias("to_conv"), F.coalesce("to.turn", F.when(F.col("has_before"), F.col("turn") - 1)).alias("to_turn"), F.col("to.conv_id").isNotNull().alias("quoted"))
    )
    answers = materialise(answers, "quotes-answers")
    placed = answers.join(reply_positions(answers.drop("quoted")), ["conv_id", "turn"])
    roots = connected_components(links.where("conv_id <> to.conv_id").select(F.col("conv_id").alias("u"), F.col("to.conv_id").alias("v")))
    kept = F.col("cut").isNull()
    return (
        parsed.join(reply.drop("to"), "id", "left")
        .join(placed, ["conv_id", "turn"], "left")
        .join(roots, parsed["conv_id"] == roots["node"], "left")
        .select(
            "conv_id", "turn", "role", "text", "n_quotes",
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.when(kept, F.col("to_conv")).alias("reply_conv"),
            F.when(kept, F.col("to_turn")).alias("reply_turn"),
            F.when(~kept, "cut").when(F.col("quoted"), "quote").when(F.col("to_conv").isNotNull(), "turn").alias("reply_by"),
            F.coalesce("root", "conv_id").alias("thread_id"),
            F.col("position").alias("reply_position"),
        )
    )
