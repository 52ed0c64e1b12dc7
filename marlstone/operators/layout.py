"""Structure of laid-out pages: headings, paragraphs and lists from the sizes and places of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sizes in points above the body's that make headings, below it that make running lines, and the gap of paragraphs.
HEADING_DELTA, TOP_DELTA, FOOTER_DELTA = 2.0, 5.0, -2.0
GAP_RATIO, HEADING_CHARS = 0.45, 160
BULLETS = ("- ", "* ", "• ")


def body_sizes(lines: DataFrame, key: str) -> DataFrame:
    """key, body: the size that most characters of a document have; ties go to the size that comes first."""
    per = lines.groupBy(key, "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line")).alias("first"))
    return per.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "size"))["size"].alias("body"))


def layout(lines: DataFrame, key: str) -> DataFrame:
    """key, page, unit, kind, list_run, heading_path, text: paragraphs and list items of documents, in order.

    lines: key, page, line, text, size, top, bottom. Lines two points or more below the body are running headers and footers and
    go. Larger ones of up to 160 characters are headings: five points more and they open a new path, else they stand below
    its first heading. A gap of more than 0.45 of the body's size begins a paragraph; other lines go on with the unit
    before. Items without a unit between them are one run. Units end at headings and pages. Lines without text are
    none. Line numbers tell lines of a page apart.
    """
    base = lines.select(key, "page", "line", "text", "size", "top", "bottom").where(F.trim("text") != "")
    sized = base.join(body_sizes(base, key), key).withColumn("delta", F.col("size") - F.col("body")).where(F.col("delta") > FOOTER_DELTA)
    page, whole = Window.partitionBy(key, "page").orderBy("line"), Window.partitionBy(key).orderBy("page", "line")
    head = (F.col("delta") >= HEADING_DELTA) & (F.length("text") <= HEADING_CHARS)
    item = ~head & F.substring("text", 1, 2).isin(*BULLETS)
    marked = sized.withColumn("head", head).withColumn("item", item)
    gap = F.col("top") - F.lag("bottom").over(page)
    begins = ~F.col("head") & (F.col("item") | F.coalesce(gap > GAP_RATIO * F.col("body"), F.lit(True)) | F.coalesce(F.lag("head").over(page), F.lit(True)))
    begun = marked.withColumn("begins", begins)

    at = F.struct("page", "line")
    top = F.col("head") & (F.col("delta") >= TOP_DELTA)
    last_top = F.last(F.when(top, F.struct(at.alias("at"), "text")), ignorenulls=True).over(whole)
    first_sub = F.first(F.when(F.col("head") & ~top, F.struct(at.alias("at"), "text")), ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last_head = F.last(F.when(F.col("head"), F.struct(at.alias("at"), "text", top.alias("top"))), ignorenulls=True).over(whole)
    pathed = begun.withColumns({"_top": last_top, "_sub": first_sub, "_last": last_head, "_block": F.sum(F.col("head").cast("int")).over(page), "unit": F.sum(F.col("begins").cast("int")).over(page)})
    root = F.coalesce(F.col("_top.text"), F.when(F.col("_sub.at") < F.col("_last.at"), F.col("_sub.text")))
    path = F.when(F.col("_last").isNull(), F.array().cast("array<string>")).when(F.col("_last.top") | root.isNull(), F.array("_last.text")).otherwise(F.array(root, F.col("_last.text")))
    rows = pathed.withColumn("heading_path", path).where(~F.col("head"))

    said = F.when(F.col("item"), F.trim(F.substr("text", F.lit(3)))).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", said.alias("t")))), lambda x: x["t"]), " ")
    units = rows.groupBy(key, "page", "_block", "unit").agg(F.min("line").alias("_at"), F.bool_or(F.col("item") & F.col("begins")).alias("_item"), F.any_value("heading_path").alias("heading_path"), joined.alias("text"))
    follows = F.lag("_item").over(Window.partitionBy(key, "page", "_block").orderBy("_at"))
    runs = units.withColumn("_new", (F.col("_item") & ~F.coalesce(follows, F.lit(False))).cast("int"))
    run = F.sum("_new").over(Window.partitionBy(key).orderBy("page", "_at"))
    return runs.select(
        key, "page", F.row_number().over(Window.partitionBy(key, "page").orderBy("_at")).alias("unit"), F.when(F.col("_item"), "item").otherwise("paragraph").alias("kind"),
        F.when(F.col("_item"), run).alias("list_run"), "heading_path", "text",
    )


def thin_pages(lines: DataFrame, key: str, least_words: int) -> DataFrame:
    """key, page, words of the pages with fewer than ``least_words`` words outside running lines."""
    sized = lines.join(body_sizes(lines.where(F.trim("text") != ""), key), key)
    words = F.when(F.col("size") - F.col("body") > FOOTER_DELTA, F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))).otherwise(0)
    return sized.groupBy(key, "page").agg(F.sum(words).alias("words")).where(F.col("words") < least_words)
