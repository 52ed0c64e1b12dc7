"""Scans and sinks: CSV tables with row numbers, Markdown and plain-text sections, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of texts whose blocks a worker gathers before it hands them on; one text may have more.
MOST_CHARS = 500_000


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Rows of CSV files as text cells with source_file and row_number (2 is the first below the header).

    Quoted cells may hold line ends, so a file is one partition and its rows are numbered in order. Raises ValueError
    for empty or repeated column names.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if header is None else spark.read.option("multiLine", True).csv(path, schema=", ".join(f"`{h}` string" for h in header))
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names) or not all(names) or any(n.startswith("_c") for n in names):
        raise ValueError("columns need different, non-empty names")
    df = df.toDF(*names)
    id_ = F.monotonically_increasing_id()
    out = df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("_id", id_)
    low = out.groupBy("source_file").agg(F.min("_id").alias("_low"))
    blank = F.coalesce(F.length(F.trim(F.concat_ws("", *[F.col(c) for c in names]))), F.lit(0)) == 0
    return out.join(low, "source_file").withColumn("row_number", F.col("_id") - F.col("_low") + 2).where(~blank).drop("_id", "_low")


def sections(docs: DataFrame, key: str, text: str, markdown: bool = True) -> DataFrame:
    """key, ordinal, heading_path, kind, text of the blocks of texts: ATX headings, list items and paragraphs.

    Plain text has blocks between blank lines only.
    """
    import re

    def parse(body: str) -> list[tuple[list[str], str, str]]:
        out, path, held = [], [], []

        def flush() -> None:
            if held:
                out.append(([h for _, h in path], "paragraph", " ".join(held)))
                held.clear()

        for line in body.split("\n"):
            head = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line) if markdown else None
            item = re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", line) if markdown else None
            if head:
                flush()
                while path and path[-1][0] >= len(head[1]):
                    path.pop()
                path.append((len(head[1]), head[2]))
            elif item:
                flush()
                out.append(([h for _, h in path], "item", item[1].strip()))
            elif not line.strip():
                flush()
            else:
                held.append(line.strip())
        flush()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, n = [], [], 0

            def made(batch=batch) -> pa.RecordBatch:
                ordinals, paths, kinds, blocks = zip(*held, strict=True) if held else ((), (), (), ())
                columns = [pa.array(ordinals, pa.int32()), pa.array(paths, pa.list_(pa.string())), pa.array(kinds, pa.string()), pa.array(blocks, pa.string())]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *columns], [key, "ordinal", "heading_path", "kind", "block"])

            for i, t in enumerate(batch.column(1)):
                body = t.as_py() or ""
                found = parse(body)
                rows += [i] * len(found)
                held += [(j, *x) for j, x in enumerate(found)]
                n += len(body)
                if n >= MOST_CHARS:  # what a worker holds does not grow with the batch
                    yield made()
                    rows, held, n = [], [], 0
            yield made()

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ordinal int, heading_path array<string>, kind string, block string")


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Parquet under path, a folder for each value of the partition columns; rows of one value meet in few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def scoped(df: DataFrame, workspace: str | None, column: str = "workspace_id") -> DataFrame:
    """Rows of one workspace, the first filter of any plan; without a workspace nothing is read."""
    if not workspace:
        raise PermissionError("no workspace is set")
    return df.where(F.col(column) == workspace)
