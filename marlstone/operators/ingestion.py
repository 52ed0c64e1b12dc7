"""Ingestion: sections, token spans, overlapping windows, version activation, deduplicated uploads and purge."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token: a run of word characters, or one other mark.
TOKEN = r"\w+|[^\w\s]"
WINDOW, OVERLAP = 192, 32
#: Tokens that a worker gathers before it hands their offsets on; one text may have more.
MOST_TOKENS = 50_000


def token_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, starts, ends: character offsets of the tokens of a text."""
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).finditer
        for batch in batches:
            begun, at, ends = 0, array("i"), [0]

            def made(end: int, batch=batch) -> pa.RecordBatch:
                spans, places = np.array(at, np.int32).reshape(-1, 2), pa.array(ends, pa.int32())
                columns = [pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(c))) for c in (spans[:, 0], spans[:, 1])]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begun, end - begun), *columns], [key, "starts", "ends"])

            for i, t in enumerate(batch.column(1)):
                for m in find(t.as_py() or ""):
                    at.extend(m.span())
                ends.append(len(at) // 2)
                if len(at) >= 2 * MOST_TOKENS:  # what a worker holds does not grow with the batch
                    yield made(i + 1)
                    begun, at, ends = i + 1, array("i"), [0]
            yield made(batch.num_rows)

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, starts array<int>, ends array<int>")


def windows(spans: DataFrame, key: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """key, ordinal, first, last, char_start, char_end of windows of ``size`` tokens; the last one ends at the text's end."""
    n, stride = F.size("starts"), size - overlap
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(float(stride))).cast("int")))
    out = spans.withColumn("n", n).withColumn("count", count).where("count > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    first = F.col("ordinal") * stride
    out = out.withColumn("first", first).withColumn("last", F.least(F.col("n"), first + size))
    return out.select(key, "ordinal", "first", "last", F.element_at("starts", F.col("first") + 1).alias("char_start"), F.element_at("ends", F.col("last")).alias("char_end"))


def bad_spans(children: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Windows that break the span contract: outside their text, empty, or beginning or ending with white space."""
    joined = children.join(docs.select(key, text), key)
    part = F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    ok = (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.col("char_end") <= F.length(text)) & (F.trim(part) == part)
    return joined.where(~ok).select(key, "ordinal")


def fresh_uploads(uploads: DataFrame, live: DataFrame, content: str) -> DataFrame:
    """Uploads whose content no live version has, once for each content (the first upload), with their digest."""
    own = uploads.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    first = own.groupBy("digest").agg(F.min_by(F.struct(*uploads.columns), "upload_id").alias("u")).select("digest", "u.*")
    return first.join(live.select("digest"), "digest", "left_anti")


def next_versions(fresh: DataFrame, versions: DataFrame) -> DataFrame:
    """fresh with the version number that follows the source's last one."""
    last = versions.groupBy("source").agg(F.max("version").alias("last"))
    return fresh.join(last, "source", "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last")


def active_versions(sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Current version of each source that is not deleted and is ready."""
    live = sources.where("deleted_at IS NULL").select("source", F.col("current_version").alias("version"))
    return versions.where(F.col("status").isin("ready", "ready_degraded")).join(live, ["source", "version"])


def activate(sources: DataFrame, ready: DataFrame) -> DataFrame:
    """Sources with newer ready versions made current; older ones never replace newer ones."""
    newest = ready.groupBy("source").agg(F.max("version").alias("new"))
    out = sources.join(newest, "source", "left")
    return out.withColumn("current_version", F.greatest("current_version", "new")).drop("new")


def purge(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Derived rows without those of purged versions."""
    return rows.join(gone.select(*on).distinct(), on, "left_anti")


def redact(dependants: DataFrame, key: str, array: str, gone: DataFrame, text: str, marker: str = "[source deleted]") -> DataFrame:
    """dependants that name a handle of a purged version (source, version) lose their text; the others stay as they are."""
    from .retrieval import handle_parts

    named = dependants.select(key, F.explode(array).alias("_h")).select(key, handle_parts(F.col("_h")).alias("_p")).where("_p IS NOT NULL").select(key, "_p.source", "_p.version")
    touched = named.join(gone.select("source", "version").distinct(), ["source", "version"], "left_semi").select(key).distinct().withColumn("_hit", F.lit(True))
    return dependants.join(touched, key, "left").withColumn(text, F.when(F.col("_hit"), F.lit(marker)).otherwise(F.col(text))).drop("_hit")


def tombstoned(cards: F.Column, gone: F.Column) -> F.Column:
    """Citation cards (structs with handle and source_code) in their order; those of purged sources keep only these two, and purged.

    gone is an array of source codes. All cards get the field purged; the other fields of a purged one are null.
    """
    out = lambda c: F.array_contains(gone, c["source_code"])
    return F.transform(cards, lambda c: F.when(out(c), F.struct(c["handle"].alias("handle"), c["source_code"].alias("source_code"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("purged"))).otherwise(F.struct(c["handle"].alias("handle"), c["source_code"].alias("source_code"), c["title"].alias("title"), F.lit(False).alias("purged"))))


def missing_embeddings(children: DataFrame, cache: DataFrame, model: str, text: str) -> DataFrame:
    """Distinct texts that the cache of a model lacks, by digest."""
    wanted = children.select(F.sha2(F.concat_ws("\u0000", F.lit(model), F.col(text)), 256).alias("digest"), text).dropDuplicates(["digest"])
    return wanted.join(cache.select("digest"), "digest", "left_anti")


def hash_vectors(docs: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, vector: deterministic unit vectors of texts, for tests and health checks."""
    import hashlib

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b[text]:
                x = np.random.default_rng(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")).standard_normal(size)
                out.append((x / np.linalg.norm(x)).astype("float32"))
            yield pd.DataFrame({key: b[key], "vector": out})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, vector array<float>")


def health_sample(children: DataFrame, key: str, n: int) -> DataFrame:
    """A sample that does not change between runs: the first rows by the digest of their ids."""
    return children.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def source_code(filename) -> F.Column:
    """Code of a file: its name without extension, upper-case letters and digits with single hyphens."""
    stem = F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", "")
    return F.substring(F.trim(F.regexp_replace(F.upper(stem), r"[^A-Z0-9]+", "-"), F.lit("-")), 1, 32)
