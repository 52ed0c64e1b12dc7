"""Queries of the training-data operators, for the driver; their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_path
    from .warc import archived_pages, read_records, reassemble, write_archives

    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return archived_pages(reassemble(read_records(spark, path)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import load_ranks
    from .common import new_path
    from .packing import pack, read_matrices, token_ids, write_matrices

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    end, path = max(load_ranks(file).values()) + 1, new_path(spark, "packed")
    write_matrices(pack(_table(spark, sf_dir, "documents"), end_id=end, pad_id=end + 1, ids=token_ids(file, public_tokenizers.PATTERN)), path)
    packed = read_matrices(spark, path)
    return packed.select("pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_decode(_table(spark, sf_dir, "documents"), path, pattern, digests=True).drop("ids")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link_quotes

    return link_quotes(_table(spark, sf_dir, "conversations"))


def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).drop("source", "copies")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_site_style_tree": op6_site_style_tree,
    "op7_prefix_free_parsing": op7_prefix_free_parsing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_pareto_mix": op11_pareto_mix,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}
