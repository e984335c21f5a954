"""The registered queries of this subpackage: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, license_scan, line_dedup, mixing, quality, sharding, simhash, substring, token_files, toxicity
from .common import table
from .sql import ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that are on a tenth or more of their site's pages."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its fingerprint and the component of fingerprints at 4 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a passage of 50 words or more that other documents share."""
    return substring.find_passages(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: how many of its words the schedule takes, and from which slot on."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its counts, whether the base fails and whether it is kept."""
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document and licence notice in it."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its shard of 24 and its place in it, and its shard of 25."""
    return sharding.shard_records(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """A row a document, read back from the files: where its ids start, how many and their CRC-32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder, files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer)
    return token_files.read_token_files(spark, folder, files).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: how many of its words are in benchmark windows and of which items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its score by a machine that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_line_dedup, op2_simhash, op3_substring, op4_mixing, op5_quality, op6_license_scan, op7_sharding, op8_token_files, op9_decontamination, op10_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  fails here, at once, if the pipeline is broken

    return {f.__name__: f for f in OPERATORS} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
