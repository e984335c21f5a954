"""A training corpus from documents: toxic ones go, near-duplicates leave one, contaminated ones go, sources are mixed, rows are sharded.

Each stage reads what the one before wrote, as Parquet in the folder that spark.checkpoint.dir names, and works on all of it. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm import decontaminate, mixing, sharding, simhash, toxicity
from grantlake.llm.common import Scratch, fields, packed, quoted, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the machine is trained on the labelled ones of docs. A null or empty text scores as one without words; rows that repeat go or stay together; columns may have any name."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose texts are near-duplicates, one row: that of the least id, or of no id if none has one.

    Rows are told apart by id, text and the other columns, so a group keeps its row whatever ids others
    repeat or lack. Among rows of the least id, hashes of text and columns decide; equal rows are one, so reruns agree. Null and
    empty texts are near-duplicates of each other; an empty table stays empty; columns may have any name.
    """
    scratch = Scratch(spark)
    row = F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.hex(F.xxhash64(docs["text"])), F.hex(F.xxhash64(*[docs[quoted(c)] for c in docs.columns])))
    fps = scratch.save(simhash.fingerprints(docs.select(F.struct(docs["doc_id"], row.alias("row")).alias("key"), docs["text"]), "key"), "rows")
    found = fps.join(simhash.groups(fps.select("key.doc_id", "fp").withColumnRenamed("doc_id", "key"), scratch), "fp")
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("key.doc_id").isNull(), "key.doc_id", "key.row")).alias("least")).select(F.col("least.row").alias("id"))
    return docs.select(row.alias("id"), packed(docs).alias("row")).join(keep, "id", "left_semi").dropDuplicates(["id"]).select(*fields(docs))


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which under one word in 20 is in a benchmark window; null and empty texts stay, rows that repeat go or stay together, an empty benchmark drops none, columns may have any name."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule takes them, in no order; one taken in part is cut. Rows without words are never taken; repeated rows are rows of their own; n_chars counts the text as it is then; columns may have any name."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and their place in it. Null ids share a shard, a null text counts as empty, repeated rows get slots of their own; a column with the name of a new one gives way."""
    return sharding.shard_records(docs)


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_duplicates), ("decontamination", without_contamination), ("mixing", mixed), ("sharding", sharded)]

#: A learnt classifier and fingerprints by XXH64 are beyond DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
