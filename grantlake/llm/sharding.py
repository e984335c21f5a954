"""Sharding by weighted rendezvous hashing (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, packed, quoted, running_sum

#: Hex digits of an MD5 that make a uniform number, and where the first and second of a digest start.
DIGITS, STARTS = 13, (1, 17)


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from key and shard alone; any engine with MD5 computes the same. A digest serves two shards."""
    digest = F.md5(F.concat_ws(":", F.lit("shard"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard // 2))))
    digits = F.conv(F.substring(digest, STARTS[shard % 2], DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def scores(key: Column, weights: Sequence[float]) -> Column:
    """An array of (score, shard): the largest wins. -w / ln(u) gives each shard its share by weight."""
    return F.array(*[F.struct((-float(w) / F.log(uniform(key, i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])


def shard_records(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 24, grown_weight: float = 1.0) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard appended.

    The key and the weights alone decide a row's shard, so a row keeps its shard whatever else is in
    the table; grown_shard is its shard once one more of grown_weight is added, which differs only
    where the new shard wins. slot numbers the rows of a shard from 0 without gaps, in the order of a
    hash of the key, so it is spread over the cluster: no task holds a whole shard. size is the text's
    UTF-8 bytes plus 8.

    Null keys share one shard; a null text counts as empty (size 8, CRC 0). Rows that repeat a key
    share its shard and get slots of their own. An empty table gives an empty one. A column of docs with the
    name of a new one, in whatever case, gives way; others may have any name.
    """
    n = len(weights)
    if not n or min(weights) <= 0 or grown_weight <= 0:
        raise ValueError("weights must be positive")
    k, body = docs[quoted(key)], F.coalesce(docs[quoted(text)].cast("string"), F.lit(""))
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    at = docs.select(
        packed(docs).alias("row"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        scores(k, [*weights, grown_weight]).alias("scores"),
        F.md5(F.coalesce(k.cast("string"), F.lit("null"))).alias("hash"),
    )
    at = at.select("*", F.array_max(F.slice("scores", 1, n))["shard"].alias("shard"), F.array_max("scores")["shard"].alias("grown_shard"), F.substring("hash", 1, 3).alias("bucket")).drop("scores")
    at = running_sum(at, ["shard"], "bucket", [F.col("hash"), F.col("text_crc32"), F.col("size")], F.lit(1), "slot")
    return at.select(*fields(docs, but=new), *new)
