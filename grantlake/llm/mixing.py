"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, fields, n_words, packed, quoted, running_sum

#: Words of a block, at most; small mixes have smaller blocks, so that there are SLOTS or so.
BLOCK, SLOTS = 2048, 1 << 16
#: Up to this many sources their table is sent to all executors (a few MB); above, it is joined.
BROADCAST_SOURCES = 50_000


@dataclass
class Source:
    """One source: its place in order, its words and its target."""

    index: int
    name: str | None
    size: int
    target: float


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; a share stops at most times its size and what it leaves is reshared by weight until none is above.

    Filling in the order of cap over weight gives that fixed point: the level at which the first
    unfilled source stays below its cap holds for all after it.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, rest, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for n, i in enumerate(order):
        if most * sizes[i] > left / rest * weights[i]:
            level = left / rest
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[i] = most * float(sizes[i])
        left, rest = left - out[i], rest - weights[i]
    return out


@dataclass
class Mix:
    """sources: the table of sources. block, slots: words of a block and number of slots. schedule: slot, source, block.
    docs: the rows with their place in their source's shuffled stream. pieces: slot, source, place, epoch, words that the slots take."""

    sources: list[Source]
    block: int
    slots: int
    schedule: DataFrame
    docs: DataFrame
    pieces: DataFrame


def van_der_corput(slot: Column, bits: int) -> Column:
    """The van der Corput point of a slot times 2^bits: its bits reversed."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("long")


def schedule(spark: SparkSession, shares: Sequence[tuple[int, float]], whole: float, slots: int, point=van_der_corput) -> DataFrame:
    """(slot, source, block) for slots 0 to slots - 1: which block of which source comes at a slot.

    shares: (source, target), whole: their sum. The point of a slot falls into a source's stretch of the cumulative shares, on a grid of
    2^bits; blocks are ranked by slot in each source. Of any first n slots a source has its share
    but for some log2(n) at most. How many slots a source has, and so how many blocks are taken, is decided here alone.
    """
    want = [(i, t) for i, t in shares if t > 0]
    if not want or not slots:
        return spark.createDataFrame([], "slot long, source int, block long")
    bits = max(1, (slots - 1).bit_length())
    ends, ids = np.array([ceil(x / whole * 2**bits - 1e-6) for x in np.cumsum([t for _, t in want]).tolist()]), np.array([i for i, _ in want], dtype=np.int32)

    @F.pandas_udf("int")
    def source_at(x: pd.Series) -> pd.Series:
        return pd.Series(ids[np.minimum(np.searchsorted(ends, x.to_numpy(), side="right"), len(ids) - 1)])

    at = spark.range(slots).select(F.col("id").alias("slot"), source_at(point(F.col("id"), bits)).alias("source"), F.shiftright("id", max(0, bits - 8)).alias("part"))
    return running_sum(at, ["source"], "part", [F.col("slot")], F.lit(1), "block").select("slot", "source", "block")


def measured(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """A row of docs as `row`, its source, size, hash of its key, hash of its text, and bucket (the hash's first digits)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(docs[quoted(key)].cast("string"), F.lit("null")), F.lit(seed)))
    at = docs.select(packed(docs).alias("row"), docs[quoted(source)].alias("name"), n_words(docs[quoted(text)]).alias("size"), digest.alias("hash"), F.xxhash64(docs[quoted(text)]).alias("tie"))
    return at.withColumn("bucket", F.substring("hash", 1, 3))


def mix_sources(at: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, block: int | None = None, point=van_der_corput) -> Mix:
    """Sources, schedule and pieces of a mix of rows as measured() makes them.

    Sources in code-point order, null last, take weights in turn and share budget times all words;
    none passes most times its own (whole epochs, then a last partial one). Each source's documents
    are shuffled by a hash of key and seed and laid end to end, once an epoch; the stream is cut into blocks of
    `block` words (BLOCK, or as many as make SLOTS slots if that is less). The budget fills so many
    slots; the schedule gives each to a source, and a source's rank-th slot takes its rank-th block.
    A slot whose source has no block left takes nothing. So a source's words are within some
    log2(slots) blocks of its target. The join is on (source, block), so its keys are even however
    large a source is. Sums by source and bucket are made once, in one pass over the texts; a row a
    source comes to the driver.

    A null text or one without words has size 0 and is never taken; an empty table gives an empty mix.
    Repeated rows are rows of their own. Reruns agree: nothing depends on partitions.
    """
    spark = at.sparkSession
    kind = at.schema["name"].dataType.simpleString()
    sums = Scratch(spark).save(at.groupBy("name", "bucket").agg(F.sum("size").alias("_sum")), "sums")
    found = sorted(((r[0], int(r[1])) for r in sums.groupBy("name").agg(F.sum("_sum")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes, total = [n for _, n in found], min(budget, most) * sum(n for _, n in found)
    wanted = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], total, most)
    sources = [Source(i, name, n, t) for i, ((name, n), t) in enumerate(zip(found, wanted, strict=True))]
    block = block or max(1, min(BLOCK, ceil(total / SLOTS)))
    slots = int(total / block + 0.5)
    table = spark.createDataFrame([(s.index, s.name, s.size, s.target, int(most * s.size)) for s in sources], f"source int, known {kind}, source_size long, target double, words long")
    table = F.broadcast(table) if len(sources) <= BROADCAST_SOURCES else table
    named = lambda df: df.join(table, df["name"].eqNullSafe(table["known"])).drop("known", "name")
    placed = running_sum(named(at), ["source"], "bucket", [F.col("hash"), F.col("size"), F.col("tie")], F.col("size"), "start", named(sums).select("source", "bucket", "_sum")).drop("bucket", "hash", "tie")
    order = schedule(spark, [(s.index, s.target) for s in sources], total, slots, point)

    first = F.col("epoch") * F.col("source_size") + F.col("start")
    epochs = placed.where("size > 0").select("source", "start", "size", "source_size", "words", F.explode(F.sequence(F.lit(0), F.lit(ceil(most) - 1))).alias("epoch"))
    epochs = epochs.select("source", "start", "epoch", first.alias("a"), F.least(first + F.col("size"), F.col("words")).alias("z")).where("a < z")
    cut = epochs.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))))
    share = F.least("z", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    pieces = cut.join(order, ["source", "block"]).select("slot", "source", "start", "epoch", share.alias("words"))
    return Mix(sources, block, slots, order, placed, pieces)


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), first_slot (of the schedule; null if not taken).

    Texts are read once: sizes and hashes are written to the shared folder and all else goes on from there. Nulls, ties
    and the rest as in mix_sources(); columns of docs other than the three are not read.
    """
    at = measured(docs.select(docs[quoted(key)].alias("doc_id"), docs[quoted(text)].alias("text"), docs[quoted(source)].alias("source")), "doc_id", "text", "source", seed)
    mix = mix_sources(Scratch(docs.sparkSession).save(at.select(F.col("row.doc_id").alias("doc_id"), "name", "size", "hash", "tie", "bucket").withColumn("named", F.col("name")), "measured"), **how)
    taken = mix.pieces.groupBy("source", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumn("some", F.lit(True))
    out = mix.docs.withColumn("some", F.col("size") > 0).join(taken, ["source", "start", "some"], "left")
    return out.select("doc_id", F.col("named").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", slot: str | None = None, **how) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each epoch in which slots take words of a document; one taken in part is cut to so many first words.

    slot names one more column, the first slot of the row in the schedule; in its order, sources come by
    their shares. A column of docs of that name, in whatever case, gives way; others may have any name. n_chars, if there, counts the cut text.
    """
    mix = mix_sources(measured(docs, key, text, source, seed), **how)
    taken = mix.pieces.groupBy("source", "start", "epoch").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    out = mix.docs.where("size > 0").join(taken, ["source", "start"])
    body = F.col("row")[text]
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), 0), 1, F.col("taken").cast("int")), " ")).otherwise(body)
    out = out.withColumn("cut", cut)
    kept = [F.col("cut").alias(text) if n == text else F.length("cut").cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else c for c, n in zip(fields(docs), docs.columns, strict=True)]
    kept = [c for c, n in zip(kept, docs.columns, strict=True) if not slot or n.lower() != slot.lower()]
    return out.select(*kept, *([F.col("slot").alias(slot)] if slot else []))
