"""SimHash near-duplicate groups: exact pairs within a Hamming distance, found by a forest of vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, slices
from .components import components
from .vptree import VPTree, block_masks, leaf_links

#: Fingerprints that a forest is fitted on, at most (24 MB on the driver); every fingerprint is indexed.
SAMPLE = 3 << 20
#: The share of all fingerprints that a leaf aims at, border points included, and how many at most; the most that a task compares.
LEAF_SHARE, LEAF_SIZE, TASK_SIZE = 1 / 8, 1 << 17, 1 << 19
#: Up to so many fingerprints trees have a radius: beyond, a ball around a block's value holds more than a leaf should.
WITH_RADIUS = 1 << 29
SEED = 42


def simhash(text: bytes, n: int) -> int:
    """The 64-bit fingerprint of a text: its shingles of n words vote on each bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = ends - np.fromiter(map(len, words), np.int64, len(words))
    if len(words) < n:
        return xxhash.xxh64_intdigest(joined, SEED)
    counts, total = np.zeros(64, dtype=np.int64), len(words) - n + 1
    for at in range(0, total, 1 << 15):
        to = min(total, at + (1 << 15))
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + n - 1 : to + n - 1].tolist(), strict=True)), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """(key, fp): a signed 64-bit fingerprint of each whole text, A-Z lower-cased. A null or empty text has fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([simhash((t.as_buffer() or b"") and t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    slim = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].cast("string").alias("text"))
    return slim.mapInArrow(of, f"key {slim.schema['key'].dataType.simpleString()}, fp long")


def forest(sample: np.ndarray, n: int, within: int) -> list[VPTree]:
    """Trees for n fingerprints. No setting loses a pair.

    There are fewer blocks of bits than differences, so near pairs are within a radius in one of them, and points near a
    boundary visit every shard that it parts. Leaves hold a fixed share, so rows grow with the fingerprints, until
    that is too much for a task; from there on copies of a point grow to as many as there are values within the radius, some 20 a tree. Only with very many fingerprints are there more
    blocks than differences and unions of them as masks, on which near pairs agree.
    """
    small = max(1, (within + 2) // 2)  # a radius of 1 in one of so many blocks
    blocks = small if n <= WITH_RADIUS else next((m for m in (within + 1, within + 2, within + 4) if n >> (64 * (m - within) // m) <= 1 << 11), within + 4)
    leaf = max(8, int(len(sample) * min(LEAF_SHARE, LEAF_SIZE / max(n, 1))))
    return [VPTree.build(sample, mask, radius, leaf) for mask, radius in block_masks(blocks, within)]


def sample_size(n: int) -> int:
    """So many that a leaf has some 64 of them."""
    return min(SAMPLE, max(1 << 14, 64 * n // LEAF_SIZE))


def links(classes: DataFrame, scratch: Scratch, within: int) -> DataFrame:
    """(u, v), structs (least key, fp): links that join the same fingerprints as all pairs at distance <= within do."""
    n = classes.count()
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_size(n)).collect()], dtype=np.int64).view(np.uint64)
    trees = scratch.spark.sparkContext.broadcast(forest(sample, n, within))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(trees.value):
                for leaf, at in tree.route(points):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), leaf, np.int32)), *b.take(pa.array(at)).columns], names=["tree", "leaf", "fp", "least"])

    routed = scratch.save(classes.select("fp", "least").mapInArrow(route, "tree int, leaf int, fp long, least long"), "routed")
    # A leaf over TASK_SIZE is cut into parts; each pair of parts is a task of its own. The list holds a row a leaf at most, and leaves are bounded.
    # Leaves grow in number with the fingerprints, so only ones that no vantage point parts get there.
    hot = routed.groupBy("tree", "leaf").count().where(F.col("count") > TASK_SIZE).select("tree", "leaf", F.ceil(F.col("count") / (TASK_SIZE // 2)).cast("int").alias("parts"))
    parts = routed.join(F.broadcast(hot), ["tree", "leaf"], "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int")
    dealt = parts.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.select("tree", "leaf", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp", "least")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        tree = trees.value[int(part["tree"].iloc[0])]
        fp, least = part["fp"].to_numpy(), part["least"].to_numpy()
        found = np.array(leaf_links(fp.view(np.uint64), tree.mask, tree.radius, within), dtype=np.int64).reshape(-1, 2)
        i, j = found[:, 0], found[:, 1]
        return pd.DataFrame({"ul": least[i], "uf": fp[i], "vl": least[j], "vf": fp[j]})

    found = dealt.groupBy("tree", "leaf", "a", "b").applyInPandas(join, "ul long, uf long, vl long, vf long")
    node = lambda x: F.struct(F.col(f"{x}l").alias("least"), F.col(f"{x}f").alias("fp"))
    return found.select(node("u").alias("u"), node("v").alias("v"))


#: Stands for a missing id, which comes after all others.
NO_ID = (1 << 63) - 1


def groups(fps: DataFrame, scratch: Scratch, within: int = 4) -> DataFrame:
    """(fp, component_id, copies, root) for every fingerprint of fps (key, fp): root, a fingerprint, names its component also where ids do not."""
    classes = scratch.save(fps.groupBy("fp").agg(F.coalesce(F.min("key"), F.lit(NO_ID)).cast("long").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    comps = components(links(classes, scratch, within), scratch)
    named = classes.join(comps.select(F.col("node.fp").alias("fp"), "root"), "fp", "left")
    named = scratch.save(named.select("fp", F.nullif(F.coalesce("root.least", "least"), F.lit(NO_ID)).alias("component_id"), "copies", F.coalesce("root.fp", "fp").alias("root")), "named")
    scratch.drop("routed")
    return named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, within: int = 4, fps: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies: rows of the same fingerprint) for every row of docs.

    Rows link if their fingerprints differ in at most `within` bits; component_id is the least doc_id that
    links lead to, itself included. Equal fingerprints are one class; classes are routed through a
    forest of vantage-point trees, pairs are found exactly leaf by leaf, and links join up to
    components in the cluster. Nothing but a bounded sample and counts by leaf comes to the driver.

    Null and empty texts have fingerprint 0 and link like any other. A row without a doc_id links others
    but names no component (null if no row of its component has an id). Repeated rows come back as often
    as they came; rows that share a doc_id but not a text keep their own fingerprints.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs, key, text, n), "fps") if fps is None else fps
    out = fps.join(groups(fps, scratch, within), "fp")
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
