"""Benchmark decontamination: a hash set of normalised test windows, scanned over training texts and verified."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, quoted, slices

#: Words of one block of benchmark items, the most that is sent to executors at once (about 200 MB there). A larger benchmark goes block by block.
BLOCK_WORDS = 1_000_000
#: A-Z become a-z; 0-9, a-z and all bytes of characters beyond ASCII stay; the rest separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n ids in a row."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = h * BASE + ids[k : k + len(h)]
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of some items: a sorted array of hashes to screen with and the windows themselves to verify with."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = defaultdict(list)
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            words = normal_words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            size = min(n, len(ids))
            if size:
                found[size].append(rolling(ids, size))
                for at in {ids[i : i + size].tobytes() for i in range(len(ids) - size + 1)}:
                    self.items[at].append(item)
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in sorted(found.items())}

    def scan(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Marks the words in any occurrence of a window and collects the items that have one."""
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, hashes in self.hashes.items():
            starts = np.nonzero(known[size:] - known[:-size] == size)[0] if len(ids) >= size else ()
            if not len(starts):
                continue
            h = rolling(ids, size)[starts]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in starts[hashes[at] == h].tolist():
                if owners := self.items.get(ids[i : i + size].tobytes()):
                    hit[i : i + size] = True
                    items.update(owners)


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most BLOCK_WORDS words (an item alone may be longer)."""
    block, size = [], 0
    for r in benchmark.select(benchmark[item].cast("string"), benchmark[text]).toLocalIterator():
        n = len(normal_words((r[1] or "").encode()))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0] or "", (r[1] or "").encode()))
        size += n
    yield block


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13) -> DataFrame:
    """docs with two more columns, the last: the words that are hit (binary: a byte a word, 1 where it is in an occurrence of a window) and the ids of items with occurrences.

    The two are named hits and items, with underscores where docs has such a column, in whatever case. A window is n words
    of an item in a row, or all of a shorter item's. Words are runs of ASCII letters
    and digits and of characters beyond ASCII, lower-cased in A-Z. Every hit of the hash set is verified
    word by word. The scan is one pass without a shuffle for each block of the benchmark; the driver holds a
    block at a time, and after each but the last the state is written to the shared folder, so memory is bounded by a block whatever the
    benchmark's size.

    An item without words, or null, has no window; a null or empty text has no words; very long texts are scanned whole; an empty
    benchmark hits nothing; an empty table stays empty. An item without an id counts as item ""; items with equal windows are all named,
    and an id that two items share is named once. Rows that repeat are scanned one by one, alike.
    """
    scratch, names = Scratch(docs.sparkSession), fresh(docs.columns, "hits", "items")
    at = docs.select("*", F.lit(None).cast("binary").alias(names[0]), F.array().cast("array<string>").alias(names[1]))
    place, todo, i = docs.columns.index(text), blocks(benchmark, item, item_text), 0
    block = next(todo)
    while block is not None:
        sent, after = docs.sparkSession.sparkContext.broadcast(Windows(block, n)), next(todo, None)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                hits, found = [], []
                for t, h, x in zip(b.column(place), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                    words = normal_words(t.as_buffer().to_pybytes()) if t.is_valid else []
                    hit = np.frombuffer(h.as_py(), np.bool_).copy() if h.is_valid else np.zeros(len(words), dtype=np.bool_)
                    items = set(x.as_py())
                    sent.value.scan(words, hit, items)
                    hits.append(hit.tobytes()), found.append(sorted(items))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=b.schema.names)

        at = at.mapInArrow(scan, at.schema)
        if after is not None:
            at = scratch.save(at, f"after-{i}")
            sent.destroy()
        block, i = after, i + 1
    return at


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = 13, share: int = 20) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated (share * n_hit >= n_words and n_hit > 0).

    Nulls, empty and long texts, repeats and empty tables as in scan_benchmark(): a text without words has zeros, the hash of
    no ids and is not contaminated; a null key is kept. A document with exactly one hit word in `share` is contaminated. Other columns of docs are not read.
    """
    found = scan_benchmark(docs.select(docs[quoted(key)].alias("doc_id"), docs[quoted(text)].cast("string").alias("text")), benchmark, "doc_id", "text", item, n=n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hits = [np.frombuffer(h.as_py(), np.bool_) for h in b.column(2)]
            items = b.column(3).to_pylist()
            words, hit = np.array([len(h) for h in hits], dtype=np.int64), np.array([int(h.sum()) for h in hits], dtype=np.int64)
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    out = found.mapInArrow(count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 13, share: int = 20, remove: str = "documents") -> DataFrame:
    """docs without contamination, in their columns.

    remove="documents" drops those in which hit words are at least one in `share`; remove="spans" keeps
    every document and cuts the hit words, with what stands between two of them, from its text. Nulls, empty and long texts,
    repeats and empty tables as in scan_benchmark(): a text without words stays as it is, rows that repeat go or stay
    together, and columns may have any name.
    """
    names = docs.columns
    found = scan_benchmark(docs, benchmark, text=text, n=n)
    place, spans = names.index(text), remove == "spans"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hits = [np.frombuffer(h.as_py(), np.bool_) for h in b.column(b.num_columns - 2)]
            cols = list(b.columns[:-2])
            if spans:
                texts = [without(t.as_py(), h) if h.any() else t.as_py() for t, h in zip(cols[place], hits, strict=True)]
                cols[place] = pa.array(texts, b.schema.field(place).type)
            out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out if spans else out.filter(pa.array([not (h.any() and share * int(h.sum()) >= len(h)) for h in hits]))

    return found.mapInArrow(keep, docs.schema)


def without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and without what stands between two hit words in a row."""
    raw = text.encode()
    marks = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    gone = np.zeros(len(raw), dtype=bool)
    for i in np.nonzero(hit)[0]:
        gone[starts[i] : starts[i + 1] if i + 1 < len(hit) and hit[i + 1] else ends[i]] = True
    return np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
