"""Token-ID files: independent zstandard frames with a trailing seek table and checksums, so that a reader decompresses only what it asks for.

A file is a row of zstandard frames and a seek table in the public seekable format (a skippable frame,
0x184D2A5E: for each frame its compressed and decompressed size and the low 32 bits of the XXH64 of its
content, all little-endian; then the number of frames, a flag byte 0x80 and 0x8F92EAB1). Data frames hold
whole documents, one after another, as little-endian unsigned 32-bit ids. The last frame before the
table is the index: the number of documents, their keys as signed 64-bit integers in ascending order,
their numbers of ids as unsigned 64-bit integers, and a byte each that is 1 where the key is null.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.scratch import scratch_root

SKIPPABLE, FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: A data frame is closed at this many bytes of ids (a longer document is a frame alone).
FRAME_BYTES = 1 << 18
#: Bytes of input that a file aims at, where that makes more files than spark.sql.shuffle.partitions, but at most so many.
FILE_BYTES, MOST_FILES = 1 << 28, 100_000
#: Words and ids that a worker remembers (120 MB or so), and characters beyond which a word is not remembered.
CACHE_WORDS, CACHE_IDS, CACHE_LENGTH = 500_000, 4_000_000, 64
#: Bytes of text that are encoded at a time, and words in one call of the tokenizer.
STEP_BYTES, CALL_WORDS = 1 << 24, 1024
#: Stands for a null key in the index, beside its mark.
LEAST = -(1 << 63)
#: Parts words in a call.
MARK = "~"
#: Letters of all Unicode versions, ASCII marks but the apostrophe, which has rules of its own.
LETTER_THEN_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"
#: Fixed value: the pattern of a public vocabulary, which keeps letters, marks and white space apart.
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(spec: dict) -> bool:
    """Whether a tokenizer's settings (its JSON) say that the ids of a text are those of its words (between ASCII white space) in a row.

    So it is if the normaliser changes no word by its neighbours and the splitter drops white space and
    parts letters from ASCII marks. True only for settings that are known to be so; anything else is encoded text by text.
    """

    def steps(x: dict | None, many: str) -> list[dict]:
        return [] if x is None else x[many] if x["type"] == "Sequence" else [x]

    def harmless(x: dict) -> bool:
        return x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "

    split = steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = [x for x in split if x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True)]
    first = split[:1] and split[0]["type"] == "Split" and split[0]["pattern"] == {"Regex": PARTING} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    added = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    lower = [x["type"] for x in steps(spec.get("normalizer"), "normalizers")][-1:] == ["Lowercase"]
    return bool(first and len(split) == 1 + len(plain) and added and lower and all(map(harmless, steps(spec.get("normalizer"), "normalizers"))) and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout"))


class Encoder:
    """Ids of whole texts by a tokenizer: .json of the tokenizers library or .model of sentencepiece.

    Where the tokenizer's settings allow it (parts_words), the words of many texts are told apart by Arrow, each
    distinct one is looked up or encoded once, and ids are put together by NumPy. Words are remembered
    from step to step, within bounds. Any other tokenizer gets every text whole.
    """

    def __init__(self, path: str):
        self.by_word, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_all = lambda texts: model.encode(texts, num_threads=1)
            return
        if not path.endswith(".json"):
            raise ValueError(f"a tokenizer is a .json of the tokenizers library or a .model of sentencepiece, not {path}")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_all = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(tokenizer.to_str())
        mark = self.encode_all([f"{MARK} {MARK}"])[0]
        if parts_words(spec) and len(mark) == 2 and mark[0] == mark[1]:
            self.by_word, self.mark, self.special = True, mark[0], [t["content"] for t in spec.get("added_tokens", [])]
            self.forget()

    def forget(self) -> None:
        self.known, self.n_words, self.n_ids = {}, 0, 0
        self.pool, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, which are held for a step at a time."""
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, side="right")))
            some = texts.slice(at, to - at)
            yield from self.words(some) if self.by_word else (np.array(x, np.uint32) for x in self.encode_all(some.to_pylist()))
            at = to

    def words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = np.zeros(len(texts), dtype=bool)  # texts with special tokens, which may also stand within words
        for s in self.special:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        kept = pc.if_else(pa.array(~whole), texts, "") if whole.any() else texts
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(kept, LETTER_THEN_MARK, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        # the vocabulary lower-cases anyway; other words may have accents that only fit the capital
        lower = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct).to_pylist()
        place = np.fromiter(map(self.known.get, lower, repeat(-1)), np.int64, len(lower))
        missing = np.nonzero(place < 0)[0]
        if len(missing):
            if self.n_words > CACHE_WORDS or self.n_ids > CACHE_IDS:
                self.forget()
                missing = np.arange(len(lower))
            self.learn(list(dict.fromkeys(lower[i] for i in missing)))
            place[missing] = [self.known[lower[i]] for i in missing]
            for w in {lower[i] for i in missing if len(lower[i]) > CACHE_LENGTH}:
                del self.known[w]
        at = place[coded.indices.to_numpy()]
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        special = iter(self.encode_all(texts.filter(pa.array(whole)).to_pylist())) if whole.any() else None
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield np.array(next(special), np.uint32) if whole[i] else ids[a:b]

    def learn(self, words: list[str]) -> None:
        """Encodes words many at a time: a mark of one id stands between them and shows where each ends."""
        joined, alone = [w for w in words if MARK not in w], [w for w in words if MARK in w]
        for at in range(0, len(joined), CALL_WORDS):
            some = joined[at : at + CALL_WORDS]
            ids = np.array(self.encode_all([f" {MARK} ".join(some)])[0], np.uint32)
            cuts = np.nonzero(ids == self.mark)[0]
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            self.keep(some, ids[ids != self.mark], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        for w, ids in zip(alone, self.encode_all(alone), strict=True):
            self.keep([w], np.array(ids, np.uint32), np.array([len(ids)]))

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.n_words, self.n_ids
        self.n_words, self.n_ids = n + len(words), m + len(ids)
        self.pool, self.start, self.size = (grown(x, k) for x, k in ((self.pool, self.n_ids), (self.start, self.n_words), (self.size, self.n_words)))
        self.pool[m : self.n_ids] = ids
        self.size[n : self.n_words] = sizes
        self.start[n : self.n_words] = m + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(n, self.n_words), strict=True))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


#: The encoders of this worker process, by path.
ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


class Writer:
    """Writes one file to a stream. Documents come in ascending order of their keys, None first."""

    def __init__(self, out, level: int = 1):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.keys, self.sizes, self.nulls, self.buffer = [], array("q"), array("Q"), bytearray(), bytearray()

    def add(self, key: int | None, ids: bytes) -> None:
        if self.buffer and len(self.buffer) + len(ids) > FRAME_BYTES:
            self.flush()
        self.buffer += ids
        self.keys.append(LEAST if key is None else key), self.sizes.append(len(ids) // 4), self.nulls.append(key is None)

    def flush(self) -> None:
        if self.buffer:
            self.frame(bytes(self.buffer))
            self.buffer.clear()

    def frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.frames.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        self.flush()
        self.frame(struct.pack("<q", len(self.keys)) + np.array(self.keys, dtype="<i8").tobytes() + np.array(self.sizes, dtype="<u8").tobytes() + self.nulls)
        table = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads one file from a seekable stream: the table and the index at once, data frames as asked for."""

    def __init__(self, f):
        self.f, self.zstd, self.at = f, zstandard.ZstdDecompressor(), (None, b"")
        size = f.seek(0, 2)
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table")
        f.seek(size - 9 - 12 * n)
        sizes = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets, self.sizes, self.sums = np.concatenate([[0], np.cumsum(sizes[:, 0])]), sizes[:, 1], sizes[:, 2]
        index = self.frame(n - 1)
        count = struct.unpack_from("<q", index)[0]
        self.keys = np.frombuffer(index, "<i8", count, 8)
        self.lengths = np.frombuffer(index, "<u8", count, 8 + 8 * count).astype(np.int64)
        self.nulls = np.frombuffer(index, np.bool_, count, 8 + 16 * count)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bases = np.concatenate([[0], np.cumsum(self.sizes[:-1])]).tolist()

    def frame(self, i: int) -> bytes:
        if self.at[0] != i:
            self.f.seek(int(self.offsets[i]))
            content = self.zstd.decompress(self.f.read(int(self.offsets[i + 1] - self.offsets[i])), max_output_size=int(self.sizes[i]))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i} is damaged")
            self.at = (i, content)
        return self.at[1]

    def key(self, place: int) -> int | None:
        return None if self.nulls[place] else int(self.keys[place])

    def find(self, key: int | None) -> range:
        """The places of the documents with this key."""
        n = int(self.nulls.sum())  # nulls come first
        if key is None:
            return range(n)
        some = self.keys[n:]
        return range(n + int(np.searchsorted(some, key)), n + int(np.searchsorted(some, key, side="right")))

    def ids(self, place: int) -> bytes:
        """The ids of the document at a place, as bytes; one frame is decompressed."""
        a, b = 4 * int(self.starts[place]), 4 * int(self.starts[place + 1])
        if a == b:
            return b""
        i = bisect_right(self.bases, a) - 1
        return self.frame(i)[a - self.bases[i] : b - self.bases[i]]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end: int = 2, files: int | None = None) -> tuple[str, DataFrame]:
    """(folder, files): files of token ids in ascending key order, and a table of them (path, docs, ids, start, first_key, last_key).

    tokenizer: a file of the tokenizers library (.json) or of sentencepiece (.model), at one path on
    all machines; without special tokens. Texts are dealt by ranges of key, text hash and row, so a hot key
    spreads over files, and sorted in each: file i comes before file i + 1. Each task writes its
    file under a name of its own, which the table then lists, so a task that is run again, elsewhere
    or twice at once does no harm; files that are not listed are removed in the end. How many files:
    `files`, else the shuffle partitions, or more if files would pass FILE_BYTES of input.

    Keys are integers (a ValueError if not). Null keys come first and stay null; a null text counts as
    empty and gets the end id alone; rows that repeat a key follow each other by a hash of their text.
    An empty table makes no or empty files. Other columns of docs, whatever their names, are not read. folder is in a store that the
    driver and the executors share (spark.checkpoint.dir unless given); what pyarrow.fs opens works.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be an integer column, not {docs.schema[key].dataType.simpleString()}")
    folder = folder or f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    slim = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(docs) // FILE_BYTES, MOST_FILES))
    slim = slim.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    slim = slim.repartitionByRange(n, "key", "tie", "row").sortWithinPartitions("key", "tie").select("key", "text")
    tail = np.array([end], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        docs = ids = 0
        with fs.open_output_stream(name) as out:
            writer = Writer(out)
            for b in batches:
                for k, made in zip(b.column(0).to_pylist(), encoder(tokenizer)(b.column(1)), strict=True):
                    writer.add(k, made.astype("<u4", copy=False).tobytes() + tail)
                    docs, ids = docs + 1, ids + len(made) + 1
            writer.close()
        keys = [int(k) for k in (writer.keys[:1], writer.keys[-1:]) for k in k]
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "docs": [docs], "ids": [ids], "first_key": pa.array(keys[:1] or [None], pa.int64()), "last_key": pa.array(keys[1:] or [None], pa.int64())})

    made = slim.mapInArrow(write, "part long, path string, docs long, ids long, first_key long, last_key long").collect()  # a row a file
    rows, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        rows.append((r["path"], r["docs"], r["ids"], start, r["first_key"], r["last_key"]))
        start += r["ids"]
    fs, path = pafs.FileSystem.from_uri(folder)
    for left in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if left.base_name.startswith("part-") and left.base_name not in {r[0].rpartition("/")[2] for r in rows}:
            fs.delete_file(left.path)
    return folder, spark.createDataFrame(rows, "path string, docs long, ids long, start long, first_key long, last_key long")


def input_bytes(docs: DataFrame) -> int:
    """Bytes of docs as the planner estimates them from its files' sizes; 0 where it cannot."""
    found = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 if found >= 1 << 60 else found


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, keys: Sequence[int | None] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of every document in the files; start counts the ids of all documents before it.

    keys: only the documents with these keys, a list that the caller holds anyway; files without any are not opened and only
    frames that hold one are decompressed. A key that is in no file gives no row.
    """
    wanted = None if keys is None else sorted({k for k in keys if k is not None}) + [None] * (None in set(keys))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, first, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                some = wanted if wanted is None else [k for k in wanted if low is not None and (k is None and low == LEAST or k is not None and low <= k <= high)]
                if some == []:
                    continue
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    asked = range(len(reader.keys)) if some is None else sorted(p for k in some for p in reader.find(k))
                    for at in range(0, len(asked), 500):
                        places = asked[at : at + 500]
                        ids = [reader.ids(p) for p in places]
                        yield pa.RecordBatch.from_arrays([pa.array([reader.key(p) for p in places], pa.int64()), pa.array([first + int(reader.starts[p]) for p in places], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    n = max(1, files.count())
    return files.select("path", "start", "first_key", "last_key").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
