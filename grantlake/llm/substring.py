"""Substring dedup: shared k-mer seeds, collinear chains by a Fenwick tree, chains aligned to fuzzy passages."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, quoted, slices, words

#: Words of a seed, and the share of seeds that are kept: those of lowest hash, whatever stands beside them, so that edits nearby don't
#: matter. A passage of identity 0.8 has runs of four words at least, a fifth of its places.
K, DENSITY = 4, 0.35
#: Of any so many seeds in a row the least by hash is kept, too, so no stretch is without one.
WINDOW = 12
#: Documents (or so) in which seeds are counted beforehand, and the share of them from which on a seed is hot; hot seeds, at most. All others are shuffled.
SAMPLE, HOT, MOST_HOT = 1 << 14, 1 / 1024, 1 << 20
#: A seed is worth so much in a chain; each word that the ends move on costs so much.
WORTH, GAP = 6.0, 0.1
#: Words around a chain that may still match.
MARGIN = 48
#: Rows of an alignment that are held at once.
BLOCK = 256
#: Keys of documents that are sent to all executors, at most (30 MB or so).
FEW = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, whether it can be an anchor) of the seeds of a text."""
    return again(*sampled(np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], dtype=np.uint64)))


def sampled(ids: np.ndarray, k: int = K, window: int = WINDOW, density: float = DENSITY) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds of k words that are kept; equal passages of k + window - 1 words or more share one."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * BASE + ids[i : i + n]
    h ^= h >> np.uint64(32)
    h *= BASE
    kept = h < np.uint64(density * 2.0**64)
    if n <= window:
        kept[np.argmin(h)] = True
    else:
        kept[np.argmin(np.lib.stride_tricks.sliding_window_view(h, window), axis=1) + np.arange(n - window + 1)] = True
    at = np.flatnonzero(kept)
    return at.astype(np.int32), h[at]


def again(places: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, whether it can be an anchor) of seeds, where the second, third ... of a seed also come under hashes of their own.

    So repetitive texts meet place by place, while a passage that a document holds twice is found twice.
    """
    if not len(h):
        return places, h, np.zeros(0, dtype=bool)
    order = np.argsort(h, kind="stable")
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    more = rank > 0
    own = (h[more] ^ (rank[more].astype(np.uint64) * BASE)) * BASE
    return np.concatenate([places, places[more]]), np.concatenate([h, own]), np.concatenate([~more, np.ones(int(more.sum()), dtype=bool)])


class Fenwick:
    """Greatest value and its place over prefixes."""

    def __init__(self, n: int):
        self.best, self.who = [0.0] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i] or self.who[i] < 0:
                self.best[i], self.who[i] = value, who
            i += i & -i

    def most(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        value, who = -1e300, -1
        while i > 0:
            if self.who[i] >= 0 and self.best[i] > value:
                value, who = self.best[i], self.who[i]
            i -= i & -i
        return value, who


def chains(b: list[int], a: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Collinear chains of matches (b, a), sorted by b: (first b, last b, first a, last a) of those that span `least` words.

    A chain's score is WORTH a match less GAP a word that its ends move on in both texts, halved; a match
    continues the best chain that ends before it in both, found by prefix maximum, or starts anew.
    """
    if len({x - y for x, y in zip(b, a, strict=True)}) == 1:
        return straight(b, a, least)
    n, order = len(b), sorted(set(a))
    tree, score, back = Fenwick(len(order)), [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and b[j] == b[i]:
            value, who = tree.most(bisect_left(order, a[j]))
            gain = value - GAP / 2 * (a[j] + b[j]) if who >= 0 else -1.0
            score[j], back[j] = (WORTH + gain, who) if gain > 0 else (WORTH, -1)
            j += 1
        for x in range(i, j):
            tree.put(bisect_left(order, a[x]), score[x] + GAP / 2 * (a[x] + b[x]), x)
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda x: -score[x]):
        if used[end]:
            continue
        at = first = end
        while at >= 0 and not used[at]:
            used[at] = True
            first, at = at, back[at]
        if b[end] - b[first] + K >= least and first != end:
            out.append((b[first], b[end], a[first], a[end]))
    return out


def straight(b: list[int], a: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """chains() of matches that are all at one distance: the only question is which gaps cost more than what came before is worth."""
    cuts, score = [0], WORTH
    for i in range(1, len(b)):
        gain = score - GAP * (b[i] - b[i - 1])
        if gain <= 0:
            cuts.append(i)
        score = WORTH + max(0.0, gain)
    return [(b[i], b[j - 1], a[i], a[j - 1]) for i, j in zip(cuts, [*cuts[1:], len(b)], strict=True) if j - i > 1 and b[j - 1] - b[i] + K >= least]


def common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of places at once."""
    place: dict[int, int] = {}
    for i, w in enumerate(y):
        place[w] = place.get(w, 0) | (1 << i)
    full = (1 << len(y)) - 1
    v = full
    for w in x:
        u = v & place.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


def matched(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Places (in x, in y) of a longest common subsequence, in order. Rows of `common` are kept one a block and computed again on the way back."""
    n, m = len(x), len(y)
    head = next((i for i in range(min(n, m)) if x[i] != y[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if x[n - 1 - i] != y[m - 1 - i]), min(n, m) - head)
    place: dict[int, int] = {}
    for i, w in enumerate(y[head : m - tail]):
        place[w] = place.get(w, 0) | (1 << i)
    x0 = x[head : n - tail]
    full = (1 << (m - tail - head)) - 1
    kept, v = [full], full
    for i, w in enumerate(x0, 1):
        u = v & place.get(w, 0)
        v = ((v + u) | (v - u)) & full
        if i % BLOCK == 0:
            kept.append(v)
    found, i, j = [], len(x0), m - tail - head
    while i and j:
        at = (i - 1) // BLOCK * BLOCK
        rows = [v := kept[at // BLOCK]]
        for w in x0[at:i]:
            u = v & place.get(w, 0)
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        while i > at and j:
            if x0[i - 1] == y[head + j - 1]:
                i, j = i - 1, j - 1
                found.append((head + i, head + j))
            elif rows[i - at] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return [*((i, i) for i in range(head)), *reversed(found), *((n - i, m - i) for i in range(tail, 0, -1))]


def segments(runs: list[tuple[int, int, int]], cost: float) -> list[tuple[int, int]]:
    """(first, last run) of the maximal stretches of runs (place in x, place in y, words) whose matches outweigh `cost` a word between, by Ruzzo and Tompa."""
    out: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for k, (x, y, n) in enumerate(runs):
        if k:
            px, py, pn = runs[k - 1]
            total -= cost * max(x - px - pn, y - py - pn)
        left, total, first = total, total + n, k
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= total:
                out.append((left, total, first, k, j))
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
    return [(first, last) for _, _, first, last, _ in out]


def pieces(b: np.ndarray, a: np.ndarray, least: int, similar: float) -> list[tuple[int, int, float]]:
    """(first, end, identity) of the stretches of b, `least` words or more, that agree with a stretch of a in `similar` of their words.

    Words that do not agree weigh half of what identity `similar` allows at first; a stretch below it is cut
    where it agrees least by weighing them more, up to the full weight, at which all are above it. Exact
    runs of twice `least` in a stretch with edits come on their own, too.
    """
    if len(b) == len(a) and (b == a).all():
        return [(0, len(b), 1.0)] if len(b) >= least else []
    x, y = b.tolist(), a.tolist()
    runs: list[tuple[int, int, int]] = []
    for i, j in matched(x, y):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    strict, out = similar / max(1 - similar, 1e-9), []

    def cut(some: list[tuple[int, int, int]], level: int) -> None:
        for first, last in segments(some, strict * (0.5, 0.75, 1.0)[level]):
            (x0, y0, _), (x1, y1, n) = some[first], some[last]
            x1, y1, same = x1 + n, y1 + n, sum(r[2] for r in some[first : last + 1])
            if same < similar * max(x1 - x0, y1 - y0):
                if level < 2:
                    cut(some[first : last + 1], level + 1)
                continue
            while x0 and y0 and x[x0 - 1] == y[y0 - 1]:
                x0, y0, same = x0 - 1, y0 - 1, same + 1
            while x1 < len(x) and y1 < len(y) and x[x1] == y[y1]:
                x1, y1, same = x1 + 1, y1 + 1, same + 1
            if x1 - x0 >= least:
                out.append((x0, x1, same / max(x1 - x0, y1 - y0)))
                if same < max(x1 - x0, y1 - y0):
                    out.extend((i, i + n, 1.0) for i, _, n in some[first : last + 1] if n >= 2 * least)

    cut(runs, 0)
    return out


def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, dkey, place, whether it can be an anchor) of the seeds of some texts (dkey, text) at a time."""
    for some in slices(batches):
        rows = [seeds_of(t.as_py().encode()) for t in some.column(1)]
        owners = np.repeat(some.column(0).to_numpy(), [len(r[0]) for r in rows])
        pos, h, new = (np.concatenate([r[i] for r in rows]) for i in range(3))
        yield h.view(np.int64), owners, pos, new


def hot_seeds(slim: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds in order, anchors' keys, places) of the seeds that a share HOT of a sample of documents holds.

    A sampled document holds some hundred seeds, so there are no more than some hundred over HOT hot ones, whatever
    the size of the table. A hot seed's anchor is one of the sample; its holders need no shuffle to find it.
    """
    n = slim.count()
    step = max(1, n // SAMPLE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, owners, pos, new in seed_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(owners[new]), pa.array(pos[new])], names=["seed", "dkey", "pos"])

    some = slim.select("dkey", "text").where(F.pmod("dkey", F.lit(step)) == 0).mapInArrow(rows, "seed long, dkey long, pos int")
    found = some.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("dkey").alias("adkey"), F.max("dkey").alias("last"), F.min_by("pos", "dkey").alias("apos"))
    found = found.where((F.col("n") >= max(16, int(HOT * n / step))) & (F.col("adkey") != F.col("last"))).orderBy(F.desc("n"), "seed").limit(MOST_HOT).select("seed", "adkey", "apos").toArrow()
    seed, adkey, apos = (found.column(i).to_numpy() for i in range(3))
    order = np.argsort(seed)
    return seed[order], adkey[order], apos[order].astype(np.int32)


def matched_seeds(slim: DataFrame) -> DataFrame:
    """(dkey, adkey, pos, apos) of every seed that two documents hold, with its place in its anchor.

    Seeds go to the tasks by hash once, and a sorted pass gives the holders of a seed the least of them as
    anchor. Hot seeds have their anchors already and are dealt by document, so no task gets a hot seed's holders.
    """
    sent = slim.sparkSession.sparkContext.broadcast(hot_seeds(slim))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(seed, dkey, place); of a hot seed (dkey, where the seed is in the list, -1 - place)."""
        known = sent.value[0]
        for h, owners, pos, _ in seed_rows(batches):
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hot = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(hot, owners, h)), pa.array(np.where(hot, at, owners)), pa.array(np.where(hot, -1 - pos, pos).astype(np.int32))], names=["seed", "dkey", "pos"])

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, adkey, apos = sent.value
        held: list[tuple[np.ndarray, ...]] = []  # the rows of the last seed so far: not hot, so a small share of the documents at most
        for last, batch in marked(batches):
            rows = tuple(batch.column(i).to_numpy() for i in range(3))
            hot = rows[2] < 0
            out = [[rows[0][hot], adkey[rows[1][hot]], -1 - rows[2][hot], apos[rows[1][hot]]]]
            rows = tuple(x[~hot] for x in rows)
            if held and len(rows[0]) and not last and rows[0][-1] == held[0][0][0]:
                held.append(rows)
            else:
                seed, dkey, pos = (np.concatenate(x) for x in zip(*held, rows, strict=True))
                cut = len(seed) if last else int(np.searchsorted(seed, seed[-1])) if len(seed) else 0  # seeds come in order
                held = [tuple(x[cut:] for x in (seed, dkey, pos))] if cut < len(seed) else []
                order = np.lexsort((pos[:cut], dkey[:cut], seed[:cut]))
                seed, dkey, pos = (x[:cut][order] for x in (seed, dkey, pos))
                first = np.concatenate([[0], np.nonzero(np.diff(seed))[0] + 1])[: len(seed)]
                size = np.diff(np.concatenate([first, [len(seed)]]))
                shared = np.repeat(dkey[first + size - 1] != dkey[first], size) if len(seed) else np.zeros(0, dtype=bool)
                at = np.repeat(first, size)[shared]
                out.append([dkey[shared], dkey[at], pos[shared], pos[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(t)) for i, t in enumerate((np.int64, np.int64, np.int32, np.int32))], names=["dkey", "adkey", "pos", "apos"])

    dealt = slim.select("dkey", "text").mapInArrow(rows, "seed long, dkey long, pos int")
    return dealt.repartition("seed").sortWithinPartitions("seed").mapInArrow(anchored, "dkey long, adkey long, pos int, apos int")


def find_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, similar: float = 0.8) -> DataFrame:
    """A row a passage: doc_id, first_word, last_word, n_words, identity, source_ids (documents that share it).

    A passage is a stretch of at least `least` words that other documents hold too, up to edits: the
    parts of it agree with a document in source_ids in at least `similar` of their words; a chain over
    text that does not agree is cut there. Seeds are of K words, few enough
    for passages with an edit every fifth word; the ends grow by up to MARGIN words, edits included. Each seed has
    one anchor, the document of least key hash that holds it (in a sample, if very many do), and other holders are chained with the
    anchor alone, so a passage in n documents costs n rows, not n squared; the anchor itself
    stands in source_ids. Chains of half the length are aligned too, for passages whose parts have
    different anchors; what overlaps or touches in a document is one passage. Exact windows of `least` words
    have anchors of their own, so a passage that two documents share in full is found even if
    earlier documents hold parts of it; one with edits may still be lost to them.

    A document is its key and text: rows that repeat both are one document and matches within a
    document do not count. Null and short texts have no passages, nor has an empty table. Columns other than
    key and text are not read, whatever their names. No task gets all holders of a frequent seed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(docs[quoted(text)].cast("string"), F.lit(""))
    slim = docs.select(F.xxhash64(docs[quoted(key)], body).alias("dkey"), docs[quoted(key)].alias("doc_id"), body.alias("text"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for last, batch in marked(batches):
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            edges = np.nonzero(np.diff(cols[0]))[0] + 1
            bounds = [0, *edges.tolist(), len(cols[0])]
            if not last:
                held, bounds = [x[bounds[-2] :] for x in cols], bounds[:-1]
            order = np.lexsort([x[: bounds[-1]] for x in (cols[3], cols[2], cols[1], cols[0])])  # documents come in order, rows within one do not
            cols, rows = [x[: bounds[-1]][order] for x in cols], []
            for i, j in zip(bounds, bounds[1:], strict=False):
                if j == i:
                    continue
                me, anchor, pos, apos = int(cols[0][i]), cols[1][i:j], cols[2][i:j], cols[3][i:j]
                rows += [(me, me, lo, hi, 0, 0) for lo, hi in stretches(pos, pos[anchor != me], least)]
                parts = [0, *(np.nonzero(np.diff(anchor))[0] + 1).tolist(), j - i]
                for u, v in zip(parts, parts[1:], strict=False):
                    if v - u > 1 and anchor[u] != me:
                        rows += [(me, int(anchor[u]), *c) for c in chains(pos[u:v].tolist(), apos[u:v].tolist(), least // 2)]
            got = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(6)], names=["dkey", "adkey", "b0", "b1", "a0", "a1"])

    found = matched_seeds(slim).repartition("dkey").sortWithinPartitions("dkey").mapInArrow(chain, "dkey long, adkey long, b0 long, b1 long, a0 long, a1 long")
    found = scratch.save(found.withColumn("chain", F.xxhash64("dkey", "adkey", "b0", "a0", "b1", "a1")), "chains")
    where, found = found.where("dkey = adkey").select("dkey", F.col("b0").alias("lo"), F.col("b1").alias("hi")), found.where("dkey <> adkey")

    # each chain asks two documents for their words from MARGIN before to MARGIN after
    ask = lambda owner, lo, hi, side: found.select(F.col(owner).alias("dkey"), "chain", F.lit(side).alias("side"), F.greatest(F.lit(0), F.col(lo) - MARGIN).alias("lo"), (F.col(hi) + K + MARGIN).alias("hi"))
    asked = ask("dkey", "b0", "b1", 0).unionByName(ask("adkey", "a0", "a1", 1))
    # where few documents are asked, as is usual, only they are hashed and shuffled
    owners = asked.select("dkey").distinct()
    some = slim.join(F.broadcast(owners), "dkey", "left_semi") if owners.count() <= FEW else slim
    hashed = some.select("dkey", "doc_id", F.transform(words(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("ws"))
    told = asked.join(hashed, "dkey").select("chain", "side", "dkey", "doc_id", "lo", F.slice("ws", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")).alias("ws"))
    told = told.groupBy("chain").agg(*[F.max(F.when(F.col("side") == s, F.struct("doc_id", "lo", "ws"))).alias(n) for s, n in ((0, "b"), (1, "a"))])
    both = found.join(told, "chain").select("dkey", F.col("b.doc_id").alias("doc_id"), F.col("a.doc_id").alias("source_id"), F.col("b.lo").alias("blo"), F.col("b.ws").alias("b"), F.col("a.ws").alias("a"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            rows, first = [], x.column(3).to_numpy()
            sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (x.column(4), x.column(5))]
            for at in range(x.num_rows):
                b, a = (values[offsets[at] : offsets[at + 1]] for values, offsets in sides)
                rows += [(at, first[at] + lo, first[at] + end - 1, identity) for lo, end, identity in pieces(b, a, least // 2, similar)]
            at, lo, last, identity = zip(*rows, strict=True) if rows else ((),) * 4
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.column(i).take(at) for i in range(3)), pa.array(lo, pa.int64()), pa.array(last, pa.int64()), pa.array(identity, pa.float64())], names=["dkey", "doc_id", "source_id", "first_word", "last_word", "identity"])

    kind = docs.schema[key].dataType.simpleString()
    # most chains join copies, which need no alignment
    both, alike = both.where("a <> b"), both.where("a = b").where(F.size("b") >= least // 2)
    alike = alike.select("dkey", "doc_id", "source_id", F.col("blo").cast("long").alias("first_word"), (F.col("blo") + F.size("b") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("identity"))
    parts = alike.unionByName(both.select("dkey", "doc_id", "source_id", F.col("blo").cast("long").alias("blo"), "b", "a").mapInArrow(aligned, f"dkey long, doc_id {kind}, source_id {kind}, first_word long, last_word long, identity double"))
    parts = scratch.save(parts, "parts")
    parts = parts.unionByName(shared_windows(slim, where, parts.where("identity = 1").select("dkey", F.col("first_word").alias("lo"), (F.col("last_word") + 1).alias("hi")), scratch, least))
    order = Window.partitionBy("dkey").orderBy("first_word", "last_word", "source_id")
    reach = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", F.when(F.col("first_word") <= reach + 1, 0).otherwise(1)).withColumn("_passage", F.sum("_new").over(order))
    out = parts.groupBy("dkey", "_passage").agg(F.first("doc_id").alias("doc_id"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("identity").alias("identity"), F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    out = out.withColumn("n_words", F.col("last_word") - F.col("first_word") + 1).where(F.col("n_words") >= least)
    return out.select("doc_id", "first_word", "last_word", "n_words", "identity", "source_ids")


def stretches(places: np.ndarray, foreign: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first word, end) of the stretches of a document in which it may share `least` words exactly with a document that no seed joins it to.

    places: its seeds that other documents hold; foreign: those whose anchor is another document. Of a
    shared stretch, the first seed begins in its first WINDOW words, the next ones WINDOW words on at
    most. If all seeds of a window have this document as their anchor, they join all its holders to it.
    """
    at, foreign = np.unique(places), np.unique(foreign)
    if not len(at):
        return []
    edges = np.nonzero(np.diff(at) > WINDOW)[0] + 1
    out: list[tuple[int, int]] = []
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
        if at[j - 1] - at[i] < least - K - 2 * (WINDOW - 1):
            continue
        lo, hi = max(0, int(at[i]) - WINDOW + 1), int(at[j - 1]) + K + WINDOW - 1
        for f in foreign[np.searchsorted(foreign, at[i]) : np.searchsorted(foreign, at[j - 1], side="right")].tolist():
            first, end = max(lo, f - least + K), min(hi, f + least)
            if out and first <= out[-1][1] and out[-1][0] >= lo:
                out[-1] = (out[-1][0], end)
            else:
                out.append((first, end))
    return out


def shared_windows(slim: DataFrame, where: DataFrame, done: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Parts of passages by exact windows of `least` words: each window in the stretches `where` (dkey, lo, hi) has an anchor of its own.

    A window's holders share all of it, so an anchor takes none from the others: every exact passage
    of `least` words is found, whatever other documents hold of it. A window's row is its hash and place;
    windows that go on with the same anchor at the same distance are one part. Windows within `done`
    (dkey, lo, hi), where a document agrees word for word with one of lesser key, are passed over: that
    one has them too, and the holder of least key is never done.
    """
    both = where.distinct().withColumn("done", F.lit(False)).unionByName(done.distinct().withColumn("done", F.lit(True)))
    asked = both.groupBy("dkey").agg(*[F.collect_list(F.when(F.col("done") == d, F.struct("lo", "hi"))).alias(n) for n, d in (("at", False), ("done", True))])
    some = slim.join(asked.where("size(at) > 0"), "dkey")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ws = batch.column(1)[i].as_py().encode().lower().split()
                pos = np.unique(np.concatenate([np.arange(r["lo"], min(r["hi"], len(ws)) - least + 1) for r in batch.column(2)[i].as_py()])).astype(np.int64)
                for r in batch.column(3)[i].as_py():
                    pos = pos[(pos < r["lo"]) | (pos + least > r["hi"])]
                if len(pos):
                    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
                    h = np.zeros(len(pos), dtype=np.uint64)
                    for k in range(least):
                        h = h * BASE + ids[pos + k]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(pos), batch.column(0)[i].as_py(), np.int64)), pa.array(pos.astype(np.int32))], names=["window", "dkey", "pos"])

    every = scratch.save(some.select("dkey", "text", "at", "done").mapInArrow(windows, "window long, dkey long, pos int"), "windows")
    anchors = every.groupBy("window").agg(F.min("dkey").alias("adkey"), F.max("dkey").alias("last"), F.min_by("pos", "dkey").alias("apos")).where("adkey <> last").drop("last")
    pairs = every.join(anchors, "window").where("dkey <> adkey").select("dkey", "adkey", "pos", (F.col("pos") - F.col("apos")).alias("off"))
    order = Window.partitionBy("dkey", "adkey", "off").orderBy("pos")
    pairs = pairs.withColumn("_run", F.col("pos") - F.dense_rank().over(order))
    runs = pairs.groupBy("dkey", "adkey", "off", "_run").agg(F.min("pos").cast("long").alias("first_word"), (F.max("pos") + least - 1).cast("long").alias("last_word"))
    names = slim.select("dkey", "doc_id").dropDuplicates(["dkey"])
    out = runs.join(names, "dkey").join(names.select(F.col("dkey").alias("adkey"), F.col("doc_id").alias("source_id")), "adkey")
    return scratch.save(out.select("dkey", F.col("doc_id").cast(kind), "source_id", "first_word", "last_word", F.lit(1.0).alias("identity")), "exact")


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether it is the last, batch)."""
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held
