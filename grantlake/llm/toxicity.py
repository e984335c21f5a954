"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nystrom landmarks, trained on windows of labelled documents.

Texts become rows of lower-case letters with one space between words; letters that stand alone in a row are
one word ("i d i o t") and what is no letter vanishes ("i.d.i.o.t"). The kernel compares windows of one
and of two words in a row by their subsequences of three characters with gaps, the spaces around and between words
included: a subsequence that spans s characters counts DECAY^s, spans go up to SPAN. An
inserted, lost or changed letter thus costs a few subsequences, not the match. Because each landmark
is a sum of subsequences, so is the machine's decision: every place of a text looks its subsequences up in one
table of weights, and running sums give all windows their decisions at once.

Learning is by multiple instances: a toxic document has a window that is toxic, the windows of a
clean one are all clean. Windows whose subsequences are oftener in toxic documents are the
first witnesses; each round adds the likeliest window of every toxic document and the hardest of
each clean one and fits the machine anew. A document's score is a logistic function of its highest
window and the highest that does not touch it, kept between -1.5 and 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, quoted, slices

#: Chosen by cross-validation within the training labels, as are WITNESS, RIDGE and ROUNDS (see cross_validate).
SPAN, DECAY, BITS = 5, 0.7, 20
GAPS = [(a, b, DECAY ** (b + 1)) for a, b in combinations(range(1, SPAN), 2)]
#: A longer word is scored piece by piece, pieces overlapping by half.
PIECE = 48
#: Documents of each label that the machine is fitted on, and characters of them, at most: the first by a hash of key and text. Landmarks.
SAMPLE, SAMPLE_CHARS, LANDMARKS = 2000, 10_000_000, 320
#: Documents of the usual mix that hold ratios down; the share of clean documents whose highest window a text's first witness must exceed, and a further one; how strongly weights are held; rounds.
HOLD, WITNESS, STRICT, RIDGE, ROUNDS = 10.0, 0.3, 0.9, 5e-2, 4
#: What a first witness must come to in later rounds (a further one must be accepted); the weight of witnesses to that of other windows.
FLOOR, BALANCE = -1.0, 0.5
#: Windows of a toxic document that a round learns from, at most; of a clean one: its hardest and some at random.
WITNESSES, HARD, PLAIN = 3, 3, 5
#: Characters that are scored at a time.
STEP = 1 << 19
SPACE = 32


class Alphabet:
    """What the code points are: tables over all of Unicode, made once a process."""

    letter: np.ndarray | None = None
    space: np.ndarray

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.letter is None:
            cls.space = np.array([chr(i).isspace() for i in range(0x110000)])
            cls.letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        return cls.letter, cls.space


@dataclass
class Stream:
    """Some texts as one row of characters. start, end: each window's first character (the space before it) and the one after its last (the space behind it); word: the word it begins with, words: how many it has; bounds: each text's first window, and the end."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    words: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Stream:
        letter, space = Alphabet.tables()
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        gap = np.array([SPACE], np.uint32)
        points = np.concatenate([gap, *[x for r in raw for x in (r, gap)]])
        owner = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
        owner = np.concatenate([[0], owner])
        blank = space[points]
        kept = blank | letter[points]
        points, owner, blank = points[kept], owner[kept], blank[kept]
        kept = ~blank | ~np.concatenate([[False], blank[:-1]])  # one space between words
        points, owner, blank = points[kept], owner[kept], blank[kept]
        points = np.where(blank, np.uint32(SPACE), points)
        # letters alone in a row of three or more are one word
        at = np.flatnonzero(blank)
        of = owner[np.minimum(at + 1, len(points) - 1)]  # the text of the word behind each space
        single = np.diff(at) == 2
        same = np.concatenate([[False], single[1:] & single[:-1] & (of[1:-1] == of[:-2])]) if len(single) else single
        run = np.cumsum(~same) if len(same) else same
        long = single & (np.bincount(run)[run] >= 3) if len(same) else single
        if long.any():
            drop = at[:-1][long & same]  # the spaces within
            kept = np.ones(len(points), dtype=bool)
            kept[drop] = False
            points, owner, blank = points[kept], owner[kept], blank[kept]
            at = np.flatnonzero(blank)
            of = owner[np.minimum(at + 1, len(points) - 1)]
        start, end, of = at[:-1], at[1:], of[: len(at) - 1]
        n = len(start)
        word = np.arange(n)
        pair = word[:-1][of[1:] == of[:-1]] if n else word
        pair = pair[end[pair + 1] - start[pair] <= PIECE] if n else pair
        size = end - start - 1
        cuts = np.where(size > PIECE, -(-(size - PIECE // 2) // (PIECE // 2)), 1)
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        many = np.repeat(cuts > 1, cuts)
        first = np.repeat(start, cuts) + np.where(many, k * (PIECE // 2), 0)
        last = np.where(many, np.minimum(first + PIECE + 1, np.repeat(end, cuts)), np.repeat(end, cuts))
        starts, ends = np.concatenate([first, start[pair]]), np.concatenate([last, end[np.minimum(pair + 1, max(0, n - 1))]])
        words, count = np.concatenate([np.repeat(word, cuts), pair]), np.concatenate([np.ones(len(first), np.int8), np.full(len(pair), 2, np.int8)])
        order = np.argsort(words, kind="stable")
        of = of[words[order]]
        starts, ends, words, count = (x[order].astype(t) for x, t in ((starts, np.int32), (ends, np.int32), (words, np.int32), (count, np.int8)))
        return cls(points, starts, ends, words, count, np.searchsorted(of, np.arange(len(texts) + 1)))

    def codes(self) -> Iterator[tuple[np.ndarray, int, float]]:
        """For each shape of gaps: the code of the subsequence that begins at each character, how far it reaches, its weight."""
        p = self.points.astype(np.uint64)
        for a, b, weight in GAPS:
            m = max(0, len(p) - b)
            h = (p[:m] * A + p[a : a + m] * B + p[b : b + m] * C) * D
            yield (h >> np.uint64(64 - BITS)).astype(np.int32), b, weight

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each window the sum of the table over its subsequences, by weight, over the window's norm."""
        total, square = np.zeros(len(self.start)), np.zeros(len(self.start))
        for code, b, weight in self.codes():
            run = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
            last = np.maximum(self.end - b + 1, self.start)
            total += weight * (run[np.minimum(last, len(code))] - run[np.minimum(self.start, len(code))])
            square += weight * weight * (last - self.start)
        return (total / np.sqrt(np.maximum(square, 1e-9))).astype(np.float32)

    def text(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i] + 1].tobytes().decode("utf-32-le", "surrogatepass")


A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def profiles(windows: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, values) of the normalised feature vector of each window (" idiot ", " you idiot ")."""
    out = []
    for w in windows:
        p = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, values = [np.zeros(0, np.int32)], [np.zeros(0)]
        for code, _, weight in Stream(p, *[np.zeros(0, int)] * 5).codes():
            codes.append(code), values.append(np.full(len(code), weight))
        code, value = np.concatenate(codes), np.concatenate(values)
        found, at = np.unique(code, return_inverse=True)
        out.append((found, np.bincount(at, value, len(found)) / np.sqrt(max(1e-9, float((value**2).sum())))))
    return out


def kernel(windows: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each window with each landmark; 0 for a window without subsequences."""
    marks = profiles(landmarks)
    codes = np.unique(np.concatenate([c for c, _ in marks])) if marks else np.zeros(0, np.int32)
    table = np.zeros((len(codes) + 1, len(marks)), dtype=np.float32)
    for j, (c, v) in enumerate(marks):
        table[np.searchsorted(codes, c), j] = v
    out = np.zeros((len(windows), len(marks)), dtype=np.float32)
    for i, (c, v) in enumerate(profiles(windows)):
        at = np.minimum(np.searchsorted(codes, c), max(0, len(codes) - 1))
        hit = codes[at] == c if len(codes) else np.zeros(len(c), dtype=bool)
        out[i] = v[hit].astype(np.float32) @ table[at[hit]]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the points inside the margin."""
    n = x.shape[1]
    w, bias, total, last = np.zeros(n), 0.0, weight.sum(), None
    held = np.diag([*[ridge / len(x) ** 0.5] * n, 1e-9])
    for _ in range(rounds):
        inside = np.nonzero(y * (x @ w.astype(x.dtype) + bias) < 1)[0]
        if last is not None and np.array_equal(inside, last):
            break
        last, gram, right = inside, held.copy(), np.zeros(n + 1)
        for at in range(0, len(inside), 2048):  # bounded memory
            i = inside[at : at + 2048]
            xi, ci = np.hstack([x[i].astype(np.float64), np.ones((len(i), 1))]), weight[i] / total
            gram += xi.T @ (xi * ci[:, None])
            right += xi.T @ (ci * y[i])
        solved = np.linalg.solve(gram, right)
        w, bias = solved[:-1], float(solved[-1])
    return w, bias


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a lightly held logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, held = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + held, x.T @ (weight * (y - p)) - held @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def segments(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(places, texts) of at most STEP characters or so. A longer text comes in several, cut at white space; a pair of words across a cut is no window."""
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            to = len(text)
            if to - at > STEP:
                to = at + STEP
                cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to))
                to = cut if cut > at else to
            if held and size + to - at > STEP:
                yield places, held
                places, held, size = [], [], 0
            places.append(i), held.append(text[at:to])
            size, at = size + to - at, to
            if at >= len(text):
                break
    if held:
        yield places, held


def peaks(stream: Stream, score: np.ndarray, i: int, n: int) -> list[int]:
    """The highest window of a text, the highest that shares no word with it, and so on: n of them, or as many as there are."""
    at, out = np.arange(stream.bounds[i], stream.bounds[i + 1]), []
    while len(out) < n and len(at):
        best = int(at[np.argmax(score[at])])
        out.append(best)
        word, last = stream.word[at], stream.word[at] + stream.words[at] - 1
        at = at[(last < stream.word[best]) | (word > stream.word[best] + stream.words[best] - 1)]
    return out


def highest(stream: Stream, score: np.ndarray, i: int) -> list[float]:
    out = [float(score[j]) for j in peaks(stream, score, i, TOP)]
    return out + [LOWEST] * (TOP - len(out))


#: Inputs of the logistic function, and between what they are kept.
TOP, LOWEST, HIGHEST = 2, -1.5, 1.0


@dataclass
class Machine:
    """table: a weight for each hashed subsequence; bias; curve: the logistic function's weights."""

    table: np.ndarray
    bias: float
    curve: np.ndarray

    def windows(self, windows: list[str]) -> np.ndarray:
        """The decision for each window given as text, such as " idiot "."""
        return np.array([self.table[c] @ v for c, v in profiles(windows)]) + self.bias

    def inputs(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), TOP), LOWEST)
        for places, some in segments(texts):
            stream = Stream.of(some)
            score = stream.sums(self.table) + self.bias
            for i, place in enumerate(places):
                out[place] = np.sort([*out[place], *highest(stream, score, i)])[: -TOP - 1 : -1]
        return np.clip(out, LOWEST, HIGHEST)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.curve[:-1] + self.curve[-1], -30, 30)))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The score of each text."""
        return self.score(self.inputs(texts))


def evidence(streams: list[Stream], toxic: list[np.ndarray]) -> np.ndarray:
    """For each subsequence, how much oftener toxic texts hold it: a log ratio of document frequencies, held towards 0 by HOLD documents of the usual mix."""
    count = np.zeros((2, 1 << BITS), dtype=np.int32)
    for s, y in zip(streams, toxic, strict=True):
        for code, b, _ in s.codes():
            for i in range(len(y)):
                a, z = s.bounds[i], s.bounds[i + 1]
                if a < z:
                    count[int(y[i]), np.unique(code[s.start[a] : max(s.start[a], s.end[a:z].max() - b + 1)])] += 1
    n = np.array([sum(int((y == side).sum()) for y in toxic) for side in (False, True)], dtype=float)
    share = n / n.sum()
    return np.log((count[1] + HOLD * share[1]) / n[1]) - np.log((count[0] + HOLD * share[0]) / n[0])


def learn(bags: Iterable[tuple[int, str]], share: float, rounds: int = ROUNDS, seed: int = 7, witness: float = WITNESS, ridge: float = RIDGE, floor: float = FLOOR, balance: float = BALANCE) -> Machine:
    """The machine for texts (label, text); share: how often label 1 is in the rows that they were drawn from.

    Without texts of both labels every document scores the share of label 1.
    """
    bags = [(bool(y), t) for y, t in bags]
    labels = np.array([y for y, _ in bags], dtype=bool)
    if labels.all() or not labels.any():
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(1 << BITS, dtype=np.float32), -1.0, np.array([0.0] * TOP + [np.log(p / (1 - p))]))
    rng = np.random.default_rng(seed)
    streams, toxic = [], []
    for places, some in segments([t for _, t in bags]):  # a segment of a long text is a text here
        streams.append(Stream.of(some))
        toxic.append(labels[places])
    ratio = evidence(streams, toxic)
    score, machine = [s.sums(ratio) for s in streams], None
    texts = [(k, i, bool(y)) for k, ys in enumerate(toxic) for i, y in enumerate(ys) if streams[k].bounds[i] < streams[k].bounds[i + 1]]
    plain = [(k, j) for k, i, y in texts if not y for j in rng.integers(streams[k].bounds[i], streams[k].bounds[i + 1], PLAIN).tolist()]
    marks: list[str] = []
    # a witness must stand out from what most clean texts come to by chance, and then please the machine
    level, strict = np.quantile([highest(streams[k], score[k], i)[0] for k, i, y in texts if not y] or [0.0], (witness, STRICT))
    for n in range(rounds):
        chosen: dict[tuple[str, bool], float] = {}
        for k, i, y in texts:
            a, b = streams[k].bounds[i], streams[k].bounds[i + 1]
            if y:
                some = [j for m, j in enumerate(peaks(streams[k], score[k], i, WITNESSES)) if score[k][j] > (strict if m else level)]
            else:
                some = (a + np.argpartition(-score[k][a:b], min(HARD, b - a) - 1)[:HARD]).tolist()
            for j in some:
                at = (streams[k].text(j), y)
                chosen[at] = chosen.get(at, 0.0) + 1.0
        for k, j in plain:
            at = (streams[k].text(j), False)
            chosen[at] = chosen.get(at, 0.0) + 1.0
        if not any(y for _, y in chosen):
            break
        order = sorted(chosen, key=lambda w: (-w[1], -chosen[w], w[0]))
        y = np.array([1.0 if w[1] else -1.0 for w in order])
        weight = np.array([min(chosen[w], 50.0) if not w[1] else chosen[w] for w in order])
        weight[y > 0] *= balance * weight[y < 0].sum() / max(1e-9, weight[y > 0].sum())
        if not marks:
            good, bad = [w for w, y in order if y], [w for w, y in order if not y]
            bad = [bad[i] for i in rng.permutation(len(bad))[: max(LANDMARKS // 3, LANDMARKS - len(good))]]
            marks = list(dict.fromkeys([*good[: LANDMARKS - len(bad)], *bad]))
            values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
            kept = values > 1e-4 * values.max()
            project = vectors[:, kept] / np.sqrt(values[kept])  # Nystrom: K(w, landmarks) @ project
        x = kernel([w for w, _ in order], marks) @ project.astype(np.float32)
        w, bias = squared_hinge(x, y, weight, ridge)
        del x
        table = np.zeros(1 << BITS)
        for alpha, (c, v) in zip(project @ w, profiles(marks), strict=True):
            table[c] += alpha * v
        machine = Machine(table.astype(np.float32), bias, np.zeros(TOP + 1))
        score, level = [s.sums(machine.table) + np.float32(bias) for s in streams], floor
        strict = 0.0
    if machine is None:
        return learn([b for b in bags if not b[0]], share)
    x = np.array([np.clip(highest(streams[k], score[k], i), LOWEST, HIGHEST) for k, i, _ in texts])
    y = np.array([float(y) for _, _, y in texts])
    weight = np.where(y > 0, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
    used = list(range(TOP))
    while (curve := logistic(x[:, used], y, weight))[1:-1].size and curve[1:-1].min() < 0:  # another toxic window never speaks for a text
        used.pop(1 + int(np.argmin(curve[1:-1])))
    machine.curve = np.zeros(TOP + 1)
    machine.curve[[*used, TOP]] = curve
    return machine


def cross_validate(rows: list[tuple[int, str]], folds: int = 4, **how) -> tuple[float, float]:
    """(share of toxic rows found, share of others flagged) of rows (label, text), each judged by a machine that learnt from the other folds. For choosing settings within the training labels."""
    found = []
    for fold in range(folds):
        rest = [r for i, r in enumerate(rows) if i % folds != fold]
        machine = learn(rest, sum(y for y, _ in rest) / max(1, len(rest)), **how)
        mine = [r for i, r in enumerate(rows) if i % folds == fold]
        found += zip([y for y, _ in mine], machine([t for _, t in mine]) >= 0.5, strict=True)
    rate = lambda label: sum(bool(p) for y, p in found if y == label) / max(1, sum(y == label for y, _ in found))
    return rate(1), rate(0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Machine:
    """A machine from the labelled documents whose CRC-32 of the key as text is no multiple of 5: `sample` of each label and `chars` characters at most.

    The sample is the first by a hash of key and text that fits, so reruns agree and the driver's memory is
    bounded, however long the texts and however often a key repeats. Labels that are null or neither
    0 nor 1 are left out; a key labelled twice counts as toxic if either label says so; null texts count as empty.
    """
    rows = labels.where(labels["toxic"].isin(0, 1) & labels[quoted(key)].isNotNull()).groupBy(labels[quoted(key)].alias("key")).agg(F.max("toxic").alias("toxic"))
    rows = rows.where(F.crc32(F.col("key").cast("string")) % 5 != 0)
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    drawn = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(sample) for y in (0, 1)]
    slim = docs.select(docs[quoted(key)].alias("key"), F.coalesce(docs[quoted(text)].cast("string"), F.lit("")).alias("text"))
    joined = slim.join(F.broadcast(drawn[0].unionByName(drawn[1])), "key").select(F.xxhash64("key", "text").alias("hash"), F.col("toxic").cast("int").alias("toxic"), "text")  # 2 * sample keys at most
    taken: set[int] = set()
    for y in (0, 1):
        left = chars // 2
        for r in joined.where(F.col("toxic") == y).select("hash", F.length("text").alias("n")).distinct().orderBy("hash").limit(sample).collect():
            if r["n"] <= left:
                taken.add(r["hash"])
                left -= r["n"]
    picked = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in sorted(taken)], "hash long"))
    got = sorted(joined.join(picked, "hash", "left_semi").dropDuplicates(["hash"]).collect())
    machine = learn(((r["toxic"], r["text"]) for r in got), counts.get(1, 0) / max(1, sum(counts.values())))
    del got
    give_back()
    return machine


def score_documents(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text decides the score.

    A null or empty text scores as one without words; very long texts are scored whole, in segments; rows that repeat
    come back as often as they came, with equal scores; a null key is not held out; an empty table gives no rows. Other columns of docs, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = sent.value([t or "" for t in b.column(1).to_pylist()])
            held = [zlib.crc32(str(k).encode()) % 5 == 0 if k is not None else False for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(docs[quoted(key)].alias("doc_id"), docs[quoted(text)].cast("string").alias("text"))
    return slim.mapInArrow(score, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text", most: float = 0.5) -> DataFrame:
    """docs, in their columns, without those that score `most` or more. Nulls, long texts and repeats as in score_documents(); columns may have any name."""
    sent, place = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(sent.value([t or "" for t in b.column(place).to_pylist()]) < most))

    return docs.mapInArrow(keep, docs.schema)
