"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
import xxhash
from grantlake.llm import components, decontaminate, license_scan, line_dedup, mixing, quality, sharding, simhash, substring, token_files, toxicity, vptree
from grantlake.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _size int, fp string, key string"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def messy():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " more", None, "", " \t\n", "one", "one two", "x" * 3000, prose(rng, 6000), "In. " * 200]
    rows = [(i, t, "en", ["a", "b", None, "a"][i % 4], 0, 1, 2, 3, "f", "k") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[5], "en", "b", 0, 1, 2, 3, "f", "k"), (7, "another text with the same id", "en", "é", 0, 1, 2, 3, "f", "k")]


@pytest.fixture
def docs(spark, messy):
    return spark.createDataFrame(messy, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return WORD.findall(text or "")


# -- near duplicates


def fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in split(text)]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_match_brute_force(docs, messy):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(r[1]) for r in messy]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(messy):
        if r[0] is not None:
            least[find(i)].append(r[0])
    assert got == Counter((r[0], f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(messy))


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 8])
def test_forest_loses_no_pair(blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:120].copy()
    for i in range(120):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    points = np.unique(np.concatenate([base, near]))
    met = set()
    for mask, radius in vptree.block_masks(blocks, 4):
        tree = vptree.VPTree.build(points[::3], mask, radius, 16)
        for _, at in tree.route(points):
            met |= {frozenset((int(at[i]), int(at[j]))) for i, j in vptree.leaf_links(points[at], mask, radius, 4)}
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in met:
        a, b = pair
        assert int(points[a] ^ points[b]).bit_count() <= 4
        root[find(a)] = find(b)
    for i in range(len(points)):
        for j in range(i):
            if int(points[i] ^ points[j]).bit_count() <= 4:
                assert find(i) == find(j)


@pytest.mark.parametrize("n", [3000, 1 << 40])
def test_border_points_visit_every_shard_they_may_have_partners_in(n):
    rng = np.random.default_rng(7)
    points = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    visits = []
    for tree in simhash.forest(points, n if n > 4000 else 1 << 18, 4):
        shards = defaultdict(set)
        for leaf, at in tree.route(points):
            for i in at.tolist():
                shards[i].add(leaf)
        assert tree.leaves > 1 and len(shards) == len(points)
        visits.append(sum(map(len, shards.values())) / len(points))
        mask = np.uint64(tree.mask)
        for i in range(0, len(points), 50):
            for j in np.nonzero(np.bitwise_count((points ^ points[i]) & mask) <= tree.radius)[0].tolist():
                assert shards[i] & shards[j]
    if n == 3000:
        assert all(1.2 < v < 12 for v in visits)  # the boundary is crossed, but not by all
    else:
        assert all(v == 1 for v in visits)


def test_dense_leaves_join_like_all_pairs():
    """Large groups alike in the mask, and groups one bit apart."""
    rng = np.random.default_rng(11)
    center = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ np.bitwise_or(np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64), np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for c in center]))
    met: dict[int, int] = {}

    def find(x):
        while met.setdefault(x, x) != x:
            x = met[x]
        return x

    for mask, radius in vptree.block_masks(3, 4):
        for i, j in vptree.leaf_links(points, mask, radius, 4):
            assert int(points[i] ^ points[j]).bit_count() <= 4
            met[find(i)] = find(j)
    for i in range(len(points)):
        for j in range(i):
            assert int(points[i] ^ points[j]).bit_count() > 4 or find(i) == find(j)


def test_hot_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_SIZE", 32)
    fps = [(i, (1 << (i % 60)) | (1 << (i * 7 % 61))) for i in range(200)]
    table = spark.createDataFrame(fps, "key long, fp long")
    got = simhash.near_duplicates(table, fps=table)
    assert {r.component_id for r in got.collect()} == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect())
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v), near[v].add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        assert got.get(start, start) == min(seen)


# -- substring


def test_passages(spark):
    rng = random.Random(5)
    unique = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = unique(80)
    fuzzy = shared.split()
    for i in (13, 37, 61):
        fuzzy[i] = "other"
    rows = [(1, f"{unique(60)} {shared} {unique(30)}"), (2, f"{shared} {unique(90)}"), (3, unique(200)), (4, f"{unique(20)} {' '.join(fuzzy)} {unique(20)}"), (5, None), (6, ""), (7, "short one"), (8, unique(40) + " " + " ".join(shared.split()[:30])), (9, "Again " * 300), (10, "Again " * 300), (None, unique(70))]
    rows += [(20 + i, shared) for i in range(12)]
    got = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got} | {x for r in got for x in r.source_ids}
    assert found == {1, 2, 4, 9, 10} | {20 + i for i in range(12)}
    texts = dict(rows)
    for r in got:
        assert r.n_words >= 50 and r.identity >= 0.8
        if r.doc_id in (1, 2):
            assert " ".join(texts[r.doc_id].split()[r.first_word : r.last_word + 1]) == shared


def test_passages_of_odd_tables(docs, empty):
    assert substring.find_passages(empty).count() == 0
    got = {r.doc_id for r in substring.find_passages(docs).collect()}
    assert got <= {r[0] for r in docs.select("doc_id").collect()}


def zipf(rng, n):
    return rng.choices([f"z{i}" for i in range(5000)], [1 / (i + 1) for i in range(5000)], k=n)


def test_two_passages_of_a_pair_of_documents(spark):
    rng = random.Random(8)
    one, two = zipf(rng, 100), zipf(rng, 100)
    rows, spans = [], {}
    for pair, gap in enumerate((100, 400)):
        for i in range(2):
            head = zipf(rng, 30)
            rows.append((10 * pair + i, " ".join(f"{w}p{pair}" for w in [*head, *one, *zipf(rng, gap), *two, *zipf(rng, 30)])))
            spans[10 * pair + i] = {(30, 130), (130 + gap, 230 + gap)}
    got = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for pair in range(2):
        some = [r for r in got if r.doc_id // 10 == pair]
        assert len(some) == 2 and len({r.doc_id for r in some}) == 1
        for r, (lo, hi) in zip(sorted(some, key=lambda r: r.first_word), sorted(spans[some[0].doc_id]), strict=True):
            assert abs(r.first_word - lo) <= 8 and abs(r.last_word + 1 - hi) <= 8 and r.identity >= 0.8


def test_passage_of_which_another_document_holds_a_part(spark):
    rng = random.Random(6)
    unique = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for n, (size, part) in enumerate([(60, 40), (60, 49), (70, 49), (55, 30), (50, 49)] * 8):
        shared = unique(size)
        rows += [(10 * n, " ".join([*unique(30), *shared[:part], *unique(30)]))] + [(10 * n + i, " ".join([*unique(20 * i), *shared, *unique(30)])) for i in (1, 2)]
        want |= {10 * n + i: (20 * i, 20 * i + size - 1) for i in (1, 2)}
    got = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for n in range(40):
        some = [r for r in got if r.doc_id // 10 == n and (r.first_word, r.last_word) == want.get(r.doc_id)]
        assert some and {some[0].doc_id, *some[0].source_ids} >= {10 * n + 1, 10 * n + 2}


def test_passages_against_all_pairs(spark):
    """Whatever windows of 50 words two documents share, each of the two is named, and the rows found cover them; a few edits do not matter."""
    rng = random.Random(12)
    docs = {i: zipf(rng, rng.randrange(80, 300)) for i in range(120)}
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    fuzzy = []
    for n in range(60):
        passage = fresh(rng.randrange(50, 130))
        third = len(passage) // 3
        holders = rng.sample(range(120), rng.randrange(2, 5))
        for i in holders:
            own = list(passage)
            if n % 3 == 2:  # 5 of 100 words are others
                for k in rng.sample(range(len(own)), len(own) // 20):
                    own[k] = fresh(1)[0]
                fuzzy += [(i, own)]
            at = rng.randrange(len(docs[i]))
            docs[i][at:at] = own
        if n % 3 == 1:  # each third of the passage is quoted by others
            for i in rng.sample(sorted(set(range(120)) - set(holders)), 12):
                part = rng.randrange(3)
                docs[i] += [*passage[part * third : (part + 1) * third], *fresh(3)]
    got = substring.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    holders = defaultdict(list)
    for i, ws in docs.items():
        for at in range(len(ws) - 49):
            holders[tuple(ws[at : at + 50])].append((i, at))
    shared = {w: h for w, h in holders.items() if len({i for i, _ in h}) > 1}
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.first_word, r.last_word))
    sources = {x for r in got for x in r.source_ids}
    covered = lambda i, at: any(lo <= at and at + 49 <= hi for lo, hi in spans[i])
    for h in shared.values():
        assert sum(not covered(i, at) for i, at in h) <= 1 and all(covered(i, at) or i in sources for i, at in h)
    named = [i in sources or i in spans for i, own in fuzzy if len(own) >= 60]
    assert sum(named) >= 0.95 * len(named) and len(shared) > 500


@pytest.mark.parametrize("every", [5, 6, 10])
def test_passages_with_many_edits(spark, every):
    rng = random.Random(every)
    rows = []
    for n in range(20):
        shared = zipf(rng, 100)
        edited = [f"edit{rng.randrange(10**9)}" if i % every == every - 1 else w for i, w in enumerate(shared)]
        rows += [(2 * n + i, " ".join(f"{w}n{n}" for w in [*zipf(rng, 60), *body, *zipf(rng, 60)])) for i, body in enumerate((shared, edited))]
    got = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id // 2 for r in got} == set(range(20)) and all(r.identity >= 0.8 for r in got)


def test_alignment_is_longest_and_cut_where_it_does_not_agree(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(substring, "BLOCK", 7)
    for _ in range(60):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(0, 50))] for _ in range(2))
        got = substring.matched(x, y)
        assert len(got) == substring.common(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))
    new = iter(range(1000, 9000))
    p, q = [next(new) for _ in range(60)], [next(new) for _ in range(60)]
    b, a = ([*p, *(next(new) for _ in range(70)), *q] for _ in range(2))
    assert substring.pieces(np.array(b), np.array(a), 25, 0.8) == [(0, 60, 1.0), (130, 190, 1.0)]


def test_chains_and_alignment():
    rng = random.Random(2)
    for _ in range(30):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert substring.common(x, y) == table[-1][-1]
    for _ in range(30):
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        best, back = {}, {}
        for i, (b, a) in enumerate(pairs):
            options = [(best[j] - substring.GAP / 2 * (a - pairs[j][1] + b - pairs[j][0]), j) for j in range(i) if pairs[j][0] < b and pairs[j][1] < a]
            gain, back[i] = max(options, default=(0.0, -1))
            best[i] = substring.WORTH + max(0.0, gain)
            back[i] = back[i] if gain > 0 else -1
        end = max(best, key=best.get)
        first = end
        while back[first] >= 0:
            first = back[first]
        found = substring.chains([b for b, _ in pairs], [a for _, a in pairs], 0)
        if first != end and sorted(best.values())[-2] < best[end] - 1e-9:
            assert found[0][1] == pairs[end][0] and found[0][3] == pairs[end][1]


# -- mixing


def test_mix_follows_the_schedule(docs, messy):
    got = mixing.mix_report(docs, block=7).collect()
    sizes = Counter()
    for r in messy:
        sizes[r[3]] += len(split(r[1]))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(split(r[1]))) for r in messy)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    share, capped = {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: 2 * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    blocks = scheduled([(s, share[s]) for s in names], total, 7)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, share[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        assert (r.first_slot is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert {s: taken[s] for s in names} == {s: min(7 * blocks[s], 2 * sizes[s]) for s in names}
    assert all(abs(taken[s] - share[s]) <= 7 * 5 for s in names)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_report(docs.repartition(3), block=7).collect()))
    words = sum(len(split(r.text)) for r in mixing.mixed_documents(docs, block=7).collect())
    assert words == sum(taken.values())
    # another schedule takes other words
    ordered = mixing.mix_report(docs, block=7, point=lambda slot, bits: slot).collect()
    assert Counter((r.doc_id, r.taken) for r in ordered) != Counter((r.doc_id, r.taken) for r in got)


def scheduled(shares, total, block):
    """How many of the first slots each source gets, by the radical inverse in plain Python."""
    slots = int(total / block + 0.5)
    bits, out = max(1, (slots - 1).bit_length()), Counter()
    for i in range(slots):
        x, at = int(f"{i:0{bits}b}"[::-1], 2) / 2**bits * total, 0.0
        for s, share in shares:
            at += share
            if x < at - 1e-9:
                out[s] += 1
                break
    return out


def test_mixed_rows_in_the_order_of_their_slots(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 64), "abc"[i % 3]) for i in range(300)]
    at = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(mixing.mixed_documents(at, slot="slot").collect(), key=lambda r: r.slot)
    total = Counter(r.source for r in got)
    for n in (len(got) // 4, len(got) // 2):  # rows, not slots, are counted
        some = Counter(r.source for r in got[:n])
        assert all(abs(some[s] - total[s] * n / len(got)) <= 12 for s in "abc")
    first = {r.doc_id: r.first_slot for r in mixing.mix_report(at).collect()}
    assert all(first[i] == min((r.slot for r in got if r.doc_id == i), default=None) for i in first)
    assert mixing.mixed_documents(at).columns == at.columns


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert [r.taken for r in mixing.mix_report(spark.createDataFrame([(1, None, "s"), (2, "", "s")], "doc_id long, text string, source string")).collect()] == [0, 0]


def test_schedule_is_even(spark):
    shares = [(0, 50.0), (2, 30.0), (3, 0.0), (5, 15.0), (7, 5.0)]
    rows = mixing.schedule(spark, shares, 100.0, 1000).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1000))
    for n in (100, 333, 500, 1000):
        some = Counter(r.source for r in rows[:n])
        assert all(abs(some[i] - n * t / 100) <= 5 for i, t in shares)
    for i, _ in shares:
        assert [r.block for r in rows if r.source == i] == list(range(sum(r.source == i for r in rows)))


# -- quality


def base(text):
    text = text or ""
    ws = split(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, messy):
    extra = [(900, "a b c a b c a b c x\n\na b\na b\n \n*|<>&$#% ééé", *messy[0][2:]), (901, "one two three four " * 4, *messy[0][2:])]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge_quality(table).collect())
    want = Counter()
    for r in [*messy, *extra]:
        b = base(r[1])
        want[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def quality_votes(text):
    """The votes of the rules on a text, in plain Python."""
    text = text or ""
    n, chars, symbols, dups, repeats = base(text)
    lines = sum(1 for x in text.split("\n") if split(x))
    upper, letters = sum("A" <= c <= "Z" for c in text), sum("a" <= c.lower() <= "z" and c.isascii() for c in text)
    stops, known = sum(c in ".?" for c in text), {x for w in quality.FUNCTION_WORDS.split() for x in (w, w.capitalize())}
    function = sum(w in known for w in split(text))
    say = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        say(n < 50, n >= 80),
        say(100 * symbols > 10 * n, 100 * symbols <= 2 * n),
        say(100 * repeats > 30 * n, 100 * repeats <= 5 * n),
        say(100 * dups > 30 * lines, dups == 0 and lines > 1),
        say(100 * upper > 40 * letters, letters <= 100 * upper <= 15 * letters),
        say(100 * text.count("!") > 15 * n, 100 * text.count("!") <= 2 * n),
        say(chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 9 * n),
        say(100 * stops < n or 100 * stops > 60 * n, 3 * n <= 100 * stops <= 25 * n),
        say(100 * function < 5 * n, 100 * function >= 15 * n),
        say(n < 4 * lines, n >= 8 * lines),
    )


def plain_posteriors(votes):
    """Expectation-maximisation document by document, with the same start and hold."""
    first, hold = [r.start() for r in quality.RULES], max(1.0, 0.05 * len(votes))
    prior, like = 0.7, first
    for _ in range(100):
        post = []
        for vs in votes:
            good, bad = prior, 1 - prior
            for v, (b, g) in zip(vs, like, strict=True):
                good, bad = good * g[v], bad * b[v]
            post.append(good / (good + bad))
        new = []
        for i, (b, g) in enumerate(first):
            sums = [{v: hold * p for v, p in one.items()} for one in (b, g)]
            for vs, p in zip(votes, post, strict=True):
                sums[0][vs[i]] += 1 - p
                sums[1][vs[i]] += p
            new.append([{v: c / sum(one.values()) for v, c in one.items()} for one in sums])
        before, prior, like = prior, (sum(post) + 0.7 * hold) / (len(votes) + hold), new
        if abs(prior - before) < 1e-9:
            break
    out = []
    for vs in votes:
        good, bad = prior, 1 - prior
        for v, (b, g) in zip(vs, like, strict=True):
            good, bad = good * g[v], bad * b[v]
        out.append(good / (good + bad))
    return out


def test_quality_verdict_against_plain_expectation_maximisation(spark):
    rng = random.Random(21)
    words = quality.FUNCTION_WORDS.split()

    def document(kind):
        lines = []
        for _ in range(rng.randrange(2, 9)):
            line = [rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("bcdfglmnrstaeiou") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(8, 30))]
            lines.append(" ".join(line).capitalize() + ".")
        if kind == 1:
            lines = [w + rng.choice(["###", "$$$", "***"]) for x in lines for w in [x]] + ["# $ % & | * < >"] * 6
        if kind == 2:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if kind == 3:
            lines = lines[:1] * 12
        if kind == 4:
            lines = [w for x in lines for w in x.split()]
        if kind == 5:
            lines = [x.replace(".", "") for x in lines]  # one mild fault alone
        return "\n".join(lines)

    texts = [document(rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5])) for _ in range(300)] + [None, "", "one", "x " * 400]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    votes = [quality_votes(t) for t in texts]
    want = plain_posteriors(votes)
    for i, (t, p) in enumerate(zip(texts, want, strict=True)):
        b = base(t)
        assert math.isclose(got[i].posterior, p, rel_tol=1e-6, abs_tol=1e-9)
        assert got[i].kept == (not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and p >= 0.5)
    # the posterior is no conjunction: one bad vote may be outweighed, and reliable ones are not
    failed = [got[i].base_failed for i in range(len(texts))]
    assert any(got[i].kept and -1 in votes[i] for i in range(len(texts))) and any(not got[i].kept and -1 in votes[i] and not failed[i] for i in range(len(texts)))


def test_label_model_finds_the_junk():
    rng = random.Random(4)
    patterns, truth = Counter(), {}
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple(rng.choices((-1, 0, 1), (0.01, 0.09, 0.9) if good else (0.3, 0.2, 0.5))[0] for _ in quality.RULES)
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    model = quality.LabelModel.fit(dict(patterns))
    right = 0
    for votes, n in truth.items():
        logit = math.log(model.prior / (1 - model.prior)) + sum(r[v] for r, v in zip(model.ratios, votes, strict=True))
        right += n[logit >= 0]
    assert right / 4000 > 0.95 and abs(model.prior - 0.8) < 0.05


def test_quality_of_nothing(empty):
    assert quality.judge_quality(empty).count() == 0


# -- lines


def test_boilerplate_lines(spark):
    pages = [(i, f"https://U@Site.example.com:8080/{i}", f"<html><head><title>t</title></head><body><p>Menu &amp; more</p><p>own {i}</p>{'<p>rare</p>' if i < 2 else ''}</body></html>") for i in range(30)]
    pages += [(100, "not a url", None), (101, None, "<p>Menu &amp; more</p>"), (102, "http://b.example.com", ""), pages[0]]
    rows = {}
    for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        rows[r.page_id] = r
    assert rows[5].text == "own 5" and rows[5].n_dropped == 1 and rows[5].host == "site.example.com"
    assert rows[0].text.splitlines() == ["own 0", "rare"] and rows[0].n_dropped == 1  # 3 of 31 pages are under a tenth
    assert rows[101].text == "Menu & more" and rows[101].host == "" and rows[100].n_lines == 0 and rows[102].text == ""
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_lines(pages, ratio=0.1, repeats=3):
    """(page_id, host, n_lines, n_dropped, text) of pages (page_id, url, text)."""
    cut = [(i, (re.match(r"[a-z]+://([^/]*)", u or "") or [None, ""])[1], [" ".join(x.split()) for x in (t or "").split("\n") if x.split()]) for i, u, t in pages]
    hosts, held = Counter(h for _, h, _ in cut), Counter((h, x) for _, h, ls in cut for x in set(ls))
    out = Counter()
    for i, h, ls in cut:
        kept = [x for x in ls if not (held[h, x] >= repeats and held[h, x] >= hosts[h] * ratio)]
        out[(i, h, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
    return out


def test_lines_of_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    rng = random.Random(17)
    pages = []
    for i in range(300):
        site = "hot" if i % 3 == 0 else f"s{i % 40}"
        ls = [rng.choice([f"menu of {site}", "  menu\tof all ", f"own {i}", f"own {i}", f"part {rng.randrange(12)}", "", " \t "]) for _ in range(rng.randrange(12))]
        pages.append((i, f"http://{site}/{i}", "\n".join(ls)))
    pages += [pages[0], pages[0], (None, None, "a\nb"), (None, None, None), (7, "http://long/", "long " * 60000 + "\nx"), (8, "http://tie/", "t")] + [(400 + i, "http://tie/", "t" if i < 2 else f"u{i}") for i in range(29)]
    got = Counter(map(tuple, line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, body string"), html=None, text="body").collect()))
    assert got == brute_lines(pages)
    assert (8, "tie", 1, 1, "") in got  # 3 of 30 pages: exactly a tenth


# -- licences


def test_licenses(spark, docs, empty):
    rows = [(1, "x " * 40 + "Released under the MIT License. " + "y " * 30), (2, "Licensed under the Apache  License; version 2.0"), (3, "released under the GPL license"), (4, None), (5, ""), (6, "word " * 5000 + "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License.")]
    got = Counter((r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, "MIT notice"): 2, (2, "Apache-2.0 notice"): 1, (6, "GPL-3.0 notice"): 1, (7, "CC-BY-NC-4.0 notice"): 1})
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(docs).count() == 0
    own = spark.createDataFrame([("long", " ".join(f"t{i}" for i in range(100))), ("none", ""), ("null", None)], "name string, text string")
    part = " ".join(f"t{i}" for i in range(10, 97))
    got = license_scan.scan_licenses(spark.createDataFrame([(1, "a b c " + part)], "doc_id long, text string"), own).collect()
    assert [(r.license, r.first_word, r.last_word) for r in got] == [("long", 3, 89)] and abs(got[0].containment - 83 / 96) < 1e-9


@pytest.mark.parametrize("block", [1, 1000])
def test_licenses_with_ties_equal_names_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(license_scan, "BLOCK", block)
    notice = "permission to use this thing is given to all who read it with care"
    own = spark.createDataFrame([("same", notice), ("same", notice.upper()), ("other", "you may not sell copies of this work to others"), ("prefix", "permission to use this thing is given")], "name string, text string")
    long = " ".join(f"v{i}" for i in range(20000))
    rows = [(1, f"{notice}. {notice}"), (1, f"{notice}. {notice}"), (None, f"{long} you may not sell copies of this work to others {long}"), (3, "permission to use another thing is given")]
    got = Counter(map(tuple, license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), own).collect()))
    n = len(notice.split())
    assert got == Counter({(1, "same", n - 4, 1.0, 0, 2 * n - 1): 4, (1, "prefix", 3, 1.0, 0, 6): 2, (None, "other", 6, 1.0, 20000, 20009): 1})


# -- sharding


def test_shards(docs, messy, empty):
    rows = sharding.shard_records(docs).collect()
    assert len(rows) == len(messy) and sharding.shard_records(empty).count() == 0
    slots = defaultdict(list)
    for r in rows:
        body = (r.text or "").encode()
        assert r["size"] == len(body) + 8 and r.text_crc32 == zlib.crc32(body) and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


def test_weights_share_rows(spark):
    table = spark.range(6000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r.shard for r in sharding.shard_records(table, weights=(1, 2, 3)).collect())
    assert all(abs(n[i] / 6000 - (i + 1) / 6) < 0.03 for i in range(3))


# -- token files


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_files_round_trip(spark, docs, messy, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    folder, files = token_files.write_token_files(docs, tokenizer, files=3)
    got = sorted(token_files.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = Counter((r[0], struct.pack(f"<{len(ids)}I", *ids)) for r in messy for ids in [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2]])
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert token_files.read_token_files(spark, *token_files.write_token_files(empty, tokenizer)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoder_agrees_with_whole_texts(name, messy):
    """Settings that keep words apart get the short way, others none; ids are those of the library either way."""
    import pyarrow as pa

    path = pytest.importorskip("public_tokenizers").path(name)
    encoder = token_files.Encoder(path)
    assert encoder.by_word == (name == "word_bpe_49k.json")
    odd = ["", "  x ", "A\u0301, b<\u0338c", "H\u0331 h\u0331", "~ ~~ a~b", "<|StartOfText|> hi<|endoftext|>x", "don't we'll 'S it's,'tis", "\u0130I \u0131K\u212a \u03a3\u0391\u03a3, \u03a3.", "a.b,c;;d--e_f 12ab3,4", "x\u00a0y\u2028z\x85q", "w" * 500 + " " + "w" * 500]
    texts = [r[1] or "" for r in messy] + odd
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert [x.tolist() for x in encoder(pa.array(texts))] == want
    assert [x.tolist() for x in encoder(pa.array(["pad", *texts]).slice(1))] == want


def test_encoder_forgets_and_checks_settings(monkeypatch, tokenizer):
    import json

    import pyarrow as pa

    for name, value in (("CACHE_WORDS", 3), ("STEP_BYTES", 40), ("CALL_WORDS", 2), ("CACHE_LENGTH", 6)):
        monkeypatch.setattr(token_files, name, value)
    texts = [f"some words{i} and morewords{i % 3}, again and again" for i in range(30)]
    encoder = token_files.Encoder(tokenizer)
    assert [x.tolist() for x in encoder(pa.array(texts))] == encoder.encode_all(texts)
    spec = json.loads(open(tokenizer, encoding="utf-8").read())
    assert token_files.parts_words(spec)
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}, {"padding": {}} | {"truncation": {"max_length": 8}}):
        assert not token_files.parts_words(spec | change)


def test_token_files_by_key(spark, docs, messy, tokenizer):
    folder, files = token_files.write_token_files(docs, tokenizer, files=4)
    every = token_files.read_token_files(spark, folder, files).collect()
    for keys in ([7, 3, 999], [None], [None, 3, -5], []):
        got = token_files.read_token_files(spark, folder, files, keys).collect()
        assert Counter(map(str, got)) == Counter(str(r) for r in every if r.doc_id in keys)
    least = spark.createDataFrame([(-(1 << 63), "a"), (None, "b"), (None, None)], "doc_id long, text string")
    folder, files = token_files.write_token_files(least, tokenizer, files=1)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_files.read_token_files(spark, folder, files).collect()) == [("-9223372036854775808", 2), ("None", 1), ("None", 2)]
    assert token_files.read_token_files(spark, folder, files, [-(1 << 63)]).count() == 1
    with pytest.raises(ValueError, match="integer"):
        token_files.write_token_files(docs, tokenizer, key="key")


def test_reader_decompresses_one_frame_and_sees_damage(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    out = BytesIO()
    writer = token_files.Writer(out)
    docs = [np.arange(i, i + n, dtype="<u4").tobytes() for i, n in enumerate([3, 0, 20, 1, 7, 5])]
    for i, d in enumerate(docs):
        writer.add(i, d)
    writer.close()
    reader = token_files.Reader(BytesIO(out.getvalue()))
    read = []
    plain = reader.frame
    reader.frame = lambda i: (read.append(i), plain(i))[1]
    assert [reader.ids(i) for i in (4, 2, 1, 5)] == [docs[i] for i in (4, 2, 1, 5)] and len(read) == 3
    bad = bytearray(out.getvalue())
    bad[6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(BytesIO(bytes(bad))).ids(0)


# -- decontamination


def brute(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = norm(text), set(), set()
    for item, t in items:
        ws = norm(t)
        n = min(13, len(ws))
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item) if item is not None else "")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("size", [1_000_000, 40])
def test_contamination(spark, docs, messy, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
    items = [(1, " ".join(messy[4][1].split()[:30]).upper()), (2, messy[4][1][5:200]), (10, "one two"), (3, None), (4, "..."), (5, " ".join(messy[49][1].split()[100:113])), (None, "x" * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.contamination(docs, bench).collect())
    assert got == Counter((r[0], *brute(r[1], items)) for r in messy)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r[1], items)[4] for r in messy)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").where("doc_id in (4, 5, 46)").collect()}
    assert brute(cut[4], items)[1] == 0 and cut[5] == messy[5][1] and cut[46] == "one"


def test_contamination_by_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(empty, none).count() == 0


# -- toxicity


def labelled(n=500):
    rng = random.Random(9)
    clean = ["".join(rng.choice("bcdfglnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["idiot", "moron", "scumbag", "worthless"], 3):
                words[rng.randrange(40)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = labelled()
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(table, marks)
    got = {r.doc_id: r for r in toxicity.score_documents(table, machine).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.95
    odd = machine.windows([" idiot ", " idioot ", " badena "])
    assert odd[0] > odd[2] and odd[1] > odd[2] + 0.5
    assert toxicity.score_documents(empty, machine).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, machine).collect())
    kept = toxicity.drop_toxic(table, machine)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    alone = toxicity.train(table, marks.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_documents(table, alone).collect()} == {0}


def normal_text(text):
    """Lower-case letters, one space between words, three or more letters alone in a row as one word."""
    words = [w for w in ("".join(c for c in w if c.isalpha()) for w in text.lower().split()) if w]
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and len(words[j]) == 1:
            j += 1
        if j - i >= 3:
            out.append("".join(words[i:j]))
            i = j
        else:
            out.append(words[i])
            i += 1
    return out


def all_subsequences(window):
    """Every subsequence of three characters that spans SPAN at most, with its weight."""
    out = Counter()
    for i in range(len(window)):
        for j in range(i + 1, len(window)):
            for k in range(j + 1, min(len(window), i + toxicity.SPAN)):
                out[window[i] + window[j] + window[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_windows_and_kernel_against_brute_force():
    texts = ["You i d i o t there, a.b", "", "  one\n two\tTHREE ", "x y", "don't stop", "é l è v e", "w" * 130 + " end", "123 456", "a b c", "q r s t\x85u"]
    stream = toxicity.Stream.of(texts)
    for i, text in enumerate(texts):
        words = normal_text(text)
        got = [stream.text(j) for j in range(stream.bounds[i], stream.bounds[i + 1])]
        want = [f" {w} " for w in words if len(w) <= toxicity.PIECE] + [f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if len(a) + len(b) + 2 <= toxicity.PIECE]
        assert sorted(w for w in got if i != 6) == sorted(w for w in want if i != 6)
    long = [stream.text(j) for j in range(stream.bounds[6], stream.bounds[7])]
    assert " end " in long and len(long) > 4 and max(map(len, long)) == toxicity.PIECE + 2
    windows = [" idiot ", " idioot ", " you idiot ", " table ", " a "]
    k = toxicity.kernel(windows, windows[:3])
    for i, a in enumerate(windows):
        for j, b in enumerate(windows[:3]):
            x, y = all_subsequences(a), all_subsequences(b)
            norm = lambda w: math.sqrt(sum(toxicity.DECAY ** (2 * (z - p + 1)) for p in range(len(w)) for m in range(p + 1, len(w)) for z in range(m + 1, min(len(w), p + toxicity.SPAN))))
            assert math.isclose(k[i, j], sum(v * y[s] for s, v in x.items()) / norm(a) / norm(b), abs_tol=1e-5)
    table = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    at = toxicity.Stream.of(["you idiot idioot", "table"])
    for j, score in enumerate(at.sums(table)):
        assert math.isclose(score, float(toxicity.Machine(table, 0.0, np.zeros(3)).windows([at.text(j)])[0]), abs_tol=1e-5)


def test_scores_of_texts_in_segments(monkeypatch):
    rng = random.Random(4)
    machine = toxicity.Machine(np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32) / 4, -0.5, np.array([1.0, 0.5, 0.1]))
    texts = [" ".join(rng.choice(["alpha", "beta", "idiot", "zeta"]) for _ in range(rng.randrange(60))) for _ in range(20)]
    alone = [float(machine([t])[0]) for t in texts]
    assert np.allclose(machine(texts), alone)
    monkeypatch.setattr(toxicity, "STEP", 64)
    assert np.allclose(machine.inputs(["idiot " * 100])[0, 0], machine.inputs(["idiot " * 3])[0, 0]) and len(machine(texts)) == 20


def test_training_takes_a_bounded_sample_and_two_words_of_an_insult(spark):
    rng = random.Random(6)
    rows, labels = labelled(400)
    common = ["bad", "apple"]  # each word alone is in clean texts, too
    for i in range(400):
        words = [rng.choice(["mo", "ra", "ti", "lo", "ku"]) + rng.choice(["na", "se", "ri"]) for _ in range(40)]
        at = rng.randrange(38)
        words[at : at + 2] = common if i % 4 == 0 else common[::-1]
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(i % 4 == 0)))
    only = [r for r in rows if r[0] >= 1000]
    machine = toxicity.learn([(y, t) for (_, t), (_, y) in zip(only[:300], labels[400:700], strict=True)], 0.25)
    found = machine([t for _, t in only[300:]]) >= 0.5
    assert sum(bool(f) == bool(y) for f, (_, y) in zip(found, labels[700:], strict=True)) >= 95
    table, marks = spark.createDataFrame([*rows[:400], *rows[:400], (4, "x " * 5000)], "doc_id long, text string"), spark.createDataFrame([*labels[:400], (4, 1)], "doc_id long, toxic int")
    small = toxicity.train(table, marks, sample=60, chars=20_000)
    assert np.array_equal(small.table, toxicity.train(table.repartition(5), marks, sample=60, chars=20_000).table)
    recall, flagged = toxicity.cross_validate([(y, t) for (_, t), (_, y) in zip(rows[:400], labels[:400], strict=True)], folds=3)
    assert recall > 0.9 and flagged < 0.1
