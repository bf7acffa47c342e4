"""Spelling variants, exact top-k search and Ball k-means against brute force, on rows with nulls, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import kmeans, spelling, topk
from quarry.llm.vectors import whole

KIND = "vec_id bigint, embedding array<double>, label int, rid int, cluster string, `V` int"


def vectors(seed=3, n=300, d=64):
    rng = random.Random(seed)
    out = [(k, [rng.gauss(0, 0.2) for _ in range(d)]) for k in range(n)]
    out += [(1000 + k, out[20][1]) for k in range(60)] + [(20, out[40][1]), (40, out[40][1]), (40, out[40][1])]
    out += [(None, out[3][1]), (None, out[60][1])]
    bad = [None, [], [None] * d, [0.1] * (d - 1) + [math.nan], [math.inf] + [0.0] * (d - 1), [0.0] * d, [-0.0] * d, [0.5] * (d - 1), [0.5] * (d + 3)]
    return out + [(2000 + 20 * k, v) for k, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, None, 0) for i, v in rows], KIND)


def usable(rows):
    return [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def naive_topk(rows, by, k):
    rows, out = usable(rows), []
    for a, (q, x) in enumerate(rows):
        if q is None or q % by:
            continue
        scored = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0, i) for b, (i, y) in enumerate(rows) if a != b]
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k,slices,block", [(20, 4, 8 << 20), (3, 64, 4096), (500, 1, 1 << 14)])
def test_topk(spark, monkeypatch, k, slices, block):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "SUB", 7)
    rows = vectors()
    got = topk.search(frame(spark, rows), topk.F.col("vec_id") % 20 == 0, k, slices)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == naive_topk(rows, 20, k)


def test_topk_of_large_numbers(spark):
    """Products beyond what 24 and 53 bits hold stay exact; beyond 58 bits they raise."""
    for scale in (30.0, 5e5, 2e6):
        rows = [(i, [x * scale for x in v]) for i, v in vectors(5, 80, 9) if v and None not in v]
        got = topk.search(frame(spark, rows), topk.F.col("vec_id") % 20 == 0, 5)
        assert Counter(map(tuple, got.collect())) == naive_topk(rows, 20, 5)
    with pytest.raises(Exception, match="too large"):
        whole(frame(spark, [(1, [1e300])])).collect()


def test_topk_without_rows(spark):
    for rows in ([], [(20, None)], [(20, [0.5])], [(3, [0.5]), (4, [0.1])]):
        assert topk.search(frame(spark, rows), topk.F.col("vec_id") % 20 == 0).collect() == []


def test_thresholds_leave_rows_out():
    """The cutoff that tasks gather spares most rows phase 2, and is never above the k-th best score."""
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (400, 16))
    x[100:130] = x[0] + rng.integers(-1, 2, (30, 16))
    t = topk.Tile(np.arange(400), np.arange(400), np.zeros(400, bool), x)
    g = topk.Asked(np.arange(1), np.array([0]), np.array([0]), x[:1].astype(np.int64))
    ((_, parts),) = topk.partials(g, t, 4)
    exact = np.sort(np.delete(x, 0, 0) @ x[0])[::-1]
    share = -(-exact[19] // 4)
    reach = np.any([p[0] >= share for p in parts], 0)
    assert reach.sum() < 200 and all(reach[1 + np.flatnonzero((np.delete(x, 0, 0) @ x[0]) >= exact[19])])


def naive_kmeans(rows, k=16, rounds=3, d=64):
    rows = [(i, v) for i, v in usable(rows) if len(v) == d]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    for at in range(rounds + 1):
        dist = [[sum((x - y) ** 2 for x, y in zip(v, m)) for m in c] for _, v in rows]
        own = [min(range(len(c)), key=lambda j: (ds[j], j)) for ds in dist]
        if at < rounds:
            for j in range(len(c)):
                held = [v for (_, v), o in zip(rows, own) if o == j]
                c[j] = [sum(x) // len(held) for x in zip(*held)] if held else c[j]
    inertia = Counter()
    for ds, o in zip(dist, own):
        inertia[o] += ds[o]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, o, ds[o], inertia[o], sum(inertia.values()), sha[o]) for (i, _), ds, o in zip(rows, dist, own))


def test_kmeans(spark):
    rng = random.Random(8)
    blobs = [(k, [rng.choice((-1, 1)) * (k % 7) + rng.gauss(0, 0.02) for _ in range(1)] * 64) for k in range(200)]
    for rows in (vectors(), blobs, vectors()[:5], [(k, [0.25] * 64) for k in range(40)], [(None, [0.1] * 64)] * 3):
        got = kmeans.cluster(frame(spark, rows))
        assert Counter(tuple(r) for r in got.collect()) == naive_kmeans(rows)


def test_kmeans_without_rows(spark):
    got = kmeans.cluster(frame(spark, [(1, None), (2, [0.5])]))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_core_meets_no_neighbour():
    """Members nearer than half the gap to every other centroid are compared with none; the rest with those in reach."""
    c = np.array([[0, 0], [10, 0], [0, 30], [100, 100]], np.int64)
    x = np.array([[1, 1], [5, 0], [4, 0], [0, 14], [6, 0]], np.int64)
    between = kmeans.gaps(c)
    near = kmeans.neighbours(between, np.array([14.0, 0, 0, 0]))
    assert near[0].tolist() == [1] and kmeans.neighbours(between, np.full(4, np.inf))[0].tolist() == [1, 2, 3]
    who, d = kmeans.assign(x, np.zeros(5, np.int64), c, between, near)
    assert who.tolist() == [0, 0, 0, 0, 1] and d.tolist() == [2, 25, 16, 196, 16]
    assert kmeans.assign(x[:1], np.zeros(1, np.int64), c * 0 + [[0, 0], [10, 0], [1, 1], [1, 1]], between, near)[0].tolist() == [0]


def naive_words(docs, divisor=199):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % divisor else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def naive_variants(docs):
    v = naive_words(docs)
    close = defaultdict(list)
    for a in v:
        for b in v:
            if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b):
                close[a].append(b)
    form = {}
    for a, near in close.items():
        best = min(near, key=lambda b: (-v[b], b))
        if v[best] >= 5 * v[a]:
            form[a] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(close[w]), v.get(form.get(w))) for w, n in v.items()}


def spoilt(rng, w):
    k, ch = rng.randrange(len(w) + 1), rng.choice("aeinrstÀß×ÿ")
    return rng.choice([w[:k] + ch + w[k:], w[:k] + ch + w[k + 1 :], w[:k] + w[k + 1 :]])


def typed_docs(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(6, 12))) for _ in range(25)] + ["Strasse", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀÀ", "ÀÀÀÀÀ×"]
    words = [w for b in base for w in [b] * 200 + [spoilt(rng, b) for _ in range(40)] for _ in range(rng.choice([1, 3, 6]))]
    second = [spoilt(rng, spoilt(rng, b)) for b in base for _ in range(10)]
    words += second * 5 + ["x" * 5000] * 8 + ["x" * 5001] * 60 + ["x" * 2500 + "y" + "x" * 2499] * 5 + ["short"] * 50
    rng.shuffle(words)
    docs = [(k, " ".join(words[s : s + 40])) for k, s in enumerate(range(0, len(words), 40))]
    return docs + [docs[0]] * 30 + [(None, docs[1][1]), (5, None), (6, ""), (7, " 12 ½ "), (8, "Große-Straße " * 9)]


@pytest.mark.parametrize("block", [512, 2])
def test_spelling(spark, monkeypatch, block):
    """Blocks of three words and more cut down to one place give the same pairs as blocks left whole."""
    monkeypatch.setattr(spelling.pairs, "__defaults__", (6, block))
    docs = typed_docs()
    df = spark.createDataFrame([(i, t, "?", 1, None) for i, t in docs], "doc_id bigint, text string, word string, n int, `Form` string")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    want = naive_variants(docs)
    assert len(rows) == len(want) and set(rows) == want
    assert any(f and r != f for _, f, r, *_ in want) and max(x[4] for x in want) > 10


def test_spelling_without_words(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "too few words here")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert spelling.variants(df).collect() == []


def test_near_is_found_once_by_halves():
    """Every pair one edit apart shares a half, and lies in one interval of each cut."""
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 10)))
        b = spoilt(rng, a)
        a, b = sorted((a, b), key=len)
        if a == b or len(a) < 6:
            continue
        n = len(a)
        for mid in range(1, n + 1):
            hits = 0
            for lo, hi in ((0, mid), (mid, n + 1)):
                if a[:lo] == b[:lo] and (n - hi <= 0 or a[hi - n :] == b[hi - n :]):
                    i, _ = spelling.near([a, b], *(np.full(2, x) for x in (n, lo, hi, 0)))
                    hits += len(i)
            assert hits == one_edit(a, b)
