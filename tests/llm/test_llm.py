"""The training-data operators against brute force on small tables that hold nulls, ties, repeats and clashing columns."""

import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, embeddings, html, language, linededup, lm, mix, quality, shard, simhash
from quarry.llm.common import components

rng = random.Random(5)
WORDS = [a + b for a in ("ta", "ri", "mo", "ke", "lu", "sha", "ve") for b in ("n", "ra", "do", "sk", "bel", "tu", "pi")]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


BASE = sentence(120)
TEXTS = [BASE, BASE, BASE + " extra", "", None, " \t\n", "one", "one two", "One TWO", "Á é", sentence(5000), sentence(60), "\n".join([sentence(9)] * 3)]
DOCS = [(i, t, "src" if i % 3 else None, "en", i) for i, t in enumerate(TEXTS)] + [(0, BASE, "src", "en", 1), (None, BASE, None, None, None)]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"size": F.lit("x"), "_Row": F.lit(1), "id": F.lit("y")})


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = roots({x for l in links for x in l if l != (7, 7)}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_plans(spark, monkeypatch):
    """No plan of a round holds the edges more than a few times: the driver keeps and re-plans all of it."""
    held, write = [], common.materialize

    def counted(df):
        held.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df)

    monkeypatch.setattr(common, "materialize", counted)
    links = [(i, i + 1) for i in range(9)] + [(20, 20 + i) for i in range(1, 9)]
    found = common.components(write(spark.createDataFrame(links, "a long, b long")), "a", "b")
    assert {r.root for r in found.collect()} == {0, 20}
    assert len(held) > 2 and max(held) <= 8, held


def naive_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) % 2**64 == naive_fingerprint(t)


def signed(xs):
    return [x - 2**64 if x >= 2**63 else x for x in xs]


def test_simhash_links(spark):
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base) | {0, 1, 3, 2**63, 2**64 - 1}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed(fps)], "fp long")).collect()
    all_links = [(a, b) for a in signed(fps) for b in signed(fps) if a < b and (a % 2**64 ^ b % 2**64).bit_count() <= 2]
    assert roots(signed(fps), [(r.a, r.b) for r in got]) == roots(signed(fps), all_links)


def test_simhash_tally():
    """Pairs meet on C(m, 6) lists for m shared positional bytes: on none below six, where the bits are never looked at."""
    x = rng.getrandbits(64)
    for spoilt, lists in ((0, 28), (1, 7), (2, 1), (3, 0), (8, 0)):
        y = x ^ sum(1 << 8 * p + rng.randrange(8) for p in rng.sample(range(8), spoilt))
        assert sum((x & m % 2**64) == (y & m % 2**64) for m in simhash.MASKS) == lists
    near, far = np.array([x, x ^ 3 << 8, x ^ 7 << 16], np.uint64).view(np.int64), np.array([x, x ^ 7], np.uint64).view(np.int64)
    assert len(simhash.star(near)[0]) == 1 and len(simhash.star(far)[0]) == 0  # on one list, but three bits apart


def test_simhash_long_list():
    x = np.unique(np.array([rng.getrandbits(16) for _ in range(3000)], np.int64))
    a, b = simhash.star(x, 256)
    near = np.bitwise_count((x[:, None] ^ x).view(np.uint64)) <= 2
    assert roots(x.tolist(), zip(a.tolist(), b.tolist())) == roots(x.tolist(), [(int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(near)) if i < j])


def test_simhash_docs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    fp = {t: naive_fingerprint(t) for t in TEXTS}
    ids = defaultdict(list)
    for i, t, *_ in DOCS:
        ids[fp[t]].append(i)
    comp = roots(ids, [(a, b) for a in ids for b in ids if a < b and (a ^ b).bit_count() <= 2])
    least = {f: min(x for g in ids if comp[g] == comp[f] for x in ids[g] if x is not None) for f in ids}
    assert Counter((r.id, r.fp % 2**64, r.component_id) for r in got) == Counter((i, fp[t], least[fp[t]]) for i, t, *_ in DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_unlike_texts_under_one_id(spark):
    a, b, c = (sentence(80) for _ in range(3))
    rows = [(7, a, 1), (7, b, 2), (3, c, 3), (7, c, 4), (None, c, 5), (None, sentence(80), 6), (9, b.upper(), 7), (7, a, 1), (7, a, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(7, a), (7, b), (3, c), (0, rows[5][1])])


def test_contamination(spark, monkeypatch):
    w = [sentence(1) + str(i) for i in range(200)]
    items = [(1, " ".join(w[:20])), (2, "Short ITEM"), (3, None), (4, "..."), (None, "skip me"), (5, " ".join(w[:13])), (2, "short item"), (None, " ".join(w[50:64])), (9, " ".join(w[20:45])), (10, " ".join(w[150:162])), (11, " ".join(["la"] * 40))]
    texts = [
        "x " + ", ".join(w[:20]).upper() + " y", " ".join(w[2:14]), "a short item b", None, "", "shortitem", " ".join(w[5:19]) + " é " * 400,
        "it is short ITEM " * 3, " ".join(w[49:70]), " ".join(w[21:33]) + " x " + " ".join(w[30:46]) + " " + " ".join(w[20:34]), " ".join(w[145:165]), "la " * 12, "la " * 90, " ".join(w[:13]) + " " + sentence(259), " ".join(w[:13]) + " " + sentence(247),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, contamination int")

    def naive(t):
        token = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in s or ""))
        words, hit, who = token(t), set(), set()
        for i, x in items:
            x = token(x)
            for k in range(max(1, len(x) - 12) if x else 0):
                win = x[k : k + 13]
                for at in range(len(words) - len(win) + 1):
                    if words[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        who |= {str(i)} if i is not None else set()
        return len(words), len(hit), sorted(who)

    monkeypatch.setattr(decontaminate, "PIECE", 30)
    for size in (decontaminate.BLOCK_BYTES, 150):
        for r in decontaminate.contamination(d, b, block_bytes=size).collect():
            c = r.contamination
            assert (c.n_words, c.n_hit, c["items"]) == naive(texts[r.doc_id]), r.doc_id
            for s, e in c.spans:
                assert decontaminate.words(texts[r.doc_id][s:e]) and texts[r.doc_id][s - 1 : s].strip(" ,") == ""
    kept = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert kept == {i for i, t in enumerate(texts) if not (naive(t)[1] and 20 * naive(t)[1] >= naive(t)[0])}
    assert decontaminate.clean(d, b.limit(0)).count() == len(texts)
    dotted = d.withColumn("a.b", F.lit(1))
    assert decontaminate.clean(dotted, b).columns == dotted.columns and decontaminate.clean(dotted.limit(0), b).count() == 0


def test_shard(spark, docs):
    got = shard.shard(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in DOCS)
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 50).otherwise(F.repeat(F.lit("x"), (F.col("id") % 400).cast("int"))).alias("text"))
    sums = [r.b for r in shard.shard(many, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 40 and max(sums) < 1.01 * min(sums)
    assert shard.shard(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("same,other", [(2000, 2000), (300, 0), (3, 40)])
def test_shard_repeated_rows(spark, same, other):
    rows = [(5, "again and again", k) for k in range(same)] + [(10 + k, sentence(rng.randrange(1, 8)), k) for k in range(other)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    got = shard.shard(d, 40, range_bytes=500).collect()
    assert Counter((r.doc_id, r.text, r["a.b"]) for r in got) == Counter(rows)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in got)
    assert max(held[k] for k in range(40)) - min(held[k] for k in range(40)) <= 2 * biggest


def test_mix(spark, docs):
    rows = [(i, sentence(rng.randrange(1, 60)), [None, "a", "b", "é", "z"][i % 5] if i % 2 else "hot") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Size", F.lit(1)).withColumn("mean", F.lit(2))
    got = mix.copies(d).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, goal = set(), {}
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        goal = {s: 3 * size[s] if s in full else left * w[s] / sum(w[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and goal[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source] and math.isclose(r.target, goal[r.source])
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in order)
    again = {(r.doc_id, r.copies) for r in mix.copies(d.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert mix.mixed(d).columns == d.columns and mix.mixed(d).count() == sum(r.copies for r in got)
    assert mix.copies(docs).count() == len(DOCS) and mix.copies(docs.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + 0.02 * r.normal(size=(20, 24)), base[:10], base[:1] + 0.05 * r.normal(size=(150, 24))]).astype(np.float32)
    rows = [(i, [float(v) for v in e], i % 2 if i > 100 else 1) for i, e in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [1.0, None] * 12, 1), (903, [float("nan")] * 24, 1), (904, [1.0] * 24, None), (905, [], 1), (906, [1.0, 2.0], 1), (0, rows[0][1], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    monkeypatch.setattr(embeddings, "TILE", 32)
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    got = embeddings.near_duplicates(d).collect()
    ok = {k: np.array(e, float) for k, (i, e, l) in enumerate(rows) if l is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    links = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98:
                    links.append((a, b))
    comp = roots(range(len(rows)), links)
    least = {k: min(rows[j][0] for j in comp if comp[j] == comp[k]) for k in comp}
    deg = Counter(k for l in links for k in l)
    assert Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == Counter(
        (rows[k][0], deg[k], least[k], rows[k][0] == least[k]) for k in range(len(rows))
    )
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def junk(n):
    return " ".join(w + "%%%" for w in sentence(n).split())


def test_quality(spark):
    rows = [(i, "\n".join((sentence if i % 4 else junk)(rng.randrange(5, 30)) + "." for _ in range(rng.randrange(1, 6)))) for i in range(400)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "a b c")], "doc_id long, text string").withColumn("quality_score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(7, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(d, labels)
    got = {r.doc_id: r.quality_score for r in quality.scored(d, field).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 4 > 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[1000] == got[1001] == field.blank
    assert quality.scored(d, quality.train(d, labels.limit(0))).agg(F.min("quality_score"), F.max("quality_score")).first()[:] == (0.5, 0.5)
    assert quality.good_only(d, labels).columns == d.columns


def test_good_only_sends_texts_once(spark, monkeypatch):
    rows = [(i, None if i == 4 else sentence(40) if i % 2 else junk(40), "en", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality_score long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    monkeypatch.setattr(quality, "train", lambda *_: field)
    kept = quality.good_only(docs, labels)
    want = {r.doc_id for r in quality.scored(docs.select("doc_id", "text"), field).collect() if r.quality_score >= quality.THRESHOLD}
    assert kept.columns == docs.columns and {(r.doc_id, r.text, r.quality_score) for r in kept.collect()} == {(i, t, n) for i, t, _, n in rows if i in want}
    assert 0 < len(want) < 60
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"text#", re.search(r"\n.*Project.*", plan).group())) == 1, plan


def test_field_marginals():
    f = quality.Field()
    f.trans = np.array([[0.3, -0.7], [0.2, 1.1]])
    u = np.array([0.5, -1.0, 2.0, 0.1])
    p, counts = f.chains(np.array([3, 1]), u)
    z, m, c = 0.0, np.zeros(3), np.zeros((2, 2))
    for y in np.ndindex(2, 2, 2):
        s = math.exp(sum((1 if v else -1) * x / 2 for v, x in zip(y, u)) + f.trans[y[0], y[1]] + f.trans[y[1], y[2]])
        z += s
        m += s * np.array(y)
        c[y[0], y[1]] += s
        c[y[1], y[2]] += s
    assert np.allclose(p[:3], m / z) and np.allclose(counts, c / z) and np.isclose(p[3], 1 / (1 + math.exp(-0.1)))


def naive_tree(rows, depth):
    """(held-out marks, base, score) per text, by the tree's definition, in plain dictionaries."""
    train = [lm.tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    base = lambda x: math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    alphabet = {x for x in c if c[x] >= lm.LEAST_SYMBOL}
    rare = math.log10(1 - sum(10 ** base(x) for x in alphabet))
    symbol = lambda x: x if x in alphabet else "RARE"
    q0 = lambda x: rare if x == "RARE" else base(x)
    seqs = [["START", *map(symbol, t)] for t in train]
    count, times = defaultdict(Counter), Counter()
    for s in seqs:
        for j in range(1, len(s)):
            for d in range(1, min(depth, j) + 1):
                count[tuple(s[j - d : j])][s[j]] += 1
                times[tuple(s[j - d : j])] += 1
    kept = {}

    def logp(ctx, x):
        while ctx and ctx not in kept:
            ctx = ctx[1:]
        if not ctx:
            return q0(x)
        stored, left = kept[ctx]
        return stored[x] if x in stored else logp(ctx[1:], x) + left

    able = lambda s: len(s) == 1 or times[s[:-1]] >= 16 and count[s[:-1]][s[-1]] >= 3 and able(s[:-1])
    for ctx in sorted(times, key=len):
        t = times[ctx]
        nexts = {x: k for x, k in count[ctx].items() if k >= 3}
        if t < 16 or not nexts or not able(ctx):
            continue
        q = {x: 10 ** logp(ctx[1:], x) for x in nexts}
        rest_c, rest_q = t - sum(nexts.values()), max(1 - sum(q.values()), 1e-12)
        gain = sum(k * math.log(k / t / q[x]) for x, k in nexts.items()) + (rest_c * math.log(rest_c / t / rest_q) if rest_c else 0)
        if gain > 0.5 * math.log(t) * len(nexts):
            p = {x: (k + 8 * q[x]) / (t + 8) for x, k in nexts.items()}
            kept[ctx] = {x: math.log10(y) for x, y in p.items()}, math.log10(max(1 - sum(p.values()), 1e-12) / rest_q)
    out = []
    for _, t in rows:
        w, total = lm.tokens(t), 0.0
        s = ["START", *map(symbol, w)]
        for j in range(1, len(s)):
            total += logp(tuple(s[max(0, j - depth) : j]), s[j]) + (base(w[j - 1]) - rare if s[j] == "RARE" else 0)
        out.append((sum(map(base, w)), total))
    for ctx in kept:  # each retained context is a distribution over the symbols
        assert math.isclose(sum(10 ** logp(ctx, x) for x in [*alphabet, "RARE"]), 1, rel_tol=1e-6), ctx
    return out, n, c, kept


def test_lm(spark, docs, monkeypatch):
    phrases = ["the red fox runs", "a blue fox sits", "the old dog sleeps", "the red dog runs off"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(12)) + " " + sentence(3)) for i in range(300)]
    rows += [(500, None), (501, "neverseen words Here"), (501, "neverseen words Here"), (None, "the red fox"), (502, "the red fox runs " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "a.b": F.lit(1), "Score": F.lit(2)})
    monkeypatch.setattr(lm, "HOT", 5)
    want, n, c, kept = naive_tree(rows, 3)
    assert {len(k) for k in kept} == {1, 2, 3}
    for parts in (7, 1):
        got = lm.score(d.repartition(parts)).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter(
            (i, len(t), sum(c[x] > 0 for x in t), n) for i, t in ((i, lm.tokens(t)) for i, t in rows)
        )
        mine = sorted((r.doc_id or -1, r.base_score, r.score) for r in got)
        assert np.allclose(np.array(mine)[:, 1:], np.array([x[1] for x in sorted(zip([i or -1 for i, _ in rows], want))]), rtol=1e-7)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    assert lm.score(docs).count() == len(DOCS) and lm.score(docs.limit(0)).count() == 0
    nothing = lm.score(d, held_out=F.lit(True)).agg(F.min("n_known"), F.max("n_known"), F.max(F.abs(F.col("score") - F.col("base_score")))).first()
    assert nothing[0] == nothing[1] == 0 and nothing[2] < 1e-6


def test_lm_symbols_stay_out_of_the_driver(spark, monkeypatch):
    """The dictionary is a dict in the workers only, and tables of symbols are no broadcast relations."""
    words = pa.array([b"the", b"", b"fox"], pa.binary())
    assert pickle.loads(pickle.dumps(lm.Dictionary(words))) == {b"the": 0, b"": 1, b"fox": 2}
    rows = [(i, f"the red fox runs {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def refused(*_, **__):
        raise AssertionError("a table made in the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    want, n, _, _ = naive_tree(rows, 3)
    assert np.allclose([got[i].score for i, _ in rows], [x[1] for x in want], rtol=1e-7)
    assert {(r.n_tokens, r.train_tokens) for r in got.values()} == {(6, n)}


def test_lm_exchange_of_nexts(spark, monkeypatch):
    """Contexts go once for all their nexts: counting a level sends few bytes a row; counts are those of brute force,
    heavy contexts dealt by next and tallies in pieces included."""
    gen = np.random.default_rng(3)
    words = gen.zipf(1.3, (300, 200)) % 400
    train = spark.createDataFrame([(w.astype(np.int32).tobytes(),) for w in words], "ids binary").repartition(3)
    want = [Counter(), Counter()]
    for w in words:
        s = [401, *map(int, w)]
        for k in (1, 2):
            want[k - 1].update((tuple(s[j - k : j]), s[j]) for j in range(k, len(s)))
    monkeypatch.setattr(lm, "_CHUNK", 1000)
    for raw in (5000, 10**6):
        monkeypatch.setattr(lm, "_RAW", raw)
        got = lm._follows(train, 401, 400, 1, np.array([1, 2], np.uint64)).collect()
        assert {((r.ctx,), r.x): r.c for r in got} == {k: n for k, n in want[0].items() if n >= 3} and len(got) > 1000

    class All(lm.Bloom):
        def __init__(self):
            pass

        def may_hold(self, keys):
            return np.ones(len(keys), bool)

    def h(ctx):
        out = np.zeros(1, np.uint64)
        for x in ctx:
            out = lm.extend(out, np.array([x]))
        return int(out.view(np.int64)[0])

    heavy = np.array([h((1, 1))], np.int64).view(np.uint64)
    got = lm._follows(train, 401, 400, 2, heavy, All(), All()).collect()
    assert {(r.ctx, r.x): r.c for r in got} == {(h(k), x): n for (k, x), n in want[1].items() if n >= 3} and len(got) > 1000
    ctx, x, c = lm._tally(np.repeat(gen.integers(0, 1 << 63, 2000, dtype=np.uint64), 50), gen.integers(0, 1 << 20, 100_000))
    sent = lm._blobs(ctx, x, c, 64, np.empty(0, np.uint64))
    assert sum(len(pa.compress(b.as_py(), "lz4", asbytes=True)) for n in ("ctx", "many", "x", "c") for b in sent.column(n)) < 5 * len(ctx)
    assert {p.as_py() for p in sent.column("part")} == set(range(64))


def test_lm_texts_and_levels_are_read_once(spark, docs, monkeypatch):
    """No Python object a token: Arrow splits as tokens() does and looks symbols up, a dict those beyond FIRST; a level of
    the tree reads its nexts once; filters and places of hashes hold what brute force does."""
    odd = ["", " ", None, " a  B\t", "\x0b\x0ca\x1cb\x85 c\xa0d\r\n", "A\x00B É ß ü\u2003x", "x" * 5000, "end "]
    assert lm.split(pa.array(odd)[1:]).to_pylist() == [lm.tokens(t) for t in odd[1:]]
    assert lm.split(pa.array(odd, pa.large_string())).to_pylist() == [lm.tokens(t) for t in odd]

    nexts = spark.range(3000).select(*(F.xxhash64("id", F.lit(n)).alias(n) for n in ("g", "gs")), (F.col("id") % 50).alias("ctx"), F.lit(900).cast("long").alias("t"), (F.col("id") % 9 + 3).alias("c"), (-F.col("id") % 4 - 1.0).alias("q"))
    plan = lm.grow(nexts)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Range \(", plan)) == 1 and "Join" not in plan, plan
    assert {n: lm.grow(nexts).where(f"{n} is not null").count() for n in ("left", "lp")} == {"left": 3000, "lp": 3000}

    gen = np.random.default_rng(5)
    keys, others = (gen.integers(0, 1 << 64, 50_000, dtype=np.uint64) for _ in range(2))
    bloom = lm.Bloom(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)[:5000]], "g long").repartition(3), "g")
    assert bloom.may_hold(keys[:5000]).all() and bloom.may_hold(others).mean() < 0.001
    for some in (np.sort(keys), np.sort(keys[:3]), keys[:0]):
        held = lm.Sorted(some)
        assert (some[held.find(some)] == some).all() and not (held.keys[held.find(others)] == others).any()

    rows = [(i, f"the red fox runs {i % 7} times {i}") for i in range(80)] + [(99, None)]
    want, _, _, _ = naive_tree(rows, 3)
    for first in (0, 3, 1 << 16):
        monkeypatch.setattr(lm, "FIRST", first)
        got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert np.allclose([(got[i].base_score, got[i].score) for i, _ in rows], want, rtol=1e-7)


def test_lm_keeps_ties(spark):
    """However many strings have one count, all of them are in the tree."""
    rows = [(i, " ".join(f"a{k} b{k}" for k in range(300))) for i in range(40)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got.score > -0.2 * got.n_tokens and got.base_score < -2 * got.n_tokens


def test_language(spark):
    def text(k):
        return " ".join("".join(rng.choice(["sch", "ung", "ein", "ät"] if k else ["the", "ing", "wh", "ou"]) for _ in range(3)) for _ in range(25))

    rows = [(i, text(i % 2), ["en", "de"][i % 2]) for i in range(200)] + [(900, None, "en"), (901, "123 %%", "en"), (902, "schungein ätung", None), (None, "x", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    got = {r.doc_id: r for r in language.identified(d, language.train(d)).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:200]) and got[902].lang_pred == "de"
    assert (got[900].lang_pred, got[901].lang_pred, got[900].lang_score) == ("und", "und", 0)
    assert {r.lang_pred for r in language.identified(d, language.train(d.limit(0))).collect()} == {"und"}
    model = language.train(d)
    assert language.identified(d.limit(0), model).count() == 0
    long_ones = [" ".join(text(k) for _ in range(800)) for k in (0, 1)]  # 20,000 words
    assert model.predict([*long_ones, "½ ² 12", None, ""])[0] == ["en", "de", "und", "und", "und"]
    twice = language.identified(d.union(d).withColumn("a.b", F.lit(1)), model).groupBy("doc_id", "lang_pred", "lang_score").count()
    assert twice.where("count % 2 = 1").count() == 0


def test_language_brute_force():
    """The weights of n-grams give what kernels with every landmark give."""
    def spectrum(t):
        t = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
        return {t[i : i + n] for n in language.SPECTRUM for i in range(len(t) - n + 1)}

    texts = [sentence(rng.randrange(3, 40)) for _ in range(40)]
    langs = [rng.choice("abc") for _ in texts]
    marks = language.Landmarks([language.grams(t) for t in texts[:12]])
    k = lambda x, y: len(spectrum(x) & spectrum(y)) / math.sqrt(len(spectrum(x)) * len(spectrum(y)))
    full = np.array([[k(x, y) for y in texts[:12]] for x in texts])
    mine = np.stack([marks.kernel(language.grams(t)) for t in texts])
    assert np.allclose(full, mine)
    model = language.Model.fit(marks, mine[:12], mine, langs)
    value, vector = np.linalg.eigh(full[:12])
    z = full @ vector / np.sqrt(value)
    y = np.array([[1.0 if x == c else -1.0 for c in "abc"] for x in langs])
    zc = z - z.mean(0)
    w = np.linalg.solve(zc.T @ zc + language.RIDGE * 40 * np.eye(12), zc.T @ (y - y.mean(0)))
    margin = language.SHARPNESS * (zc @ w + y.mean(0))
    share = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
    names, scores = model.predict(texts)
    assert names == ["abc"[i] for i in share.argmax(1)] and np.allclose(scores, share.max(1))


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>OK?</div>"
    "<article><h1>Head &amp; line</h1><script>var a='</p>';</script><p>One <b>two</b>\n three&nbsp;four<br>five<p>Six &lt;7&gt;</p><div class='share-bar'>x</div>"
    "<form>f</form><ul><li>a<li>b</ul><section id='comments'><p>me too</p></section></article><aside>side</aside><footer>foot</footer>"
)


def test_html_blocks():
    assert html.blocks(PAGE) == (["Head & line", "One two three four five", "Six <7>", "a", "b"], [True] * 5)
    assert html.blocks(None) == html.blocks("") == ([], [])
    inside = lambda body: [t for t, g in zip(*html.blocks(f"<article>{body}</article>")) if g]
    assert inside('<h2 id="search-results">Search</h2><p>x</p>') == ["Search", "x"]
    assert inside('<div class="article-header"><h1>Title</h1></div><p>y') == ["Title", "y"]
    assert inside('<p class="notice-period">n</p><p id="related">r</p>') == ["n", "r"]
    assert inside('<div class="wide ad">buy</div><p>z</p><div class="ad-hoc">w</div>') == ["z", "w"]
    # an article's own parts may be named as the page's furniture is; readers' comments aren't its text
    assert inside('<div class="header"><h1>Title</h1></div><section id="navigation">how to steer</section><div class="notice">mind</div>') == ["Title", "how to steer", "mind"]
    assert inside('<p>x</p><div class="reader-comments"><p>me too</p></div><ul id="comments"><li>y</ul><p>z</p>') == ["x", "z"]
    assert html.blocks("<div class='notice'>n</div><div class='user-comments'>c</div><p class='commentary'>p</p>") == (["p"], [False])
    page = "<article>Only four words here</article><div class='user-comments'>" + "me too " * 20 + "</div><div>" + "other text " * 20 + "</div>"
    assert html.main_text(*html.blocks(page), []) == ["Only four words here"]
    assert html.blocks("<main>m<article> </article></main><div>o</div>") == (["m", "o"], [True, False])


def naive_extract(rows):
    """Texts by brute force: every run of RUN tokens of a host's unguarded stretches, and the pages that have it."""
    runs, parsed = defaultdict(set), []
    for k, (_, url, page) in enumerate(rows):
        host = (re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "") or [0, ""])[1].lower()
        b, g = html.blocks(page)
        parsed.append((host, b, g, html.stretches(b, g)))
        for s in parsed[-1][3]:
            for i in range(len(s) - html.RUN + 1):
                runs[host, *s[i : i + html.RUN]].add(k)
    out = []
    for host, b, g, streams in parsed:
        gone = []
        for s in streams:
            hit = [False] * len(s)
            for i in range(len(s) - html.RUN + 1):
                if len(runs[host, *s[i : i + html.RUN]]) >= html.PAGES:
                    hit[i : i + html.RUN] = [True] * html.RUN
            gone += hit
        left, at = [], 0
        for t, guard in zip(b, g):
            w = t.split(" ")
            if not guard:
                t, at = " ".join(x for x, h in zip(w, gone[at:]) if not h), at + len(w)
            left.append((t, guard))
        out.append("\n".join(t for t, x in left if t and (x or not any(g))))
    return out


def test_html(spark):
    boiler = "welcome to our lovely site please enjoy all the many pages here"
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "x", ""), (1, "http://a.b/1", PAGE)]
    rows += [(10 + i, "http://h.c/%d" % i, f"<div>{boiler}</div><div>{i} unique {sentence(12)}</div>") for i in range(4)]
    rows += [(20, "http://h.c/t", f"<article>A teaser</article><div>{boiler}</div><p>{sentence(30)}</p>")]
    rows += [(21, "http://h.c/u", f"<article>{boiler} and more</article><div>{boiler}</div>"), (22, "http://h.c/v", "<p>" + sentence(20000))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "a.b": F.lit(1)})
    got = html.extract(d).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((i, t) for (i, *_), t in zip(rows, naive_extract(rows)))
    assert all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[2] == text[3] == "" and text[1].split("\n")[-1] == "b" and text[21] == f"{boiler} and more"
    assert all("welcome" not in text[10 + i] and text[10 + i].startswith(f"{i} unique") for i in range(4))
    assert text[20] == "A teaser"  # an article is the text however short it is
    assert html.extract(d.limit(0)).count() == 0


def test_html_hot_host(spark):
    """Most pages on one host, read in many parts, give what brute force gives; long shared substrings go in whole."""
    shared = [" ".join(f"s{k}x{i}" for i in range(10 + 20 * k)) for k in range(6)]
    rows = []
    for i in range(60):
        body = [sentence(12), *[s for k, s in enumerate(shared) if i % 8 == k or i % 11 == k], sentence(9), shared[3][: 40 + i]]
        rows.append((i, "http://hot.org/%d" % i if i % 7 else "http://cold.org/%d" % i, "".join(f"<div>{x}</div>" for x in body)))
    d = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").repartition(9)
    got = Counter((r.page_id, r.text) for r in html.extract(d).collect())
    want = naive_extract([*rows, rows[0]])
    assert got == Counter((i, t) for (i, *_), t in zip([*rows, rows[0]], want))
    assert not any(shared[0] in t for (i, u, _), t in zip(rows, want) if "hot" in u)


def test_line_dedup(spark):
    passage = [sentence(n) for n in (14, 9, 20, 3, 18)]
    single = sentence(60)
    own = [[sentence(rng.randrange(4, 30)) for _ in range(rng.randrange(2, 9))] for _ in range(30)]
    rows = []
    for i, lines in enumerate(own):
        body = [*lines]
        if i % 3 == 0:
            body[1:1] = passage
        if i % 5 == 0:
            body.append(single)
        if i % 2:
            body.insert(0, "Short licence line")
        rows.append((i, "\n".join(body)))
    rows += [(50, None), (51, ""), (52, rows[1][1]), (52, rows[1][1]), (None, "a\nb")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Lines", F.lit(0))
    got = {r.doc_id: r for r in linededup.dedup_lines(d).collect()}
    assert got[50].text is None and got[51].text == "" and got[None].text == "a\nb" and got[0].text == rows[0][1]
    assert linededup.dedup_lines(d).count() == len(rows)
    for i, lines in enumerate(own[1:], 1):
        left = got[i].text.split("\n")
        assert [x for x in left if x not in ("Short licence line",)] == lines, i
        assert got[i].n_lines - got[i].n_removed == len(left)
    assert got[52].n_removed > 0  # a copy of document 1; a short line that is a chunk by itself stays
    assert linededup.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_short_lines(spark):
    rare = iter(range(10**6))
    fresh = lambda n: " ".join(f"w{next(rare)}" for _ in range(n))
    triples, doubled, single = [fresh(3) for _ in range(30)], [x for _ in range(12) for x in (fresh(6), "")], [fresh(1) for _ in range(70)]
    spaced = [x for _ in range(3) for x in (fresh(20), *[""] * 40)]
    rows = [(i, "\n".join([fresh(30), *passage, fresh(30)])) for passage in (triples, doubled, single, spaced) for i in (next(rare), next(rare), next(rare))]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, text) in enumerate(rows):
        lines = text.split("\n")
        assert got[i].text.split("\n") == (lines if k % 3 == 0 else [lines[0], lines[-1]]), k


def test_line_dedup_runs(spark):
    sizes = [[rng.choice((0, 0, 1, 2, 3, 7, 60)) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    rows = [(i, list(range(len(w))), w) for i, w in enumerate(sizes)]
    d = spark.createDataFrame(rows, "id long, h array<long>, w array<int>").withColumn("doc", F.struct("id")).withColumn("first", F.lit(7))
    got = {(r.doc.id, r.start - 7, r.n_lines) for r in linededup._units(d).collect()}
    for i, w in enumerate(sizes):
        for a in range(len(w)):
            ahead = next((b for b in range(a + 1, len(w) + 1) if sum(w[a:b]) > linededup.LONG), None)
            back = next((b for b in range(a, -1, -1) if sum(w[b : a + 1]) > linededup.LONG), None)
            assert ahead is None or (i, a, ahead - a) in got
            assert back is None or (i, back, a + 1 - back) in got


def test_line_dedup_brute_force(spark):
    """Every run of lines of over LONG words that another document has too goes, but for the first document's."""
    pool = [sentence(rng.choice((1, 3, 8, 20, 70))) for _ in range(30)] + [""] * 4
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.9 else sentence(5) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [(100 + k, "\n".join([sentence(4), *rows[k][1].split("\n")[3:30], sentence(4)])) for k in range(12)]
    rows += [(200, "\n".join(f"w{k}" for k in range(4000))), (201, "\n".join(f"w{k}" for k in range(1000, 5000)))]
    texts = dict(rows)
    first = {}
    for i, t in sorted(texts.items()):
        lines = t.split("\n")
        for a in range(len(lines)):
            n, b = 0, a
            while b < len(lines) and n <= 50:
                n, b = n + len(lines[b].split()), b + 1
            if n > 50:
                first.setdefault(tuple(lines[a:b]), i)
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, t in texts.items():
        lines = t.split("\n")
        gone = set()
        for run, lo in first.items():
            if lo < i:
                gone |= {k for a in range(len(lines) - len(run) + 1) if lines[a : a + len(run)] == [*run] for k in range(a, a + len(run))} if run[0] in lines else set()
        left = got[i].text.split("\n") if got[i].text else []
        assert got[i].n_lines == len(lines) and got[i].n_removed >= len(gone)
        want = iter([x for k, x in enumerate(lines) if k not in gone])
        assert got[i].n_removed == len(lines) or all(any(x == y for y in want) for x in left), i
    assert got[201].text.split("\n") == [f"w{k}" for k in range(4000, 5000)]


def test_line_dedup_collision(spark, monkeypatch):
    """Unlike lines of one hash stay: here every line of over 60 words has the same hash."""
    texts = [(1, "x " * 70), (2, "y " * 70), (3, "z " * 70)]
    d = spark.createDataFrame([(i, t.strip()) for i, t in texts], "doc_id long, text string")
    monkeypatch.setattr(linededup, "line_hash", lambda line: F.length(line).cast("long"))
    got = linededup.dedup_lines(d).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, t.strip()) for i, t in texts]
