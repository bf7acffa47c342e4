"""The queries op1 to op10 and the pipeline's stages on small tables, against brute force; SQL where there is some."""

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from test_llm import naive_fingerprint, naive_tree, roots

from quarry.llm import decontaminate, quality, queries
from quarry.session import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The tables of sf0.001 with nulls, repeats, ties, empty and very long texts added, and columns that clash."""
    rng, to = random.Random(11), tmp_path_factory.mktemp("tables")
    for f in Path(SF).glob("*.parquet"):
        shutil.copyfile(f, to / f.name)
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    item = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[3]["text"]
    long_ = " ".join(rng.choice(docs)["text"] for _ in range(60))
    extra = [None, "", " \t ", "½ ²", "one", long_, docs[5]["text"], docs[5]["text"], docs[5]["text"].upper(), item, f"x y {item}"]
    docs += [{"doc_id": 5000 + k, "text": t, "lang": None, "source": None if k % 2 else "é", "n_chars": 0} for k, t in enumerate(extra)]
    docs += [docs[7]] * 40 + [docs[9] | {"doc_id": None}]
    made = pa.Table.from_pylist([d | {"size": "?", "Rid": 1, "shard": None, "a.b": 2} for d in docs])
    pq.write_table(made.set_column(made.schema.get_field_index("shard"), "shard", pa.nulls(len(docs), pa.int32())), to / "documents.parquet")
    return str(to)


@pytest.fixture(scope="module")
def docs(folder):
    return [(d["doc_id"], d["text"], d["source"]) for d in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, folder, name):
    for sf in (SF, folder):
        assert compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_op1(spark, folder, docs):
    got = queries.op1_simhash(spark, folder).collect()
    fps = {t: naive_fingerprint(t) for _, t, _ in docs}
    distinct = sorted(set(fps.values()))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2]
    root = roots(distinct, links)
    least = defaultdict(lambda: math.inf)
    for i, t, _ in docs:
        if i is not None:
            least[root[fps[t]]] = min(least[root[fps[t]]], i)
    want = Counter((i, f"{fps[t]:016x}", least[root[fps[t]]]) for i, t, _ in docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_op2(spark, folder, docs):
    """Nothing that is removed is unique, and no run of over 50 words is left in two documents."""
    got = queries.op2_line_dedup(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in docs)
    texts = defaultdict(set)
    for i, t, _ in docs:
        for line in (t or "").split("\n"):
            texts[line].add((i, t))
    by = {(i, t): None for i, t, _ in docs}
    whole = defaultdict(list)
    for i, t, _ in docs:
        whole[i].append(t)
    for r in got:
        t = whole[r.doc_id][0]
        if len(set(whole[r.doc_id])) == 1 and t is not None:
            gone = Counter(t.split("\n")) - Counter(r.text.split("\n") if r.text else [])
            assert all(len(texts[x]) > 1 for x in gone) and r.n_lines == len(t.split("\n"))
    left, seen = {(r.doc_id, r.text) for r in got if r.text}, {}
    assert by
    for i, t in sorted(left, key=str):
        lines = t.split("\n")
        for k, x in enumerate(lines):
            if len(x.split()) > 50:
                assert seen.setdefault(x, i) == i


def test_op4(spark, folder, docs):
    got = queries.op4_shard(spark, folder).collect()
    rows = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, _ in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == rows
    slots, held = defaultdict(list), Counter({k: 0 for k in range(40)})
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) == set(range(40))
    sizes = sorted((n for _, n, _ in rows), reverse=True)
    mean = sum(held.values()) / 40
    assert all(abs(x - mean) <= sizes[0] for x in held.values())


def test_op7(spark, folder, docs):
    got = queries.op7_quality(spark, folder).collect()
    field = quality.train(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    want = Counter((i, crc(i) is not None and crc(i) % 5 == 0, round(float(field.score([t])[0]), 9)) for i, t, _ in docs)
    assert Counter((r.doc_id, r.held_out, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_op8(spark, folder, docs):
    got = queries.op8_lm(spark, folder).collect()
    want, n, c, _ = naive_tree([(i, t) for i, t, _ in docs], 3)
    key = lambda i: -1 if i is None else i
    mine = sorted((key(r.doc_id), r.held_out, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    full = sorted((key(i), crc(i) is not None and crc(i) % 10 == 0, n, round(b, 5), round(s, 5)) for (i, *_), (b, s) in zip(docs, want))
    assert all(x[:3] == y[:3] and np.allclose(x[3:], y[3:], rtol=1e-6, atol=1e-4) for x, y in zip(mine, full)) and len(mine) == len(full)


def test_op9(spark, folder, docs):
    got = queries.op9_language(spark, folder).collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in {"und", *lang.values()}
    assert {r.lang_pred for r in got if r.doc_id in (5000, 5001, 5002, 5003)} == {"und"}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9


def naive_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, goal = set(), {}
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        goal = {s: 3 * size[s] if s in full else left * w[s] / sum(w[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and goal[s] > 3 * size[s]}
        if not over:
            return goal
        full |= over


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_op10(spark, folder, docs):
    got = queries.op10_mix(spark, folder).collect()
    source = {i: s for i, _, s in docs}
    size = Counter()
    for _, t, s in docs:
        size[s] += n_words(t)
    goal, taken = naive_targets(size), Counter()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n_words(t)) for i, t, _ in docs)
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else next(x for i, _, x in docs if i is None)
        assert r.source_size == size[s] and math.isclose(r.target, goal[s], rel_tol=1e-9) and 0 <= r.taken <= 3 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        taken[s] += r.taken
    longest = max(n_words(t) for _, t, _ in docs)
    assert all(abs(taken[s] - goal[s]) <= max(0.03 * goal[s], 200) or size[s] < 5 * longest for s in goal), (taken, goal)
    again = Counter((r.doc_id, r.taken) for r in queries.op10_mix(spark, folder).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)


def test_pipeline(spark, folder, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline as p

    plain = table(spark, folder, "documents").select(*COLUMNS)
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    seen, states = plain, [rows(plain)]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, seen, folder).write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        assert seen.columns[: len(COLUMNS)] == COLUMNS and (k == 4 or seen.columns == COLUMNS)
        states.append(rows(seen))
    docs, good, once, clean, mixed, sharded = states
    assert p.ORACLE_SQL is None

    field = quality.train(plain, table(spark, folder, "labels"))
    assert Counter(good) == Counter(d for d in docs if field.score([d[1]])[0] >= quality.THRESHOLD)

    fps = {t: naive_fingerprint(t) for _, t, _ in good}
    distinct = sorted(set(fps.values()))
    root = roots(distinct, [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2])
    groups = defaultdict(list)
    for d in good:
        groups[root[fps[d[1]]]].append(d)
    assert Counter(root[fps[t]] for _, t, _ in once) == Counter(groups.keys())
    for i, t, _ in once:
        ids = [x for x, *_ in groups[root[fps[t]]] if x is not None]
        assert i == (min(ids) if ids else None)

    items = [decontaminate.words(r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    runs = defaultdict(set)
    for w in items:
        for k in range(max(1, len(w) - 12) if w else 0):
            runs[len(w[k : k + 13])].add(tuple(w[k : k + 13]))
    def dirty(t):
        w, hit = decontaminate.words(t), set()
        for n, held in runs.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit |= set(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)
    assert Counter(clean) == Counter(d for d in once if not dirty(d[1]))

    size, taken = Counter(), Counter()
    for _, t, s in clean:
        size[s] += n_words(t)
    for _, t, s in mixed:
        taken[s] += n_words(t)
    before, after = Counter(clean), Counter(mixed)
    assert set(after) <= set(before) and all(after[d] <= 3 * before[d] for d in after)
    longest = max(n_words(t) for _, t, _ in clean)
    assert all(abs(taken[s] - g) <= max(0.03 * g, 200) or size[s] < 5 * longest for s, g in naive_targets(size).items())

    assert Counter(sharded) == Counter(mixed)
    held, slots = Counter({k: 0 for k in range(40)}), defaultdict(list)
    for r in seen.collect():
        assert r["size"] == len((r.text or "").encode()) + 16
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    biggest = max(len((t or "").encode()) + 16 for _, t, _ in mixed)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(x - sum(held.values()) / 40) <= biggest for x in held.values())


def test_pipeline_memory(spark, folder, tmp_path, monkeypatch):
    """Whole texts reach Python workers 500 rows at a time, whatever the session sends, and no list starts workers of its own."""
    import corpus_pipeline as p

    docs = pa.concat_tables([pq.read_table(f"{folder}/documents.parquet")] * 8)
    pq.write_table(docs, tmp_path / "documents.parquet")
    sent = type(spark.range(0)).mapInArrow

    def watched(df, run, *a, **b):
        def small(batches):
            def each():
                for x in batches:
                    assert x.num_rows <= 500, x.num_rows
                    yield x
            return run(each())
        return sent(df, small, *a, **b)

    def refused(*_, **__):
        raise AssertionError("a list made into an RDD")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert int(before) > 500 and docs.num_rows > 2 * 500
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    for k, (name, stage) in enumerate(p.STAGES):
        if name == "sharding":
            monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
        stage(spark, seen, folder).write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k))) if name == "sharding" else seen
    assert seen.count() == docs.num_rows and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for f in Path(SF).glob("*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), tmp_path / f.name)
    assert p.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_empty_items_hash(spark, folder):
    got = {r.items_sha256 for r in queries.op3_decontaminate(spark, folder).where("n_items = 0").collect()}
    assert got == {hashlib.sha256(b"").hexdigest()}
