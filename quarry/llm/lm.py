"""LM scoring: a probabilistic suffix tree over word tokens above an exact unigram base.

Symbols are the frequent tokens, one class for all others, and a start mark. Every string of up to DEPTH symbols that occurs
LEAST_CONTEXT times is a candidate context, and every symbol that follows it LEAST_NEXT times a stored next; the divergence
test alone decides which contexts stay. Counts, test and probabilities are DataFrame aggregates and joins, so the tree has
as many nodes as the training text supports and is never collected or sent out whole.

The log probability of a text is a sum over the strings in it: a stored next adds its gain over the shorter context's
prediction, a retained context adds, for the symbol after it, the share that stored nexts leave to the shorter one. So
scoring is one exchange: tasks send the strings of their texts, less those that a Bloom filter knows not to be in the tree,
to where these values are, and the sums come back by slices of texts. Tokens of the class are told apart by a join with the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY, materialize, release, schema_of, slices, sweep
from quarry.llm.quality import remainder

#: Symbols of a context at most.
DEPTH = 3
#: Tokens that are symbols of their own: those with this count, and of these the most frequent 2 ** 20, which bounds the
#: dictionary that is sent out. All others are one class.
LEAST_SYMBOL, ALPHABET = 16, 1 << 20
#: A context or a stored next occurs this often at least.
LEAST_CONTEXT, LEAST_NEXT = 16, 3
#: Weight of the shorter context's distribution, in counts.
SMOOTH = 8.0
#: Added to every count of the base.
ADD = 0.1
#: Most frequent symbols that Arrow looks up, which builds its table anew for each slice of texts; a dict has the others.
FIRST = 1 << 16
#: Words of 64 bits of a Bloom filter. A small filter lets more strings through, which costs exchange and changes nothing.
BLOOM = 1 << 20
#: The most frequent strings of the tree, whose values are sent out, so many at most; the others' stay where they are and
#: are asked for.
HOT = 1 << 18
#: Parts by which strings and values meet, at least; as many as there are shuffle partitions, where that is more.
PARTS = 64

#: Tokens that a task holds before it hands on their counts, and symbols that it takes at once.
_HELD, _CHUNK = 4_000_000, 1 << 18
#: Places that a task tallies at once: more of them meet their likes before the exchange, at 24 bytes each and a sort's room.
_RAW = 2_000_000
_SHIFT = 21  # bits of a symbol
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then one end token, which is empty: the definition, which split() follows for whole arrays."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(b"")
    return out


def split(texts: pa.Array) -> pa.ListArray:
    """tokens() of each text, by Arrow."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    t = pc.if_else(pc.equal(t, ""), t, pc.binary_join_element_wise(t, "", " "))  # what follows the last space is the end
    return pc.ascii_split_whitespace(t).cast(pa.list_(pa.binary()))


def unigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all rows of docs."""

    def batch(held: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            held.append(split(b.column(0)).flatten())
            size += len(held[-1])
            if size > _HELD:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    return docs.select(text).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def extend(strings: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of strings, each with one more symbol at its end."""
    h = (strings * _MULT[0]) ^ ((symbols.astype(np.uint64) + np.uint64(1)) * _MULT[1])
    return (h ^ (h >> np.uint64(29))) * _MULT[2]


def chunks(texts: list[bytes], start: int, rare: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, place in their text, index of the text), start marks included, about _CHUNK symbols at a time."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        ids = np.frombuffer(t, np.int32).astype(np.int64)
        held.append(np.concatenate([[start], np.where(ids < 0, rare, ids)]))
        size += len(held[-1])
        if size >= _CHUNK or k == len(texts) - 1:
            lens = np.array([len(x) for x in held])
            place = np.arange(size) - np.repeat(np.cumsum(lens) - lens, lens)
            yield np.concatenate(held), place, np.repeat(np.arange(first, k + 1), lens)
            held, size, first = [], 0, k + 1


def strings(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to the longest, hashes of the strings of that length that end at each symbol."""
    out = [extend(np.zeros(len(symbols), np.uint64), symbols)]
    while len(out) < longest:
        out.append(extend(np.roll(out[-1], 1), symbols))  # what wraps round begins before the first text
    return out


class Bloom:
    """Three bits a key, in one word. Built by a distributed aggregation; the driver holds no more than the filter."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        span = BLOOM // PARTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(BLOOM, np.uint64)
            for b in batches:
                np.bitwise_or.at(words, *Bloom._bits(b.column(0).to_numpy().view(np.uint64)))
            at = np.flatnonzero(words)
            cut = np.searchsorted(at, np.arange(PARTS + 1) * span)
            on = [(k, at[i:j]) for k, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
            cols = [pa.array([k for k, _ in on], pa.int32()), *(pa.array(v, pa.binary()) for v in ([(x % span).astype(np.int32).tobytes() for _, x in on], [words[x].tobytes() for _, x in on]))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "at", "bits"])

        def joined(found: pa.Table) -> pa.Table:
            words = np.zeros(span, np.uint64)
            for at, bits in zip(found["at"].to_pylist(), found["bits"].to_pylist()):
                words[np.frombuffer(at, np.int32)] |= np.frombuffer(bits, np.uint64)
            return pa.table({"part": found["part"][:1], "bits": pa.array([words.tobytes()], pa.binary())})

        sent = keys.select(column).mapInArrow(run, "part int, at binary, bits binary")
        found = sent.groupBy("part").applyInArrow(joined, "part int, bits binary").toArrow()
        self.words = np.zeros(BLOOM, np.uint64)
        for k, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
            self.words[k * span : (k + 1) * span] = np.frombuffer(bits, np.uint64)

    @staticmethod
    def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, mask = np.uint64(1), np.uint64(63)
        bits = one << (keys & mask)
        for k in (6, 12):
            bits |= one << ((keys >> np.uint64(k)) & mask)
        return ((keys >> np.uint64(20)) & np.uint64(BLOOM - 1)).astype(np.int64), bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at, bits = self._bits(keys)
        return self.words[at] & bits == bits


class Sorted:
    """Places of hashes among sorted ones: from where those with the same first bits begin, then onwards."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        self.bits = np.uint64(max(1, len(keys).bit_length() + 1))
        self.begin = np.searchsorted(keys, np.arange(1 << int(self.bits), dtype=np.uint64) << (np.uint64(64) - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or some place of another if it isn't there."""
        out = self.begin[(keys >> (np.uint64(64) - self.bits)).astype(np.int64)]
        at = np.flatnonzero(self.keys[out] < keys)
        while len(at):
            out[at] += 1
            at = at[self.keys[out[at]] < keys[at]]
        return out


def _places(words: pa.Array) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(words.to_pylist())}


class Dictionary:
    """Tokens as an Arrow array, which a worker that unpickles it gets as {token: place}: the driver has no object a token."""

    def __init__(self, words: pa.Array) -> None:
        self.words = words

    def __reduce__(self) -> tuple:
        return _places, (self.words,)


def _encode(docs: DataFrame, words: pa.Array, base: np.ndarray) -> DataFrame:
    """(rid, doc_id, held_out, ids, rare, n_tokens, k, b): symbols of all tokens, -1 for those of the class, which rare lists;
    numbers of tokens and of those that are symbols, and the sum of these by base."""
    shared = docs.sparkSession.sparkContext.broadcast((Dictionary(words), base))  # ALPHABET tokens at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base = shared.value
        first = pa.array(islice(places, FIRST), pa.binary())
        for b in slices(batches):
            found = split(b.column("text"))
            flat, at = found.flatten(), found.offsets.to_numpy()  # no text is without its end
            ids = pc.fill_null(pc.index_in(flat, value_set=first), -1).to_numpy().copy()
            if len(places) > len(first):
                more = np.flatnonzero(ids < 0)
                ids[more] = np.fromiter(map(places.get, flat.take(pa.array(more)).to_pylist(), repeat(-1)), np.int32, len(more))
            out = ids < 0
            many = np.add.reduceat(out.astype(np.int64), at[:-1])
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), flat.filter(pa.array(out)))
            own = [pa.array([ids[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()), rare, pa.array(np.diff(at).astype(np.int64))]
            own += [pa.array(np.diff(at) - many), pa.array(np.add.reduceat(np.where(out, 0.0, base[ids]), at[:-1]))]
            cols = [b.column(n) for n in ("rid", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*cols, *own], names=["rid", "doc_id", "held_out", "ids", "rare", "n_tokens", "k", "b"])

    src = docs.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text")
    return src.mapInArrow(run, schema_of(src, "rid,doc_id,held_out", "ids binary, rare array<binary>, n_tokens bigint, k bigint, b double"))


def _tally(ctx: np.ndarray, x: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (ctx, x) in order with their sums of c, or with their numbers."""
    if len(ctx) and int(ctx.max()) >> _SHIFT:
        kinds, code = np.unique(ctx, return_inverse=True)
    else:
        kinds, code = None, ctx.astype(np.int64)
    code = (code << _SHIFT) | x
    if c is None:
        code, c = np.unique(code, return_counts=True)
    else:
        order = np.argsort(code)
        code = code[order]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
        code, c = code[new], np.add.reduceat(c[order].astype(np.int64), new) if len(new) else np.empty(0, np.int64)
    at = code >> _SHIFT
    return at.astype(np.uint64) if kinds is None else kinds[at], code & ((1 << _SHIFT) - 1), c


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of hashes, in the smallest type that holds them, which sorts fastest."""
    return ((keys >> np.uint64(7)) % np.uint64(parts)).astype(np.min_scalar_type(parts))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as their lowest bytes, then the next: what is mostly zeros or ones goes small through an exchange."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _blobs(ctx: np.ndarray, x: np.ndarray, c: np.ndarray, parts: int, heavy: np.ndarray) -> pa.RecordBatch:
    """Tallied rows by the part where they are added up: each context once, how many nexts it has there, these and their counts.

    A context's nexts share a part, but those of ``heavy`` contexts are dealt by next, so that none fills a task.
    """
    key = np.where(np.isin(ctx, heavy), extend(ctx, x), extend(ctx, np.zeros(len(ctx), np.int64)))
    part = _part(key, parts)
    order = np.argsort(part, kind="stable")
    ctx, x, c, part = ctx[order], x[order], c[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (ctx[1:] != ctx[:-1])])[: len(part)])
    many, last = np.diff(np.append(run, len(part))), np.append(first[1:], len(part))
    lo, hi = np.searchsorted(run, first), np.searchsorted(run, last)
    cols = [
        [ctx[run[i:j]].tobytes() for i, j in zip(lo, hi)],
        [_planes(many[i:j]) for i, j in zip(lo, hi)],
        [_planes(x[i:j]) for i, j in zip(first, last)],
        [_planes(c[i:j]) for i, j in zip(first, last)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.array(v, pa.binary()) for v in cols)], names=["part", "ctx", "many", "x", "c"])


def _added(blobs: pa.Table) -> pa.Table:
    """A part's rows whose counts add up to LEAST_NEXT."""
    cols = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for ctx, many, x, c in zip(*(blobs.column(n).to_pylist() for n in ("ctx", "many", "x", "c"))):
        cols.append((np.repeat(np.frombuffer(ctx, np.uint64), _numbers(many)), _numbers(x), _numbers(c)))
    ctx, x, c = _tally(*(np.concatenate([v[k] for v in cols]) for k in range(3)))
    on = c >= LEAST_NEXT
    return pa.table({"ctx": ctx[on].view(np.int64), "x": x[on], "c": c[on]})


def _follows(train: DataFrame, start: int, rare: int, depth: int, heavy: np.ndarray, known: Bloom | None = None, ends: Bloom | None = None) -> DataFrame:
    """(ctx, x, c): how often each symbol follows those strings of ``depth`` symbols that ``known`` lets through, LEAST_NEXT
    times at least. Contexts are given by hash, single symbols (depth 1, without filters) as they are.

    A string that occurs LEAST_NEXT times has an end, the string without its first symbol, that does too and so is stored;
    what ``ends`` doesn't know is therefore not counted. Tasks tally about _RAW symbols at a time and send each context of
    these once for all its nexts, as arrays; rows are made of what is stored.
    """
    parts = max(PARTS, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            for s, place, _ in chunks(b.column(0).to_pylist(), start, rare):
                at = np.flatnonzero(place >= depth)
                if known is None:
                    ctx = s[at - 1].astype(np.uint64)
                else:
                    h = strings(s, depth)[-1]
                    at = at[known.may_hold(h[at - 1])]
                    at = at[ends.may_hold(h[at])]
                    ctx = h[at - 1]
                held.append((ctx, s[at].astype(np.int32)))
                size += len(at)
                if size > _RAW:
                    yield _blobs(*_tally(*map(np.concatenate, zip(*held))), parts, heavy)
                    held, size = [], 0
        if size:
            yield _blobs(*_tally(*map(np.concatenate, zip(*held))), parts, heavy)

    sent = train.mapInArrow(run, "part int, ctx binary, many binary, x binary, c binary")
    return sent.groupBy("part").applyInArrow(_added, "ctx bigint, x bigint, c bigint")


def _heavy(able: DataFrame) -> np.ndarray:
    """Contexts that hold more than one in HEAVY of all places, fewer than HEAVY, in order."""
    total = able.agg(F.sum("t")).first()[0] or 0
    return np.sort(able.where(F.col("t") * HEAVY > total).select("ctx").toArrow()["ctx"].to_numpy()).astype(np.int64).view(np.uint64)


def _begun(pairs: DataFrame, base: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The first level, whose contexts are symbols: grow() over pairs(ctx, x, c), with their counts and the nexts' log10
    probabilities looked up by place where the pairs are, so that no table of symbols goes through the driver's JVM."""
    shared = pairs.sparkSession.sparkContext.broadcast((base, counts))  # ALPHABET and two at most

    def run(found: pa.Table) -> pa.Table:
        base, counts = shared.value
        ctx, x, c = (found.column(n).to_numpy() for n in ("ctx", "x", "c"))
        able = counts[ctx] >= LEAST_CONTEXT
        ctx, x, c = ctx[able], x[able], c[able]
        empty = np.zeros(len(x), np.uint64)
        return _grown(ctx, counts[ctx], c, base[x], *(extend(h, x).view(np.int64) for h in (extend(empty, ctx), empty)))

    return _by_context(pairs).applyInArrow(run, _LEVEL)


def _hashed(nexts: DataFrame) -> DataFrame:
    """nexts with g, the hash of context and next, and gs, that of the same without its first symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").to_numpy()
            made = [pa.array(extend(b.column(n).to_numpy().view(np.uint64), x).view(np.int64)) for n in ("ctx", "suf")]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "g", "gs"])

    return nexts.mapInArrow(run, schema_of(nexts, ",".join(nexts.columns), "g bigint, gs bigint"))


_LEVEL = "ctx bigint, t bigint, c bigint, g bigint, gs bigint, keep boolean, left double, lp double, delta double"


def _by_context(nexts: DataFrame) -> GroupedData:
    """nexts in parts that have a context's nexts together, as many at most as there are symbols."""
    parts = max(PARTS, int(nexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return nexts.withColumn("part", F.pmod(F.xxhash64("ctx"), F.lit(parts))).groupBy("part")


def grow(nexts: DataFrame) -> DataFrame:
    """nexts(ctx, t, c, q, g, gs) with keep, left, lp and delta, and without q: one depth of the tree.

    t counts the context, c a stored next of it, q is the next's log10 probability in the next shorter context. Divergence
    test: a context stays if, over its stored nexts and the rest as one event, its count times the divergence from the
    shorter context exceeds half a logarithm of its count for each stored next. lp is the log10 probability of the next
    from here on, left the log10 share of other symbols in what the shorter context gives them, delta what a stored next
    adds to lp of the shorter context and left.
    """

    def run(found: pa.Table) -> pa.Table:
        return _grown(*(found.column(n).to_numpy() for n in ("ctx", "t", "c", "q", "g", "gs")))

    return _by_context(nexts.select("ctx", "t", "c", "q", "g", "gs")).applyInArrow(run, _LEVEL)


def _grown(*nexts: np.ndarray) -> pa.Table:
    """grow() over contexts that are here with all of their nexts."""
    order = np.argsort(nexts[0], kind="stable")
    ctx, t, c, lq, g, gs = (v[order] for v in nexts)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(ctx)])
    kinds, q = np.diff(np.append(first, len(ctx))), 10.0**lq
    total = t[first].astype(float)
    sc, sq, gain = (np.add.reduceat(v, first) if len(first) else np.empty(0) for v in (c.astype(float), q, c * np.log(c / t / q)))
    rest_c, rest_q = total - sc, np.maximum(1 - sq, 1e-12)
    gain = gain + np.where(rest_c > 0, rest_c * np.log(np.maximum(rest_c, 1) / total / rest_q), 0.0)
    mass = np.maximum(1 - (sc + SMOOTH * sq) / (total + SMOOTH), 1e-12)
    keep = np.repeat(gain > 0.5 * np.log(np.maximum(total, 2)) * kinds, kinds)
    left = np.repeat(np.log10(mass / rest_q), kinds)
    lp = np.where(keep, np.log10((c + SMOOTH * q) / (t + SMOOTH)), lq)
    cols = {"ctx": ctx, "t": t, "c": c, "g": g, "gs": gs, "keep": keep, "left": left, "lp": lp}
    return pa.table(cols | {"delta": pa.array(lp - lq - left, mask=~keep)})


def tree(train: DataFrame, base: np.ndarray, counts: np.ndarray, start: int, rare: int, depth: int = DEPTH) -> tuple[np.ndarray, DataFrame]:
    """(left, values): log10 shares left by single symbols as contexts, and (g, v, n) for longer strings: v is what each
    occurrence of the string of hash g adds to the log10 probability of a text, n how often it occurs in training.

    base has the symbols' log10 probabilities, counts their training counts.
    """
    spark = train.sparkSession
    pairs = materialize(_follows(train, start, rare, 1, np.flatnonzero(counts * HEAVY > counts.sum()).astype(np.uint64)))
    sweep(spark)
    level = materialize(_begun(pairs, base, counts))
    release(pairs)
    sweep(spark)
    left = np.zeros(len(counts))
    kept = level.where("keep").groupBy("ctx").agg(F.first("left").alias("left")).toArrow()
    left[kept["ctx"].to_numpy()] = kept["left"].to_numpy()
    levels, values = [level], [level.where("keep").select("g", F.col("delta").alias("v"), F.col("c").alias("n"))]
    for d in range(2, depth + 1):
        able = level.where(F.col("c") >= LEAST_CONTEXT).select(F.col("g").alias("ctx"), F.col("c").alias("t"), F.col("gs").alias("suf"))
        shorter = level.select(F.col("g").alias("gs"), F.col("lp").alias("q"))
        counted = materialize(_follows(train, start, rare, d, _heavy(able), Bloom(able, "ctx"), Bloom(level, "g")))
        sweep(spark)
        level = materialize(grow(_hashed(counted.join(able.hint("shuffle_hash"), "ctx")).join(shorter.hint("shuffle_hash"), "gs")))
        release(counted)
        sweep(spark)
        levels.append(level)
        values.append(level.where("keep").select("g", F.col("delta").alias("v"), F.col("c").alias("n")))
        values.append(level.where("keep").groupBy("ctx").agg(F.first("left").alias("v"), F.first("t").alias("n")).withColumnRenamed("ctx", "g"))
    every = values[0]
    for v in values[1:]:
        every = every.unionByName(v)
    out = materialize(every.groupBy("g").agg(F.sum("v").alias("v"), F.max("n").alias("n")))
    release(*levels)
    sweep(spark)
    return left, out


#: Sums of a slice of texts: its first text, its texts where they are listed, their sums.
_SUMS = {"sid": pa.int64(), "rids": pa.binary(), "sums": pa.binary()}


def _tree_sums(encoded: DataFrame, left: np.ndarray, values: DataFrame, base: np.ndarray, start: int, rare: int, longest: int) -> DataFrame:
    """(rid, m): the sum over each text's tokens of base and tree, the class as one symbol.

    The HOT most frequent strings are looked up where they are read, so that none of them fills a task.
    """
    spark = encoded.sparkSession
    often = values.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).toArrow()
    fits = np.flatnonzero(np.cumsum(often["k"].to_numpy()) <= HOT)
    top = values.where(F.col("n") >= (often["n"][int(fits[-1])].as_py() if len(fits) else np.iinfo(np.int64).max)).select("g", "v").toArrow()
    hot = top["g"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, worth = Sorted(hot[order]), np.append(top["v"].to_numpy().astype(float)[order], 0.0)
    shared = spark.sparkContext.broadcast((Bloom(values, "g"), left, base, hot, worth))
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, left, base, hot, worth = shared.value
        for b in slices(batches):
            rids = b.column("rid").to_numpy()
            for s, place, text in chunks(b.column("ids").to_pylist(), start, rare):
                first, many = int(text[0]), int(text[-1] - text[0] + 1)
                here = np.where(place > 0, base[s], 0.0)
                here[:-1] += np.where(place[1:] > 0, left[s[:-1]], 0.0)
                sums = np.bincount(text - first, here, many)
                keys, owner = [], []
                for k, h in enumerate(strings(s, longest)[1:], 1):
                    at = np.flatnonzero(place >= k)
                    at = at[bloom.may_hold(h[at])]
                    spot = hot.find(h[at])
                    here = hot.keys[spot] == h[at]
                    sums += np.bincount(text[at[here]] - first, worth[spot[here]], many)
                    at = at[~here]
                    keys.append(h[at])
                    owner.append(text[at] - first)
                key, who = np.concatenate(keys), np.concatenate(owner).astype(np.uint8)  # a slice has 250 texts
                order = np.argsort(key, kind="stable")  # texts come in order for each length, so for each key
                key, who = key[order], who[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])[: len(key)])
                times = np.diff(np.append(new, len(key)))
                key, who = key[new], who[new]
                part = _part(key, parts)
                order = np.argsort(part, kind="stable")
                rows = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(part) else []
                on = [int(part[r[0]]) for r in rows] + [int(rids[first]) % parts]  # texts' own sums go along, without keys
                blobs = [[*(key[r].tobytes() for r in rows), b""], [*(who[r].tobytes() for r in rows), rids[first : first + many].tobytes()]]
                blobs.append([*(_planes(times[r]) for r in rows), sums.tobytes()])
                cols = [pa.array(on, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)]
                cols += [pa.array([int(rids[first])] * len(on), pa.int64()), pa.array([many] * len(on), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "keys", "who", "times", "sid", "texts"])

    def answered(asked: pa.Table, table: pa.Table) -> pa.Table:
        """A slice's sums over the strings of this part, as an array in the order of its texts; with its ids where it came without keys."""
        g, v = table.column("g").to_numpy(), table.column("v").to_numpy()
        order = np.argsort(g)
        g, v = g[order], np.append(v[order], 0.0)
        out = []
        for keys, who, times, sid, texts in zip(*(asked.column(c).to_pylist() for c in ("keys", "who", "times", "sid", "texts"))):
            if not keys:
                out.append((sid, who, times))
            elif len(g):
                key = np.frombuffer(keys, np.int64)
                at = np.minimum(np.searchsorted(g, key), len(g) - 1)
                worth = np.where(g[at] == key, v[at], 0.0) * _numbers(times)
                out.append((sid, b"", np.bincount(np.frombuffer(who, np.uint8), worth, texts).tobytes()))
        return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate(_SUMS.items())})

    def added(sums: pa.Table) -> pa.Table:
        rid = np.frombuffer(b"".join(sums.column("rids").to_pylist()), np.int64)
        return pa.table({"rid": rid, "m": np.sum([np.frombuffer(x, np.float64) for x in sums.column("sums").to_pylist()], axis=0)})

    asked = encoded.select("rid", "ids").mapInArrow(sent, "part int, keys binary, who binary, times binary, sid bigint, texts int").groupBy("part")
    held = values.select(F.pmod(F.shiftrightunsigned("g", 7), F.lit(parts)).cast("int").alias("part"), "g", "v").groupBy("part")
    found = asked.cogroup(held).applyInArrow(answered, "sid bigint, rids binary, sums binary")
    return found.groupBy("sid").applyInArrow(added, "rid bigint, m double")  # a slice has an array from each part


def score(docs: DataFrame, held_out: F.Column | None = None, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs; see the module.

    Trains on rows that aren't held out (a null mark counts as not held out). Null texts are empty and have the end token
    only. Rows repeat as they come; an empty table stays empty; other columns are not read, whatever their names. Without
    training rows every token is unknown to a base of one place.
    """
    held = F.coalesce(remainder(doc_id, 10) == 0 if held_out is None else held_out, F.lit(False))
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").alias("text"))
    uni = materialize(unigrams(src.where("not held_out")))
    n, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    whole = n + ADD * (v + 1)
    top = uni.where(F.col("c") >= LEAST_SYMBOL).orderBy(F.col("c").desc(), "token").limit(ALPHABET).toArrow()
    words, c = pa.concat_arrays(top["token"].chunks or [pa.array([], pa.binary())]), top["c"].to_numpy().astype(np.int64)
    rare, start, end = len(words), len(words) + 1, pc.index(words, pa.scalar(b"", words.type)).as_py()  # -1: not a symbol
    del top
    p = (c + ADD) / whole
    base = np.log10(np.append(p, [max(1 - p.sum(), 1e-12), 1.0]))  # of the class and, never asked for, the start
    encoded = materialize(_encode(src, words, base))
    del words
    sweep(docs.sparkSession)
    train = encoded.where("not held_out").select("ids")
    counts = np.concatenate([c, [n - c.sum(), train.count()]])
    if end >= 0:
        counts[end] = 0  # nothing follows the end
    left, values = tree(train, base, counts, start, rare, depth)
    sweep(docs.sparkSession)
    sums = _tree_sums(encoded, left, values, base, start, rare, depth + 1)
    own = encoded.select("rid", "doc_id", "held_out", "n_tokens", "k", "b")
    listed = encoded.select("rid", F.explode("rare").alias("token"))
    known = listed.join(uni.withColumnRenamed("c", "n").hint("shuffle_hash"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = known.groupBy("rid").agg(
        F.sum(F.log10((F.col("n") + ADD) / F.lit(whole))).alias("rb"), F.count_if(F.col("n") > 0).alias("rk"), F.count("*").alias("rn")
    )
    return own.join(sums, "rid").join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("k") + F.coalesce("rk", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("rb", F.lit(0.0))).alias("base_score"),
        (F.col("m") + F.coalesce(F.col("rb") - F.col("rn") * float(base[rare]), F.lit(0.0))).alias("score"),
    )
