"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary, and the forms they lead to.

One edit leaves a half of a word intact. Let L be the length of the shorter word of a pair and p the place of the first
difference, 0 to L. If p lies in [lo, hi), both words begin with the same lo letters and end with the same L - hi ones. A block
holds the words that share these, so [0, L + 1) is cut in the middle: blocks of a shared first half are ranges of the
dictionary, blocks of a shared second half are ranges of the reversed one. A block of too many words is cut again the same
way, and its halves again, until it is small or one place is left. Each place is in one interval, so each pair is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_counted, materialize, release

#: A run of letters.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Code points and occurrences that a word has at least.
LEAST, OCCURRENCES = 6, 5
#: A near word is a form if it occurs so many times as often.
RATIO = 5
#: A block of more words is cut in two, as long as it has two places.
BLOCK = 512
#: Letters of the words that are laid out at once.
CELLS = 4 << 20

KEY = ["len", "lo", "hi", "key"]


def typed(docs: DataFrame, divisor: int = 199) -> DataFrame:
    """(word) of every run of letters in docs(doc_id, text), A-Z in lower case; of every run whose crc32 with the document's
    id is a multiple of ``divisor`` one letter is left out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    runs = runs.select(F.translate("run", upper, lower).alias("run"), "id")
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    n, at = F.length("run"), (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, n))
    return runs.select(F.when(F.col("h") % divisor == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences."""
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= occurrences)


def _halves(blocks: DataFrame) -> DataFrame:
    """Words of intervals [lo, hi) in the two halves of each, with what the block's words share there."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    cut = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi"))))
    out = blocks.select("word", "n", "len", cut.alias("cut")).select("word", "n", "len", "cut.lo", "cut.hi")
    head = F.substr("word", F.lit(1), F.col("lo"))
    tail = F.reverse(F.when(F.col("hi") < F.col("len"), F.right("word", F.col("len") - F.col("hi"))).otherwise(""))
    out = out.withColumns({"head": head, "tail": tail})
    return out.withColumn("key", F.xxhash64("head", "tail"))


def near(words: list[str], length: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words of one block that one edit makes equal at a first difference in [lo, hi), for words that stand
    sorted by ``length`` (of the shorter word of a pair) and block."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    size = np.array([len(w) for w in words], np.int64)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(words) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(words))
    s = 0
    while s < len(edges):
        # whole blocks of one length, as many as CELLS letters hold
        n = length[edges[s]]
        same = length[edges[s:]] == n
        fit = (ends[s:] - edges[s]) * (n + 1) <= CELLS
        e = s + max(1, int(np.argmin(np.append(same & fit, False))))
        a, b = edges[s], ends[e - 1]
        letters = np.array(words[a:b], f"<U{n + 1}").view(np.uint32).reshape(b - a, n + 1)
        end = np.repeat(ends[s:e] - a, ends[s:e] - edges[s:e])
        i, o = np.arange(b - a), 0
        while True:
            o += 1
            i = i[i + o < end[i]]
            if not len(i):
                break
            for k in range(0, len(i), max(1, CELLS // (n + 1))):
                x = i[k : k + max(1, CELLS // (n + 1))]
                y = x + o
                x, y = np.where(size[a + x] <= size[a + y], x, y), np.where(size[a + x] <= size[a + y], y, x)
                x, y = x[size[a + x] == n], y[size[a + x] == n]
                differ = letters[x] != letters[y]
                p = differ.argmax(1)
                ok = differ.any(1) & (p >= lo[a + x]) & (p < hi[a + x])
                x, y, p, differ = x[ok], y[ok], p[ok], differ[ok]
                swap = (size[a + y] == n) & (differ.sum(1) == 1)
                moved = (letters[x, :n] != letters[y, 1:]) & (np.arange(n) >= p[:, None])
                ok = swap | (size[a + y] == n + 1) & ~moved.any(1)
                found.append((a + x[ok], a + y[ok]))
        s = e
    return tuple(np.concatenate(f) for f in zip(*found))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of blocks that arrive in order, both ways round; a block that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        i, j = near(words, *(t.column(c).to_numpy().astype(np.int64) for c in ("len", "lo", "hi")), t.column("block").to_numpy())
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        names = np.array([*words, None], object)
        return pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(n[b], pa.int64())], names=["word", "near", "near_n"])

    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        block = t.column("block").to_numpy()
        last = np.flatnonzero(block != block[-1]) if len(block) else np.empty(0, np.int64)
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pairs(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield pairs(held)


def pairs(vocab: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every word of vocab(word, n) with every word one inserted, deleted or replaced letter away."""
    spark = vocab.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("word")
    whole = vocab.select("word", "n", F.explode(F.sequence(F.greatest(n - 1, F.lit(least)), n)).alias("len"))
    level, old, found = _halves(whole.withColumns({"lo": F.lit(0), "hi": F.col("len") + 1})), None, None
    while True:
        sizes = level.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.length("word") == F.col("len")).alias("short"))
        large = (F.col("n") > block) & (F.col("hi") - F.col("lo") > 1)
        sizes = materialize(sizes.where("n > 1 AND short > 0").select(*KEY, "n", large.alias("large")))
        joined = join_counted(level.withColumnRenamed("n", "times"), sizes, KEY).withColumnRenamed("times", "n")
        order = ["len", "lo", "hi", "head", "tail"]
        small = joined.where(~F.col("large")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "word")
        small = small.select("len", "lo", "hi", F.xxhash64("len", "lo", "hi", "key").alias("block"), "word", "n")
        one = small.mapInArrow(_scan, "word string, near string, near_n bigint")
        one = materialize(one)
        found = one if found is None else found.union(one)
        if sizes.where("large").isEmpty():
            release(sizes, old)
            return found
        level = materialize(_halves(joined.where("large")))
        release(sizes, old)
        old = level


def variants(docs: DataFrame, divisor: int = 199, least: int = LEAST, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per distinct word of the texts of docs(doc_id, text), see typed and vocabulary.

    n_near counts the words one edit away. The form of a word is the most frequent of them (ties: the first in order of code
    points) if it occurs ``ratio`` times as often at least, else null; form_n is its count. root is where forms lead from a
    word to in the end, itself if it has none. Null and empty texts have no words; a null id reads as the empty text; repeated
    rows count as often as they come; other columns are not read; no words make an empty result.
    """
    vocab = materialize(vocabulary(typed(docs, divisor), least, occurrences))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best")
    close = pairs(vocab, least).groupBy("word").agg(F.count("*").alias("n_near"), best)
    likely = -F.col("best.n") >= ratio * F.col("n")
    made = materialize(
        vocab.join(close, "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(likely, F.col("best.near")).alias("form"),
            F.when(likely, -F.col("best.n")).alias("form_n"),
        )
    )
    # counts grow by the ratio along forms, so chains are short; each round doubles the way that is known
    ways, more = made.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), True
    while more:
        ways = materialize(ways)
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        release(ways)
        ways, more = step, not step.where("open").isEmpty()
    return made.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
