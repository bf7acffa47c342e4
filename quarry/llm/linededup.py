"""Line dedup: content-defined chunks of lines; chunks that other documents repeat are removed after byte comparison.

DataFrame functions only. A document is its lines' 64-bit hashes. What repeats consists of lines that each occur in several
documents, so only stretches of such lines are looked at. A rolling hash over two line hashes starts a new chunk where it is
0 modulo DIVISOR, so a boundary depends on the two lines beside it alone and text put in or taken out elsewhere doesn't move
it. A line of over LONG words is a chunk of its own. The first and the last part of a shared passage may share their chunk
with lines around it; so every line also starts and ends the shortest run of lines of over LONG words, which finds every
passage of over LONG words whole, whatever the length of its lines. Chunks and runs are compared by 128-bit rolling hashes
of their line hashes, and then, line by line, as bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, join_counted, materialize, packed

#: One in so many line pairs ends a chunk.
DIVISOR = 4
#: A line or a run of lines of more words is a passage by itself.
LONG = 50
#: A chunk of several lines has so many words at least.
LEAST = 20


def line_hash(line: F.Column) -> F.Column:
    """64 bits; what they don't tell apart, the comparison of bytes does."""
    return F.xxhash64(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, h, w): hashes and word counts of the lines of each distinct document, which is its id and hash of text."""
    lines = F.split("text", "\n", -1)
    return docs.where("text is not null").select(
        F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc"),
        F.transform(lines, line_hash).alias("h"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("w"),
    ).dropDuplicates(["doc"])


def _stretches(lines: DataFrame) -> DataFrame:
    """(doc, first, h, w): longest stretches of lines that other documents have too, with the place of their first line."""
    spots = lines.select("doc", F.posexplode("h").alias("at", "h"))
    seen = spots.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    found = join_counted(spots, materialize(seen.select("h", "n")), ["h"])
    places = found.groupBy("doc").agg(F.array_sort(F.collect_list("at")).alias("p"))  # at most the document's lines
    breaks = F.expr("filter(sequence(0, size(p) - 1), k -> k = 0 or p[k] != p[k - 1] + 1)")
    cut = lines.join(places, "doc").withColumn("b", breaks)
    each = F.explode(F.expr("transform(b, (k, j) -> struct(p[k] as s, coalesce(get(b, j + 1), size(p)) - k as n))"))
    return cut.select("doc", "h", "w", each.alias("u")).select(
        "doc", F.col("u.s").alias("first"), F.expr("slice(h, u.s + 1, u.n)").alias("h"), F.expr("slice(w, u.s + 1, u.n)").alias("w")
    )


def _units(stretches: DataFrame) -> DataFrame:
    """(doc, start, n, k1, k2): chunks and runs of n lines of all stretches; k1 and k2 hash their line hashes."""
    cut = F.expr(
        f"""filter(sequence(0, size(h) - 1), i -> i = 0 or w[i] > {LONG} or w[i - 1] > {LONG}
                   or pmod(xxhash64(h[i - 1], h[i]), {DIVISOR}) = 0)"""
    )
    enough = F.aggregate("w", F.lit(0), lambda a, x: a + x) >= LEAST
    base = stretches.where(enough).withColumn("cut", cut).withColumn("at", F.expr("sequence(0, size(h) - 1)"))
    chunks = "transform(cut, (s, j) -> struct(s, coalesce(get(cut, j + 1), size(h)) - s as n))"
    long_enough = f"aggregate(slice(w, c.s + 1, c.n), 0, (a, x) -> a + x) >= if(c.n > 1, {LEAST}, {LONG} + 1)"
    # of[k] is the line of word k, before[i] the words ahead of line i (marks holds line i once more than it has words)
    base = base.withColumns(
        {
            "of": F.expr("flatten(transform(at, i -> array_repeat(i, w[i])))"),
            "marks": F.expr("flatten(transform(at, i -> array_repeat(i, w[i] + 1)))"),
        }
    )
    base = base.withColumn("before", F.expr("filter(transform(marks, (i, k) -> if(k = 0 or marks[k - 1] != i, k - i, null)), x -> x is not null)"))
    runs = f"""concat(
        filter(transform(at, i -> struct(i as s, get(of, before[i] + {LONG}) - i + 1 as n)), r -> r.n is not null),
        filter(transform(at, i -> struct(get(of, before[i] + w[i] - {LONG} - 1) as s, i + 1 - get(of, before[i] + w[i] - {LONG} - 1) as n)), r -> r.n is not null))"""
    units = F.expr(f"array_distinct(concat(filter({chunks}, c -> {long_enough}), {runs}))")
    flat = base.select("doc", "first", "h", F.explode(units).alias("u")).select("doc", "first", "u", F.expr("slice(h, u.s + 1, u.n)").alias("part"))
    return flat.select(
        "doc", (F.col("first") + F.col("u.s")).alias("start"), F.col("u.n").alias("n_lines"),
        F.xxhash64("part").alias("k1"), F.xxhash64(F.lit(1), F.size("part"), F.reverse("part")).alias("k2"),
    )


def _marks(units: DataFrame) -> DataFrame:
    """(doc, drop, keep): line positions to drop, and those of the first document that the drops are copies of."""
    seen = units.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    found = join_counted(units, materialize(seen.where("lo != hi").drop("hi")), ["k1", "k2"]).select(
        "doc", F.expr("sequence(start, start + n_lines - 1)").alias("at"), (F.col("doc") != F.col("lo")).alias("copy")
    )
    return found.groupBy("doc").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("copy"), F.col("at"))))).alias("drop"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("copy"), F.col("at"))))).alias("keep"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with ``text`` less repeated chunks and two more columns: n_lines and n_removed (lines).

    Of each repeated chunk the copy in the document with the smallest (doc_id, hash of text) stays; repeats within one
    document stay too, and so do short or single lines that recur. Rows that repeat both id and text count as one document
    and fare alike. A null text has no lines and stays null; a text of which nothing is left is empty. Two unlike lines of
    one hash are not proven equal, so neither goes. Columns of docs called n_lines or n_removed are replaced; ``text``
    moves to the end. An empty table stays empty.
    """
    lines = materialize(_lines(docs.select("doc_id", "text")))
    units = materialize(_units(_stretches(lines)))
    marks = _marks(units).select(F.col("doc.doc_id").alias("_d"), F.col("doc.th").alias("_h"), "drop", "keep")
    rows = packed(docs, ("text", "n_lines", "n_removed"), text=F.col("text"), _id=F.col("doc_id"), _th=F.xxhash64("text"))
    joined = materialize(rows.join(marks, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left").drop("_d", "_h"))
    joined = joined.withColumn("_lines", F.split("text", "\n", -1))
    spots = joined.where("drop is not null").select("_lines", F.explode(F.array_union("drop", "keep")).alias("i"))
    same = spots.select(F.expr("_lines[i]").alias("line")).groupBy(line_hash(F.col("line")).alias("h"))
    bad = [r.h for r in same.agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a != b").select("h").collect()]
    drop = F.col("drop")
    if bad:  # unlike lines of one 64-bit hash; none to be expected among fewer than billions of lines
        drop = F.filter("drop", lambda i: ~line_hash(F.get("_lines", i)).isin(bad))
    left = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _drop), i -> _lines[i]), '\n')")
    return joined.withColumn("_drop", F.coalesce(drop, F.array().cast("array<int>"))).select(
        "_row.*",
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_drop").cast("long").alias("n_removed"),
        F.when(F.size("_drop") > 0, left).otherwise(F.col("text")).alias("text"),
    )
