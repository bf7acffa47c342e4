"""Lexical and vector top-k for batches of queries, fusion and re-ranking. A ranked list has an explicit rank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quarry.functions.questions import concepts
from quarry.functions.stemming import analysed
from quarry.functions.text import fold, search_form, tokens
from quarry.operators import scored

#: Vectors of one query block; more queries make more passes, never a larger broadcast.
BLOCK = 4096
#: Unknown terms that are compared with every word of a vocabulary; more of them meet it in a join.
FEW = 2000
#: Groups of a question that are searched.
GROUPS = 24
# Endings of verb forms, and words that alone ask for nothing.
VERB_ENDINGS = "(?:ando|endo|indo|ados|adas|ado|ada|ar|er|ir)$"
GENERIC = r"^(sem|nao|\d+)$"
#: Letters by which questions and titles meet.
HEAD = 12


def postings(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, term): distinct terms of each document (R05, K08), with the columns ``keep``, such as its collection."""
    words = F.array_distinct(_words(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), *keep, F.explode(words).alias("term"))


def positions(docs: DataFrame, id_col: str, text_col: str, *keep: str, weight: float = 1.0) -> DataFrame:
    """(id, term, n, w, size): how often each term occurs in a field of that weight, and the field's words."""
    words = docs.select(F.col(id_col).alias("id"), *keep, _words(F.col(text_col)).alias("words"))
    each = words.select("id", *keep, F.size("words").alias("size"), F.explode("words").alias("term"))
    return each.groupBy("id", *keep, "term", "size").agg(F.count("*").alias("n")).withColumn("w", F.lit(weight))


def _words(text: Column) -> Column:
    return F.filter(F.split(search_form(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def needed(n_words: Column) -> Column:
    """Words that a hit must cover (P10)."""
    return F.when(n_words >= 3, 2).otherwise(1)


def rank_by(df: DataFrame, key: str, *order: Column, k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def prefix_terms(terms: DataFrame, words: DataFrame, least: int = 4) -> DataFrame:
    """(term, word): longer words that begin with a term of ``least`` letters or more.

    Words and terms meet in an equi join on their first ``least`` letters, so prefixes of words that no term asks for are not built.
    """
    head = lambda c: F.left(c, F.lit(least)).alias("head")
    asked = terms.select("term").distinct().where(F.length("term") >= least).select("term", head(F.col("term")))
    longer = words.select("word").distinct().where(F.length("word") > least).select("word", head(F.col("word")))
    return asked.join(longer, "head").where(F.startswith("word", "term") & (F.col("word") != F.col("term"))).select("term", "word")


def lexical_topk(queries: DataFrame, places: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """(qid, id, coverage, n_words, score, rank): documents by the question's words that they have, then by density.

    queries(qid, term), places(id, term, n, w, size) as positions() gives them. Terms also match words that they begin;
    these count for density only. With ``by``, a column of both sides, a question searches its own collection (R07).
    Places come together by document; where the text is at hand, lexical_search() needs no exchange of words.
    """
    more = [by] if by else []
    each = places.groupBy("id", *more).agg(F.collect_list(F.struct("term", (F.col("n") * F.col("w")).cast("double").alias("w"))).alias("p"), F.max("size").alias("size"))
    return _by_density(queries, each.select("id", *more, F.col("p.term").alias("words"), F.col("p.w").alias("w"), "size"), k, by)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, words, size): the words of each document, one row an id."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.coalesce(_words(F.col(text_col)), F.array().cast("array<string>")).alias("words"))
    return scored.one_row(rows.withColumn("size", F.size("words")), "id", *keep)


def lexical_search(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = 10, by: str | None = None) -> DataFrame:
    """lexical_topk() over the words of a text: a task scores its documents against all questions, a block of them at a time."""
    return _by_density(queries, text_rows(docs, id_col, text_col, *([by] if by else [])), k, by)


def _by_density(queries: DataFrame, rows: DataFrame, k: int, by: str | None) -> DataFrame:
    hits = scored.by_terms(queries, rows, k, by)
    if hits is None:
        kinds = queries.schema["qid"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        hits = queries.sparkSession.createDataFrame([], "qid {}, id {}, coverage bigint, n_words bigint, d double, size bigint".format(*kinds))
    return _ranked_by_density(hits, k)


def _ranked_by_density(hits: DataFrame, k: int) -> DataFrame:
    d = F.col("d") / F.log(1 + F.greatest(F.col("size"), F.lit(1)))
    out = hits.select("qid", "id", "coverage", "n_words", (F.col("coverage") + d / (1 + d)).alias("score"))
    return rank_by(out, "qid", F.col("coverage").desc(), F.round("score", 9).desc(), F.col("id"), k=k)


def all_words(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, id): all documents that have every word of a question."""
    hits = scored.by_terms(queries, text_rows(docs, id_col, text_col), None)
    return docs.sparkSession.createDataFrame([], "qid bigint, id bigint") if hits is None else hits.select("qid", "id")


def all_words_topk(queries: DataFrame, docs_posts: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, coverage, rank): documents that have every word of a question."""
    size = queries.groupBy("qid").agg(F.count("*").alias("n"))
    hits = queries.join(docs_posts, "term").groupBy("qid", "id").agg(F.count("*").alias("coverage"))
    return rank_by(hits.join(size, "qid").where("coverage = n").drop("n"), "qid", F.col("id"), k=k)


def cover_density(queries: DataFrame, positions: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, coverage, score, rank): covered words first, then how dense they stand in a document.

    positions(id, term, n, w, size): occurrences of a term in a field of weight w, and the document's words. The density
    is the weighted occurrences over the logarithm of the length, taken to d / (1 + d), so it never outweighs a word.
    """
    hits = queries.join(positions, "term").groupBy("qid", "id").agg(
        F.countDistinct("term").alias("coverage"), F.sum(F.col("n") * F.col("w")).alias("d"), F.max("size").alias("size")
    )
    d = F.col("d") / F.log(1 + F.greatest(F.col("size"), F.lit(1)))
    scored = hits.withColumn("score", F.col("coverage") + d / (1 + d)).select("qid", "id", "coverage", "score")
    return rank_by(scored, "qid", F.round("score", 9).desc(), F.col("id"), k=k)


def in_search_order(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows that a ranked list names, with its rank: a lookup keeps the search's order."""
    return ranked.select("qid", F.col("id").alias(key), "rank").join(rows, key)


def either(lexical: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, lexical_rank, vector_rank, score, rank) of two ranked lists, either of which may be empty."""
    both = lexical.select("qid", "id", F.col("rank").alias("lexical_rank")).join(
        vector.select("qid", "id", F.col("rank").alias("vector_rank")), ["qid", "id"], "full_outer"
    )
    score = F.coalesce(1.0 / (60 + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("vector_rank")), F.lit(0.0))
    return rank_by(both.withColumn("score", score), "qid", F.round("score", 12).desc(), F.col("id"), k=k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.35, by: str | None = None) -> DataFrame:
    """(qid, id, similarity, rank): cosine top-k of queries(qid, v) over vectors(id, v), in blocks of queries.

    Each block goes out once; a task keeps k rows per query and batch, so the exchange carries k rows per query and task.
    With ``by``, a column of both sides, a question searches its own collection (R10).
    """
    spark = vectors.sparkSession
    more = [by] if by else []
    asked = queries.where(F.col("v").isNotNull())
    blocks = max(1, -(-asked.count() // BLOCK))
    parts = spark.createDataFrame([], "qid bigint, id bigint, similarity double")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "v", *more).collect()
        if not rows:
            continue
        ids = np.array([r.qid for r in rows], np.int64)
        q = np.array([r.v for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        kinds = np.array([str(r[by]) for r in rows]) if by else None

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, kinds=kinds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, q.shape[1])
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                who = np.array(batch.column("id").to_pylist(), np.int64)
                theirs = np.array([str(c) for c in batch.column(by).to_pylist()]) if by else None
                found: list[tuple] = []
                for s in range(0, len(q), 256):
                    sim = q[s : s + 256] @ x.T
                    if by:
                        sim[kinds[s : s + 256, None] != theirs] = -2
                    for i, row in enumerate(sim):
                        at = np.flatnonzero(row >= max(least - 1e-12, -1))
                        if len(at) > k:  # ties with the k-th stay until they are ordered
                            at = at[row[at] >= np.partition(row[at], -k)[-k] - 1e-9]
                        found.append((np.full(len(at), ids[s + i]), who[at], row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["qid", "id", "similarity"])

        part = vectors.where("v is not null").select("id", "v", *more).mapInArrow(run, "qid bigint, id bigint, similarity double")
        parts = parts.unionByName(part)
    return rank_by(parts.where(F.col("similarity") >= least), "qid", F.round("similarity", 9).desc(), F.col("id"), k=k)


def rrf(lists: DataFrame, k: float = 60.0, weight: Column | None = None) -> DataFrame:
    """(qid, id, score, rank) of lists(qid, id, rank[, ...]): reciprocal rank fusion, weighted if asked."""
    w = F.lit(1.0) if weight is None else weight
    fused = lists.groupBy("qid", "id").agg(F.sum(w / (F.lit(k) + F.col("rank"))).alias("score"))
    return rank_by(fused, "qid", F.round("score", 12).desc(), F.col("id"))


def rerank(lexical: DataFrame, vector: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame] | None = None, intent_weight: float = 0.25) -> DataFrame:
    """(qid, id, score, rank): all signals of a candidate in one score, ties by id.

    lexical(qid, id, coverage, n_words, rank) and vector(qid, id, rank) meet in a full outer join. signals(qid, id, exact,
    typed) says which candidates are what the question names, worth 100, and which are of the kind that it asks for, 1.2;
    a function adds these two columns to the candidates (qid, id), so that the lists aren't made again for it.
    """
    both = lexical.select("qid", "id", "coverage", "n_words", F.col("rank").alias("lex")).join(
        vector.select("qid", "id", F.col("rank").alias("vec")), ["qid", "id"], "full_outer"
    )
    none = F.lit(False)
    if signals is None:
        both = both.withColumns({"exact": none, "typed": none})
    elif callable(signals):
        both = signals(both)
    else:
        both = both.join(signals.select("qid", "id", "exact", "typed"), ["qid", "id"], "left")
    parts = {
        "exact": 100 * F.coalesce("exact", none).cast("double"),
        "covered": 2 * F.coalesce(F.col("coverage") / F.col("n_words"), F.lit(0.0)),
        "lexical": F.coalesce(0.8 / F.col("lex"), F.lit(0.0)),
        "vector": F.coalesce(0.5 / F.col("vec"), F.lit(0.0)),
        "typed": 1.2 * F.coalesce("typed", none).cast("double"),
    }
    score = sum(parts.values(), F.lit(intent_weight))
    return rank_by(both.select("qid", "id", score.alias("score")), "qid", F.round("score", 9).desc(), F.col("id"))


def catalogue_topk(questions: DataFrame, titles: DataFrame, excerpts: DataFrame, k: int = 30) -> DataFrame:
    """(qid, id, score, rank): documents whose title or excerpts a question finds.

    questions(qid, text), titles(id, title), excerpts(qid, id, score) as found by a text search. A title that equals the
    folded question scores 300, one that begins with it 200, one that has all of its words 100; the best score counts.
    """
    q = questions.select("qid", F.trim(fold(F.col("text"))).alias("q")).where("q != ''")
    t = titles.select("id", F.trim(fold(F.col("title"))).alias("title")).where("title != ''")
    words = lambda c: F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    need = q.select("qid", words(F.col("q")).alias("need"))
    posts = t.select("id", F.explode(words(F.col("title"))).alias("w"))
    # titles meet a question in its rarest word, and those alone are looked at for the others
    counts = need.select("qid", F.explode("need").alias("w")).join(posts.groupBy("w").agg(F.count("*").alias("df")), "w", "left")
    rarest = counts.groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("r")).select("qid", F.col("r.w").alias("w"))
    near = rarest.join(posts, "w").join(need, "qid").select("qid", "id", "need").join(t.select("id", words(F.col("title")).alias("has")), "id")
    match = near.where(F.size(F.array_except("need", "has")) == 0).select("qid", "id", F.lit(100.0).alias("score"))
    head = lambda c: F.left(c, F.lit(HEAD))
    begun = q.where(F.length("q") >= HEAD).withColumn("h", head(F.col("q"))).join(t.withColumn("h", head(F.col("title"))), "h")
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.length("title"), F.lit(HEAD - 1))), lambda n: F.left(F.col("title"), n))
    cut = t.select("id", F.length("title").alias("size"), F.explode(cuts).alias("h"))
    short = q.where(F.length("q") < HEAD).join(cut, F.col("q") == F.col("h")).select("qid", "id", (F.col("size") == F.length("q")).alias("whole"))
    named = begun.where(F.startswith("title", "q")).select("qid", "id", (F.col("q") == F.col("title")).alias("whole")).unionByName(short)
    named = named.select("qid", "id", F.when(F.col("whole"), 300.0).otherwise(200.0).alias("score"))
    every = named.unionByName(match).unionByName(excerpts.select("qid", "id", F.col("score").cast("double").alias("score")))
    return rank_by(every.groupBy("qid", "id").agg(F.max("score").alias("score")), "qid", F.round("score", 9).desc(), F.col("id"), k=k)


def ambiguous(ranked: DataFrame, margin: float = 0.05) -> DataFrame:
    """(qid, gap, ambiguous) from the two best scores."""
    top = ranked.where("rank <= 2").groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b")
    )
    gap = F.col("a") - F.col("b")
    return top.select("qid", gap.alias("gap"), F.coalesce(F.round(gap, 9) <= margin, F.lit(False)).alias("ambiguous"))


def osa(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Optimal string alignment distances of pairs of strings (F28): one table, filled for all pairs at once."""
    la, lb = (np.array([*map(len, x)], np.int64) for x in (a, b))
    if not len(la):
        return la
    x, y = (np.array([[ord(c) for c in w] + [-1 - side] * (n - len(w)) for w in s], np.int64).reshape(len(s), n) for side, (s, n) in enumerate(((a, la.max()), (b, lb.max()))))
    out = np.where(la == 0, lb, 0)
    before, row = None, np.tile(np.arange(y.shape[1] + 1), (len(la), 1))
    for i in range(1, x.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, y.shape[1] + 1):
            unlike = x[:, i - 1] != y[:, j - 1]
            best = np.minimum(np.minimum(new[:, j - 1], row[:, j]) + 1, row[:, j - 1] + unlike)
            if i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swapped, np.minimum(best, before[:, j - 2] + 1), best)
            new[:, j] = best
        before, row = row, new
        done = la == i
        out[done] = row[done, lb[done]]
    return out


def osa_distance(a: str, b: str) -> Column:
    """osa() over columns of words without null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        found = [osa(x[s : s + 4096].tolist(), y[s : s + 4096].tolist()) for s in range(0, len(x), 4096)]
        return pd.Series(np.concatenate([*found, np.empty(0, np.int64)]).astype("int32"))

    return F.pandas_udf(run, IntegerType())(a, b)


def letters_of(words: Sequence[str]) -> np.ndarray:
    """A bit for each letter (hashed to 26) and for each that comes twice: an edit changes two bits at most."""
    codes = [np.array([*map(ord, w)], np.int64) % 26 + 26 * k for k, w in enumerate(words)]
    n = np.bincount(np.concatenate([*codes, np.empty(0, np.int64)]), minlength=26 * len(words)).reshape(-1, 26)
    return (np.hstack([n > 0, n > 1]) * (np.uint64(1) << np.arange(52, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def typos(terms: Sequence[str], words: DataFrame) -> DataFrame:
    """(term, word, d): words(word) within one edit of a term, two where both have nine letters. Pairs are compared by their
    lengths and letters in the tasks, distances taken of what is left; words of equal term and word are not given out."""
    size, mask = np.array([*map(len, terms)], np.int64), letters_of(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [w for w in batch.column("word").to_pylist() if len(w) <= size.max() + 2]
            for s in range(0, len(every), 4096):
                part = every[s : s + 4096]
                own, bits = np.array([*map(len, part)], np.int64), letters_of(part)
                for k in range(0, len(terms), 512):
                    limit = 1 + ((own[:, None] >= 9) & (size[k : k + 512] >= 9))
                    like = (np.abs(own[:, None] - size[k : k + 512]) <= limit) & (np.bitwise_count(bits[:, None] ^ mask[k : k + 512]) <= 2 * limit)
                    i, j = np.nonzero(like)
                    a, b = [terms[k + x] for x in j], [part[x] for x in i]
                    d = np.concatenate([*(osa(a[x : x + 4096], b[x : x + 4096]) for x in range(0, len(a), 4096)), np.empty(0, np.int64)])
                    on = np.flatnonzero((d >= 1) & (d <= limit[i, j]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a[x] for x in on], pa.string()), pa.array([b[x] for x in on], pa.string()), pa.array(d[on].astype(np.int32))], names=["term", "word", "d"]
                    )

    return words.select("word").mapInArrow(run, "term string, word string, d int")


def deletion_forms(word: Column, twice: Column) -> Column:
    """The word, and what is left of it without one letter, or without one and two where ``twice`` says so."""

    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))

    one = once(word)
    two = F.flatten(F.transform(one, once))
    return F.array_distinct(F.concat(F.array(word), one, F.when(twice, two).otherwise(F.array().cast("array<string>"))))


def verb_form(word: Column) -> Column:
    """What a long word has before the ending of a productive verb form; short words stay whole."""
    return F.when(F.length(word) >= 7, F.regexp_replace(word, VERB_ENDINGS, "")).otherwise(word)


def fuzzy_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, word, quality): words of the vocabulary that a query term may stand for.

    Equal 1, prefix of four letters or more 0.88, another form of the verb 0.86, one typo 0.72, two in long words 0.6; digits
    are never corrected, and a term that is in the vocabulary takes no typos. Pairs are blocked before any distance is taken:
    equal terms and verb forms by equi joins, prefixes by their first letters, typos of a few terms by lengths and letters where
    the vocabulary is, typos of many by deletion neighbourhoods (two strings within d edits share a form with at most d letters
    left out of each), which take some hundred rows for a long word.
    """
    t, v = terms.select("term").distinct(), vocab.select(F.col("term").alias("word")).distinct()
    exact = t.join(v, F.col("term") == F.col("word")).select("term", "word", F.lit(1.0).alias("quality"))
    letters = ~F.col("term").rlike(r"\d")
    plain = v.where((F.length("word") >= 5) & ~F.col("word").rlike(r"\d"))
    prefix = prefix_terms(t.where(letters), plain).withColumn("quality", F.lit(0.88))
    long_ = t.where(letters & (F.length("term") >= 5))
    forms = long_.select("term", verb_form(F.col("term")).alias("form")).join(plain.select("word", verb_form(F.col("word")).alias("form")), "form")
    forms = forms.select("term", "word", F.lit(0.86).alias("quality"))
    open_ = long_.join(exact.select("term"), "term", "left_anti")
    some = [r.term for r in open_.limit(FEW + 1).collect()]
    if len(some) <= FEW:
        near = typos(some, plain) if some else None
    else:
        left = open_.select("term", F.explode(deletion_forms(F.col("term"), F.length("term") >= 9)).alias("form"))
        right = plain.select("word", F.explode(deletion_forms(F.col("word"), F.length("word") >= 9)).alias("form"))
        near = left.join(right, "form").select("term", "word").distinct().withColumn("d", osa_distance("term", "word"))
    found = exact.unionByName(prefix).unionByName(forms)
    if near is not None:
        limit = F.when((F.length("term") >= 9) & (F.length("word") >= 9), 2).otherwise(1)
        near = near.where((F.col("d") >= 1) & (F.col("d") <= limit))
        found = found.unionByName(near.select("term", "word", F.when(F.col("d") == 1, 0.72).otherwise(0.6).alias("quality")))
    return found.groupBy("term", "word").agg(F.max("quality").alias("quality"))


def fuzzy_search(queries: DataFrame, title: DataFrame, body: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """fielded_search() over the postings of titles, which weigh 3, and bodies, which weigh 1."""
    fields = title.withColumn("w", F.lit(3.0)).unionByName(body.withColumn("w", F.lit(1.0)))
    return fielded_search(queries, fields, n_docs, k)


def fuzzy_documents(queries: DataFrame, docs: DataFrame, id_col: str, title: Column, body: Column, k: int = 10) -> DataFrame:
    """fuzzy_search() over a title and a body of each document."""
    none = F.array().cast("array<string>")
    words = [F.coalesce(F.array_distinct(_words(c)), none) for c in (title, body)]
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in zip(("t", "b"), words)])
    weights = F.concat(F.transform("t", lambda _: F.lit(3.0)), F.transform("b", lambda _: F.lit(1.0)))
    rows = scored.one_row(rows.select("id", F.concat("t", "b").alias("words"), weights.alias("w")), "id")
    return grouped_documents(_single_groups(queries), rows, docs.count(), k)


def _single_groups(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.col("term").alias("grp"), F.lit(0).alias("alt"), "term", F.lit(1).alias("words"))


def fielded_search(queries: DataFrame, fields: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(qid, id, coverage, score, rank): fielded inverse-frequency search with typo tolerance.

    queries(qid, term), fields(id, term, w). A term scores its best field weight x quality x idf in a document;
    documents must cover half of the terms, as many as any other, and reach 45 % of the best score.
    """
    return grouped_search(_single_groups(queries), fields, n_docs, k)


def question_groups(questions: DataFrame) -> DataFrame:
    """(qid, grp, alt, term, words) of questions(qid, text) (K10): what a question asks for, at most GROUPS things.

    A word outside synonym phrases is a group of its own; a phrase is one group whose alternatives are it and its terms, each
    of one or more words. Questions of negations and numbers only have no groups (K12).
    """
    c = questions.select("qid", concepts(F.col("text")).alias("c"))
    single = F.transform(tokens(F.col("c.rest")), lambda t: F.array(F.array(t)))
    phrases = F.transform("c.alternatives", lambda g: F.filter(F.transform(g, tokens), lambda a: F.size(a) > 0))
    groups = c.select("qid", F.slice(F.filter(F.concat(single, phrases), lambda g: F.size(g) > 0), 1, GROUPS).alias("g"))
    generic = F.forall("g", lambda g: F.forall(g, lambda a: F.forall(a, lambda t: t.rlike(GENERIC))))
    each = groups.where(~generic).select("qid", F.posexplode("g").alias("grp", "alts"))
    each = each.select("qid", "grp", F.posexplode("alts").alias("alt", "terms"))
    return each.select("qid", "grp", "alt", F.explode("terms").alias("term"), F.size("terms").alias("words"))


def concept_search(questions: DataFrame, fields: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(qid, id, coverage, score, rank): search by concepts (K10): question_groups() of questions(qid, text) in
    grouped_search(), so synonyms neither multiply a score nor count as further words."""
    return grouped_search(question_groups(questions), fields, n_docs, k)


def grouped_search(groups: DataFrame, fields: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(qid, id, coverage, score, rank): fielded inverse-frequency search with typo tolerance.

    groups(qid, grp, alt, term, words), fields(id, term, w). A term scores its best field weight x quality x idf in a
    document. An alternative scores the mean of its words if the document has all of them, a group its best alternative.
    Documents must cover half of the groups, as many as any other, and reach 45 % of the best score.
    """
    each = fields.groupBy("id").agg(F.collect_list(F.struct("term", F.col("w").cast("double").alias("w"))).alias("f"))
    return grouped_documents(groups, each.select("id", F.col("f.term").alias("words"), F.col("f.w").alias("w")), n_docs, k)


def grouped_documents(groups: DataFrame, rows: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """grouped_search() over rows(id, words, w), a row per document with its fields' words and weights: words leave a document
    to be counted only, and a task scores its documents against all questions, a block of them at a time."""
    vocab = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).persist(StorageLevel.DISK_ONLY)
    idf = lambda df: 1 + F.log(1 + F.lit(float(n_docs)) / (1 + df))
    match = fuzzy_terms(groups.select("term"), vocab).join(vocab.withColumnRenamed("term", "word"), "word")
    match = match.where((F.col("df") > 1) | (F.col("quality") != 0.88))
    match = match.select("term", "word", (F.col("quality") * idf(F.col("df"))).alias("value"), (F.col("df") > 1).cast("int").alias("often"))
    prefixed = groups.select("term").distinct().where((F.length("term") >= 4) & ~F.col("term").rlike(r"\d"))
    asked = groups.groupBy("qid", "grp", "alt", "term").agg(F.max("words").alias("words"))
    try:
        found = scored.by_groups(asked, match, 0.88 * (1 + math.log(1 + n_docs / 2)), prefixed, rows, k)
    finally:
        vocab.unpersist()
    if found is None:
        kinds = groups.schema["qid"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        found = groups.sparkSession.createDataFrame([], "qid {}, id {}, coverage bigint, score double".format(*kinds))
    best = Window.partitionBy("qid")
    found = found.withColumn("top", F.max("coverage").over(best)).where("coverage = top")
    found = found.withColumn("high", F.max("score").over(best)).where("score >= 0.45 * high")
    return rank_by(found.select("qid", "id", "coverage", "score"), "qid", F.round("score", 9).desc(), F.col("id"), k=k)


def written_places(docs: DataFrame, id_col: str, text_col: str, weight: float = 1.0) -> DataFrame:
    """(id, word, n, w, size): how often each lower-case word, accents kept, occurs in a field of that weight, and the
    field's words (R05)."""
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = docs.select(F.col(id_col).alias("id"), words.alias("words")).select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    return each.groupBy("id", "word", "size").agg(F.count("*").alias("n")).withColumn("w", F.lit(weight))


def stemmed_topk(questions: DataFrame, places: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, coverage, n_words, score, rank): documents by the question's words that they have in any form, then by
    density (R01 to R03, R06).

    questions(qid, word), places(id, word, n, w, size). A word stands for its stems with and without accents (see analysed);
    words with the same stems are one, words without stems (stop words) none, and a question without stems has no list.
    Stems of four letters or more also stand for words whose stems they begin; these count for density only. Questions are
    expanded to words of the vocabulary by joins on stems, so postings keep their words and are met once.
    """
    asked = analysed(questions.select("word")).where(F.size("stems") > 0)
    asked = asked.select("word", F.array_join(F.array_sort("stems"), " ").alias("unit"), "stems")
    asked = questions.select("qid", "word").distinct().join(asked, "word").select("qid", "unit", "stems").distinct()
    size = asked.groupBy("qid").agg(F.count("*").alias("n_words"))
    units = asked.select("unit", F.explode("stems").alias("stem")).distinct().withColumn("head", F.left("stem", F.lit(4)))
    known = analysed(places.select("word")).select("word", F.explode("stems").alias("known")).withColumn("head", F.left("known", F.lit(4)))
    same = F.col("stem") == F.col("known")
    match = units.join(known, "head").where(same | (F.length("stem") >= 4) & F.startswith("known", "stem"))
    match = match.groupBy("unit", "word").agg(F.max(F.when(same, F.col("unit"))).alias("covers"))
    words = asked.select("qid", "unit").join(match, "unit").groupBy("qid", "word").agg(F.collect_set("covers").alias("covers"))
    hits = words.join(places, "word").groupBy("qid", "id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("coverage"), F.sum(F.col("n") * F.col("w")).alias("d"), F.max("size").alias("size")
    )
    hits = hits.join(size, "qid").where(F.col("coverage") >= needed(F.col("n_words")))
    d = F.col("d") / F.log(1 + F.greatest(F.col("size"), F.lit(1)))
    scored = hits.select("qid", "id", "coverage", "n_words", (F.col("coverage") + d / (1 + d)).alias("score"))
    return rank_by(scored, "qid", F.col("coverage").desc(), F.round("score", 9).desc(), F.col("id"), k=k)
