"""Matching of free questions with catalogues of labels, aliases, keys and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import fold, match_form
from quarry.operators.retrieval import deletion_forms, osa_distance, prefix_terms, rank_by

#: Two words are alike from this similarity on; so many of the words of the shorter side must have one that is.
ALIKE, SHARE = 0.72, 0.7

# Words that don't count in labels and in passages.
LINK_WORDS = "a ao aos as com da das de do dos e em na nas no nos o ou para por um uma".split()
PASSAGE_STOP = "a ao aos as com da das de do dos e em no nos o os para por que um uma".split()


def label_words(form: Column) -> Column:
    """The words of a match form that count, repeats included."""
    return F.filter(F.split(form, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LINK_WORDS))


def word_similarity(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with s (K09): 1 if equal, 0 with digits or below four letters, 0.88 for a prefix, else the share of
    letters left unedited."""
    a, b = F.col("a"), F.col("b")
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    s = F.when(a == b, 1.0).when(a.rlike(r"\d") | b.rlike(r"\d") | (shorter < 4), 0.0).when(F.startswith(a, b) | F.startswith(b, a), 0.88)
    edited = 1 - F.col("_d") / longer
    return pairs.withColumn("_d", osa_distance("a", "b")).withColumn("s", s.otherwise(F.greatest(edited, F.lit(0.0)))).drop("_d")


def alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): pairs of words of left(word) and right(word) of at least ALIKE similarity, without comparing all pairs.

    Equal words and prefixes meet in equi joins. Of others, 28 % of the longer one's letters may be edited: up to ten
    letters that is two at most, and both leave a common form after as many deletions; from eleven on both share a pair of
    neighbouring letters, as one edit spoils three at most.
    """
    a = left.select(F.col("word").alias("a")).distinct()
    b = right.select(F.col("word").alias("b")).distinct()
    equal = a.join(b, F.col("a") == F.col("b"))
    plain = lambda c: (F.length(c) >= 4) & ~F.col(c).rlike(r"\d")
    a, b = a.where(plain("a")), b.where(plain("b"))
    ahead = prefix_terms(a.withColumnRenamed("a", "term"), b.withColumnRenamed("b", "word")).select(F.col("term").alias("a"), F.col("word").alias("b"))
    behind = prefix_terms(b.withColumnRenamed("b", "term"), a.withColumnRenamed("a", "word")).select(F.col("word").alias("a"), F.col("term").alias("b"))

    def forms(words: DataFrame, c: str) -> DataFrame:
        return words.where(F.length(c) <= 10).select(c, F.explode(deletion_forms(F.col(c), F.length(c) >= 6)).alias("key"))

    def neighbours(words: DataFrame, c: str) -> DataFrame:
        two = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
        return words.where(F.length(c) >= 8).select(c, F.explode(F.array_distinct(two)).alias("key"))

    longer = F.greatest(F.length("a"), F.length("b"))
    near = forms(a, "a").join(forms(b, "b"), "key").select("a", "b")
    far = neighbours(a, "a").join(neighbours(b, "b"), "key").where((longer >= 11) & (F.abs(F.length("a") - F.length("b")) <= 0.28 * longer)).select("a", "b")
    close = word_similarity(near.unionByName(far).distinct()).where(F.col("s") >= ALIKE).select("a", "b")
    return equal.unionByName(ahead).unionByName(behind).unionByName(close).distinct()


def phrase_similarity(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, eid, s): pairs of asked(qid, words) and entries(eid, words) whose words resemble each other, s from 0 to 94.

    The side with fewer words, the question if they are even, is the base: SHARE of its words must have one that is alike
    on the other side, and s is the mean of their best similarities in percent. Pairs come from words that are alike; only
    those that reach the share are scored in full.
    """
    q = asked.select("qid", F.size("words").alias("nq"), F.posexplode("words").alias("qp", "a"))
    e = entries.select("eid", F.size("words").alias("ne"), F.posexplode("words").alias("ep", "b"))
    close = alike(q.select(F.col("a").alias("word")), e.select(F.col("b").alias("word")))
    met = q.join(close, "a").join(e, "b").groupBy("qid", "eid").agg(
        F.max("nq").alias("nq"), F.max("ne").alias("ne"), F.countDistinct("qp").alias("cq"), F.countDistinct("ep").alias("ce")
    )
    base_q = F.col("nq") <= F.col("ne")
    enough = F.when(base_q, F.col("cq") >= SHARE * F.col("nq")).otherwise(F.col("ce") >= SHARE * F.col("ne"))
    pairs = met.where(enough).select("qid", "eid", base_q.alias("base_q"))
    cells = pairs.join(q.select("qid", "qp", "a"), "qid").join(e.select("eid", "ep", "b"), "eid")
    known = word_similarity(cells.select("a", "b").distinct())
    place = F.when(F.col("base_q"), F.col("qp")).otherwise(F.col("ep"))
    best = cells.join(known, ["a", "b"]).groupBy("qid", "eid", place.alias("p")).agg(F.max("s").alias("s"))
    mean = best.groupBy("qid", "eid").agg(F.avg("s").alias("s"))
    return mean.select("qid", "eid", F.least(F.lit(94), F.floor(F.col("s") * 100 + 0.5)).alias("s"))


def match_labels(questions: DataFrame, items: DataFrame, aliases: DataFrame, least: int = 78, k: int = 3) -> DataFrame:
    """(qid, id, score, method, rank): items that a question names by label or alias, typos included.

    questions(qid, text), items(id, label), aliases(term, id). An alias that stands in the question scores 98, one that
    resembles it two more than their similarity, 97 at most, a label its similarity, or 100 if it is the question; of
    several the best counts. Questions without a word that counts match exact aliases only. Questions of one form are
    matched once.
    """
    named = items.select("id", match_form("label").alias("form"), F.lit(False).alias("alias"))
    known = aliases.join(items.select("id"), "id", "left_semi").select("id", match_form("term").alias("form"), F.lit(True).alias("alias"))
    entries = named.unionByName(known).where("form != ''").distinct().withColumn("words", label_words(F.col("form")))
    entries = entries.withColumn("eid", F.xxhash64("form"))
    named_forms = questions.select(F.col("qid").alias("_q"), match_form("text").alias("form")).where("form != ''")
    asked = named_forms.select("form").distinct().withColumns({"words": label_words(F.col("form")), "qid": F.col("form")})
    longest = entries.where("alias").agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    runs = asked.select("qid", F.explode(word_runs(F.col("form"), longest)).alias("form"))
    exact = runs.join(entries.where("alias").select("form", "id"), "form").select("qid", "id", F.lit(98).cast("long").alias("score"), F.lit("exact alias").alias("method"))
    clear = asked.where((F.size("words") > 1) | (F.length(F.get("words", F.lit(0))) >= 4))
    same = clear.join(entries.where("not alias").select("form", "id"), "form").select("qid", "id", F.lit(100).cast("long").alias("score"), F.lit("label").alias("method"))
    like = phrase_similarity(clear, entries.select("eid", "words").where("size(words) > 0").distinct()).join(entries.select("eid", "id", "alias"), "eid")
    score = F.when(F.col("alias"), F.least(F.lit(97), F.col("s") + 2)).otherwise(F.col("s")).cast("long")
    like = like.select("qid", "id", score.alias("score"), F.when(F.col("alias"), "fuzzy alias").otherwise("label").alias("method"))
    found = exact.unionByName(same).unionByName(like).where(F.col("score") >= least)
    best = found.groupBy("qid", "id").agg(F.max(F.struct("score", "method")).alias("m"))
    labels = items.groupBy("id").agg(F.min("label").alias("label"))
    out = best.join(labels, "id").select("qid", "id", "m.score", "m.method", "label")
    ranked = rank_by(out, "qid", F.col("score").desc(), F.col("label"), F.col("id"), k=k)
    return named_forms.join(ranked.withColumnRenamed("qid", "form"), "form").select(F.col("_q").alias("qid"), "id", "score", "method", "label", "rank")


def word_runs(form: Column, longest: int = 5) -> Column:
    """Distinct runs of one to ``longest`` words of a match form."""
    words = F.split(form, " ")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in range(1, longest + 1)]))))


def longest_key(questions: DataFrame, keys: DataFrame, longest: int = 5) -> DataFrame:
    """(qid, id, key): the entry whose key stands in the question as whole words; the longest key wins, then the id.

    keys(id, key); keys of three letters or fewer must be the whole question. An equi join on runs of words.
    """
    asked = questions.select("qid", match_form("text").alias("form")).where("form != ''")
    runs = asked.select("qid", "form", F.explode(word_runs(F.col("form"), longest)).alias("key"))
    known = keys.select("id", match_form("key").alias("key")).where("key != ''").distinct()
    hits = runs.join(known, "key").where((F.length("key") > 3) | (F.col("key") == F.col("form")))
    return rank_by(hits, "qid", F.length("key").desc(), F.col("id"), k=1).select("qid", "id", "key")


def score_passages(questions: DataFrame, passages: DataFrame, k: int = 4) -> DataFrame:
    """(qid, id, score, rank): 100 for the article asked for, 10 per covered term, 20 for the whole question.

    questions(qid, text), passages(id, label, text). Candidates come from equi joins on terms and on article numbers; a
    term counts as covered where it is a word of the passage.
    """
    stop = F.array(*map(F.lit, PASSAGE_STOP))

    def terms(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(match_form(c), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))

    def article(c: Column) -> Column:
        return F.nullif(F.regexp_extract(fold(c), r"\bart(?:igo)?\s*\.?\s*(\d+)", 1), F.lit(""))

    q = questions.select("qid", fold(F.col("text")).alias("q"), F.explode(terms(F.col("text"))).alias("term"))
    both = F.concat_ws(" ", "label", "text")
    p = passages.select("id", F.explode(terms(both)).alias("term"))
    cover = q.join(p, "term").groupBy("qid", "id").agg(F.count("*").alias("n"))
    named = questions.select("qid", article(F.col("text")).alias("a")).join(passages.select("id", article(F.col("label")).alias("a")), "a")
    hits = cover.join(named.select("qid", "id", F.lit(100).alias("exact")), ["qid", "id"], "full_outer")
    whole = hits.join(questions.select("qid", fold(F.col("text")).alias("q")), "qid").join(passages.select("id", fold(both).alias("c")), "id")
    score = F.coalesce("exact", F.lit(0)) + 10 * F.coalesce("n", F.lit(0)) + F.when(F.contains("c", "q"), 20).otherwise(0)
    return rank_by(whole.select("qid", "id", score.alias("score")), "qid", F.col("score").desc(), F.col("id"), k=k)


def first_wins(lists: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in order (O04, K17, K18, K20, K21: lists of falling trust with a priority column)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return lists.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cascade(*lists: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, score, stage, rank) of ranked lists(qid, id, score), the most trusted first.

    A question with rows in the first list gets those only (an exact code ends the search); the later lists are united,
    and an item keeps the score of the first list that has it.
    """
    tagged = [d.select("qid", "id", F.col("score").cast("double").alias("score"), F.lit(i).alias("stage")) for i, d in enumerate(lists)]
    rest = tagged[1]
    for d in tagged[2:]:
        rest = rest.unionByName(d)
    rest = rest.join(tagged[0].select("qid").distinct(), "qid", "left_anti")
    once = first_wins(tagged[0].unionByName(rest), ["qid", "id"], F.col("stage"), F.col("score").desc())
    return rank_by(once, "qid", F.col("score").desc(), F.col("stage"), F.col("id"), k=k)


def suggest(prefixes: DataFrame, entries: DataFrame, least: int = 3, k: int = 5) -> DataFrame:
    """(qid, id, rank): entries(id, name) whose name starts with what was typed, from ``least`` letters on.

    Names meet the typed text by equal first ``least`` letters, then by the whole prefix.
    """
    q = prefixes.select("qid", match_form("text").alias("q")).where(F.length("q") >= least).withColumn("_k", F.left("q", F.lit(least)))
    e = entries.select("id", match_form("name").alias("name")).withColumn("_k", F.left("name", F.lit(least)))
    hits = q.join(e, "_k").where(F.startswith("name", "q"))
    return rank_by(first_wins(hits, ["qid", "name"], F.col("id")), "qid", F.length("name"), F.col("name"), F.col("id"), k=k).select("qid", "id", "rank")


def apply_order(ranked: DataFrame, order: DataFrame) -> DataFrame:
    """ranked(qid, id, rank) in the order that order(qid, ids) gives: its ids first, the others after them.

    An order with an unknown or repeated id, or none, leaves its question's list as it is.
    """
    given = order.select("qid", F.posexplode("ids").alias("pos", "id"))
    checked = given.join(ranked.select("qid", "id", F.lit(1).alias("known")), ["qid", "id"], "left")
    good = checked.groupBy("qid").agg(F.sum("known").alias("n"), F.count("*").alias("all"), F.countDistinct("id").alias("kinds"))
    good = good.where("n = all and kinds = all").select("qid")
    placed = ranked.join(given.join(good, "qid", "left_semi"), ["qid", "id"], "left").withColumnRenamed("rank", "was")
    return rank_by(placed, "qid", F.col("pos").asc_nulls_last(), F.col("was")).drop("pos", "was")
