"""Searches of catalogues by identifier, by name and by wording, and the sources drawn from them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.documents import PROCEDURE_MENTION
from quarry.functions.domains import EMPTY_FACT_QUESTION, fact_question, fact_shortcuts, generic, weight_question
from quarry.functions.text import ACCENTED, MARKS, PLAIN, article_number, code, fold, procedure, search_form, tokens, truncate
from quarry.operators.matching import first_wins, match_labels
from quarry.operators.retrieval import fielded_search, fuzzy_terms, osa, rank_by

#: An article without more words lists up to so many entries.
MOST_UNFOLDINGS = 30
#: Fewest letters of a passage that are kept at a break, as a share of its length, and the overlap of two passages.
BREAK_SHARE, OVERLAP = 2, 3

# Weights of a procedure's fields, kinds of sources in their order with their longest text.
PROCEDURE_WEIGHTS = {
    "title": 3.0, "execution": 2.0, "sequence": 2.25, "critical": 2.5, "mistakes": 1.75, "material": 1.5, "grounds": 0.75, "annexes": 0.5,
}
SOURCES = {"ctb": 1500, "mbft": 1800, "pop": 1800, "jurisprudencia": 1200, "projeto": 800}


def terms_of(questions: DataFrame) -> DataFrame:
    """(qid, term) of questions(qid, text); questions of negations and numbers only have none."""
    asked = questions.select("qid", F.slice(tokens(F.col("text")), 1, 24).alias("t"))
    return asked.where(~generic(F.col("t"))).select("qid", F.explode("t").alias("term"))


def field_terms(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(id, term, w): the words of weighted text columns, each with its best weight."""

    def weighed(c: str, w: float) -> Column:  # a default argument of the lambda would be taken for the place in the array
        return F.transform(tokens(F.col(c)), lambda x: F.struct(x.alias("term"), F.lit(float(w)).alias("w")))

    made = [weighed(c, w) for c, w in weights.items()]
    every = F.concat(*[F.coalesce(m, F.array().cast("array<struct<term:string,w:double>>")) for m in made])
    flat = rows.select(F.col(key).alias("id"), F.explode(every).alias("f"))
    return flat.groupBy("id", "f.term").agg(F.max("f.w").alias("w"))


def _exact(questions: DataFrame, keys: DataFrame, key: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Entries by identifier with score 100, and the questions that name none: an identifier ends the search."""
    named = questions.select("qid", "text", key.alias("key"))
    hits = named.where("key is not null").join(keys.select("id", "key"), "key").select("qid", "id")
    found = rank_by(hits.distinct(), "qid", F.col("id"), k=k).withColumns({"score": F.lit(100), "method": F.lit("identifier")})
    return found, named.where("key is null").select("qid", "text")


def _by_wording(questions: DataFrame, items: DataFrame, aliases: DataFrame, fields: DataFrame, k: int, least: int = 76, step: int = 3,
                wording: Column | None = None) -> DataFrame:
    """Names first, then wording at 88 less ``step`` per place, 76 at least, without what the names found."""
    named = match_labels(questions, items, aliases, least=least, k=k).select("qid", "id", "score", "method", "rank", F.lit(1).alias("stage"))
    n = items.agg(F.count("*").alias("n")).first().n
    asked = terms_of(questions if wording is None else questions.select("qid", wording.alias("text")))
    worded = fielded_search(asked, fields, n, k=k)
    score = F.greatest(F.lit(76), 88 - step * (F.col("rank") - 1)).cast("long")
    worded = worded.select("qid", "id", score.alias("score"), F.lit("wording").alias("method"), "rank", F.lit(2).alias("stage"))
    return first_wins(named.unionByName(worded), ["qid", "id"], F.col("stage"), F.col("rank"))


def _placed(*lists: DataFrame, k: int) -> DataFrame:
    cols = ["qid", "id", "score", "method", "rank", "stage"]
    whole = None
    for d in lists:
        part = d.select(*[F.col(c) for c in cols])
        whole = part if whole is None else whole.unionByName(part)
    return rank_by(whole.withColumnRenamed("rank", "place"), "qid", F.col("stage"), F.col("place"), F.col("id"), k=k).drop("place", "stage")


def search_sheets(questions: DataFrame, sheets: DataFrame, aliases: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, score, method, rank) of questions(qid, text): by code, by article and clause, by name, by wording.

    sheets(id, label, support, wording): id is the code, support names the article. A code or an article ends the
    search, even where nothing has it; an article alone lists up to 30 entries, one with clauses those that have them all.
    aliases(term, id).
    """
    by_code, rest = _exact(questions, sheets.withColumn("key", F.col("id")), code(F.col("text")), k)
    number = r"art\.?\s*(\d{1,3}(?:-[a-z])?)"
    asked = rest.withColumn("number", article_number(F.col("text")))
    folded = fold(F.col("text"))
    full = F.coalesce(F.nullif(F.regexp_extract(folded, r"\bart(?:igo)?\.?\s*(\d{1,3}-[a-z])\b", 1), F.lit("")), F.col("number"))
    tail = F.regexp_replace(folded, r"^.*?\bart(?:igo)?\.?\s*\d{1,3}(?:-[a-z])?", "")
    clauses = F.filter(F.split(tail, "[^a-z0-9º]+"), lambda x: x.rlike(r"^[ivxlcdm]+$|^\d+º?$"))
    ref = asked.where("number is not null").select("qid", full.alias("number"), clauses.alias("clauses"))
    numbered = sheets.select("id", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("support")), F.lit(number), 1))).alias("number"),
                             F.split(fold(F.col("support")), "[^a-z0-9º]+").alias("parts"))
    hits = ref.join(numbered, "number").where(F.forall("clauses", lambda x: F.array_contains("parts", x)))
    limit = F.when(F.size("clauses") == 0, max(k, MOST_UNFOLDINGS)).otherwise(k)
    by_article = rank_by(hits.withColumn("limit", limit), "qid", F.col("id")).where("rank <= limit")
    by_article = by_article.select("qid", "id", F.lit(100).alias("score"), F.lit("identifier").alias("method"), "rank")
    open_ = asked.where("number is null").select("qid", "text")
    fields = field_terms(sheets, "id", {"label": 3.0, "wording": 1.0})
    worded = _by_wording(open_, sheets.select("id", "label"), aliases, fields, k)
    ended = by_code.unionByName(by_article).withColumn("score", F.col("score").cast("long"))
    return ended.unionByName(_placed(worded, k=k).select(*ended.columns))


def search_procedures(questions: DataFrame, procedures: DataFrame, aliases: DataFrame, k: int = 6) -> DataFrame:
    """(qid, id, score, method, rank): by number, by title, by eight weighted fields.

    procedures(id, title, execution, sequence, critical, mistakes, material, grounds, annexes): id is the number.
    """
    ended, rest = _exact(questions, procedures.withColumn("key", F.col("id")), procedure(F.col("text")), k)
    fields = field_terms(procedures, "id", PROCEDURE_WEIGHTS)
    worded = _by_wording(rest, procedures.select("id", F.col("title").alias("label")), aliases, fields, k)
    ended = ended.withColumn("score", F.col("score").cast("long"))
    return ended.unionByName(_placed(worded, k=k).select(*ended.columns))


def suggest_relaxed(queries: DataFrame, fields: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, points, rank) of queries(qid, term) over fields(id, term, w): the best weights of shared words, summed.

    Only for questions whose search found nothing; shown as suggestions, never as answers.
    """
    best = fields.groupBy("id", "term").agg(F.max("w").alias("w"))
    points = queries.distinct().join(best, "term").groupBy("qid", "id").agg(F.sum("w").alias("points")).where("points > 0")
    return rank_by(points, "qid", F.col("points").desc(), F.col("id"), k=k)


def search_facts(questions: DataFrame, facts: DataFrame, aliases: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, score, method, rank), three at most: shortcuts, names, rewritten wording; the first of them counts.

    facts(id, label, body). Questions that only ask for the list find nothing.
    """
    k = min(3, k)
    asked = questions.where(~F.trim(search_form(F.col("text"))).rlike(EMPTY_FACT_QUESTION) & (F.trim("text") != ""))
    cut = asked.select("qid", F.posexplode(fact_shortcuts(F.col("text"))).alias("rank", "label")).join(facts.select("id", "label"), "label")
    cut = cut.select("qid", "id", F.lit(97).cast("long").alias("score"), F.lit("shortcut").alias("method"), "rank", F.lit(0).alias("stage"))
    fields = field_terms(facts, "id", {"label": 3.0, "body": 1.0})
    worded = _by_wording(asked, facts.select("id", "label"), aliases, fields, k, least=75, step=4, wording=fact_question(F.col("text")))
    once = first_wins(cut.unionByName(worded.select(*cut.columns)), ["qid", "id"], F.col("stage"), F.col("rank"))
    return _placed(once, k=k)


def combine_facts(local: DataFrame, passages: DataFrame, facts: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, origin, rank): the local facts, then those that retrieved passages name, each once.

    local(qid, id, rank), passages(qid, text, rank), facts(id, label). A passage names a fact on its line ``Natureza:``.
    """
    named = F.regexp_extract("text", r"(?im)^Natureza:[ \t]*(.+)$", 1)
    catalogue = facts.select("id", search_form(F.trim("label")).alias("name"))
    found = passages.select("qid", "rank", search_form(F.trim(named)).alias("name")).where("name != ''").join(catalogue, "name")
    both = local.select("qid", "id", F.col("rank").alias("place"), F.lit("local").alias("origin"), F.lit(0).alias("stage")).unionByName(
        found.select("qid", "id", F.col("rank").alias("place"), F.lit("rag").alias("origin"), F.lit(1).alias("stage"))
    )
    once = first_wins(both, ["qid", "id"], F.col("stage"), F.col("place"))
    return rank_by(once, "qid", F.col("stage"), F.col("place"), F.col("id"), k=k).select("qid", "id", "origin", "rank")


def weight_passages(questions: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, score, rank), eight at most: the weight rules' passages for a rewritten question.

    passages(id, reference, document, text): the reference weighs 3, the document 1.2, the text 1.
    """
    asked = terms_of(questions.where(F.trim("text") != "").select("qid", weight_question(F.col("text")).alias("text")))
    n = passages.agg(F.count("*").alias("n")).first().n
    fields = field_terms(passages, "id", {"reference": 3.0, "document": 1.2, "text": 1.0})
    return fielded_search(asked, fields, n, k=min(8, k)).select("qid", "id", "score", "rank")


def windows_of(text: str, limit: int) -> list[tuple[int, int]]:
    """Overlapping windows of at most ``limit`` letters that start and end at breaks where there are any.

    All breaks are found once; windows are searched among their places: a window ends at the last break that it reaches, if
    that is far enough, and the next begins behind the first line feed, else space, of its last part.
    """
    letters = np.array([text]).view(np.uint32)[: len(text)] if text else np.empty(0, np.uint32)
    feeds, every = np.flatnonzero(letters == 10), np.flatnonzero((letters == 10) | (letters == 32))

    def end_of(start: int) -> int:
        reach = start + limit
        at = int(np.searchsorted(every, reach, "right")) - 1
        far = at >= 0 and every[at] - start > limit / BREAK_SHARE
        return len(text) if reach >= len(text) else int(every[at]) if far else reach

    def start_after(start: int, end: int) -> int:
        near = max(start + 1, end - limit // OVERLAP)
        ahead = (places[i] for places in (feeds, every) if (i := np.searchsorted(places, near)) < len(places) and places[i] < end)
        return int(next(ahead, near - 1)) + 1

    out = [(0, end_of(0))]
    while out[-1][1] < len(text):
        start = start_after(*out[-1])
        out.append((start, end_of(start)))
    return out


_FOLD = str.maketrans(ACCENTED, PLAIN, MARKS)


def resembling(term: str, words: list[str]) -> dict[str, float]:
    """How much each word resembles a term: 1 if equal, 0.88 if one begins with the other, else the share of letters left
    unedited; words with digits and short ones resemble only themselves."""
    out = {}
    for w, d in zip(words, osa([term] * len(words), words).tolist()):
        short, size = min(len(term), len(w)), max(len(term), len(w))
        if w == term:
            out[w] = 1.0
        elif short >= 4 and not re.search("[0-9]", term + w):
            out[w] = 0.88 if w.startswith(term) or term.startswith(w) else 1 - d / size
    return out


def best_passage(text: str | None, terms: list[str], limit: int, asked: bool = True) -> str:
    """The window that covers most terms, weighted by how rare they are among the windows; the first one if none does.

    A window must cover half of the terms. Cut ends are marked by an ellipsis.
    """
    text = text or ""
    if len(text) <= limit:
        return text
    spans = windows_of(text, limit) if asked else [(0, limit)]
    best = spans[0]
    if asked and len(terms):
        words = [set(re.findall("[a-z0-9]{3,}", text[a:b].lower().translate(_FOLD))) for a, b in spans]
        known = set().union(*words)
        score, cover = np.zeros(len(spans)), np.zeros(len(spans), int)
        for term in terms:
            near = {w: q for w, q in resembling(term, sorted(known)).items() if q >= (0.8 if term in known else 0.6)}
            value = {w: q * (1 + np.log(1 + len(spans) / (1 + sum(w in s for s in words)))) for w, q in near.items()}
            got = np.array([max((value[w] for w in s & value.keys()), default=0.0) for s in words])
            score, cover = score + got, cover + (got > 0)
        total = score * (0.5 + 0.5 * cover / len(terms))
        fits = (cover >= -(-len(terms) // 2)) & (cover == cover.max()) & (total > 0)
        if fits.any():
            best = spans[int(np.argmax(np.where(fits, total, -1)))]
    return ("…" if best[0] else "") + text[best[0] : best[1]] + ("…" if best[1] < len(text) else "")


def passage(text: Column, question: Column, limit: int = 3500) -> Column:
    """The passage of at most ``limit`` letters that answers a question best (K13). Null counts as empty."""

    def run(texts: pd.Series, terms: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([best_passage(t, list(q), limit, bool(a)) for t, q, a in zip(texts, terms, asked)])

    words = F.coalesce(tokens(question), F.array().cast("array<string>"))
    words = F.when(generic(words), F.array().cast("array<string>")).otherwise(words)
    return F.pandas_udf(run, "string")(text, words, F.coalesce(F.trim(question), F.lit("")) != "")


def section_sources(ranked: DataFrame, sections: DataFrame, questions: DataFrame, procedures: int = 2, k: int = 6) -> DataFrame:
    """(qid, n, id, section, text): sections of the best procedures as numbered sources.

    ranked(qid, id, rank), sections(id, place, section, title, text), questions(qid, text). Up to four sources stay in
    their order; of more the six best by wording, or the first four if no wording is met. Without a question, the first six.
    """
    near = ranked.where(F.col("rank") <= procedures).join(sections.where(F.trim("text") != ""), "id")
    near = near.join(questions.select("qid", F.col("text").alias("question")), "qid", "left")
    w = Window.partitionBy("qid")
    made = near.select(
        "qid", "id", "section", "title", "question", passage(F.col("text"), F.col("question"), 1800).alias("text"),
        F.row_number().over(w.orderBy("rank", "place")).cast("long").alias("pos"), F.count("*").over(w).alias("all"),
    )
    asks = (F.coalesce(F.trim("question"), F.lit("")) != "") & (F.col("all") > 4)
    pool = made.where(asks).select("qid", "pos", F.concat_ws(" ", "title", "section").alias("head"), "text", F.concat_ws(":", "qid", "pos").alias("key"))
    fields = field_terms(pool, "key", {"head": 3.0, "text": 1.0})
    asked = terms_of(questions.join(pool.select("qid").distinct(), "qid", "left_semi"))
    own = fields.withColumn("qid", F.split_part("id", F.lit(":"), F.lit(1)).cast(dict(questions.dtypes)["qid"]))
    terms = asked.groupBy("qid").agg(F.count("*").alias("n"))
    match = fuzzy_terms(asked.select("term"), own.select("term")).withColumnRenamed("word", "_w")
    hits = asked.join(match, "term").join(own.withColumnRenamed("term", "_w"), ["qid", "_w"])
    df = own.groupBy("qid", "term").agg(F.count("*").alias("df")).withColumnRenamed("term", "_w")
    size = pool.groupBy("qid").agg(F.count("*").alias("docs"))
    value = F.col("quality") * F.col("w") * (1 + F.log(1 + F.col("docs") / (1 + F.col("df"))))
    per = hits.join(df, ["qid", "_w"]).join(size, "qid").groupBy("qid", "id", "term").agg(F.max(value).alias("s"))
    per = per.groupBy("qid", "id").agg(F.sum("s").alias("s"), F.count("*").alias("c")).join(terms, "qid").where(F.col("c") >= F.ceil(F.col("n") / 2))
    per = per.withColumns({"score": F.col("s") * (0.5 + 0.5 * F.col("c") / F.col("n")), "top": F.max("c").over(w)}).where("c = top")
    per = per.withColumn("high", F.max("score").over(w)).where("score >= 0.45 * high")
    chosen = rank_by(per, "qid", F.round("score", 9).desc(), F.col("id"), k=k).select("qid", F.split_part("id", F.lit(":"), F.lit(-1)).cast("long").alias("pos"), F.col("rank").alias("n"))
    worded = made.join(chosen, ["qid", "pos"], "left").withColumn("any", F.max("n").over(w))
    n = F.when(F.col("any").isNotNull(), F.col("n")).when(asks, F.when(F.col("pos") <= 4, F.col("pos"))).otherwise(F.when(F.col("pos") <= k, F.col("pos")))
    return worded.withColumn("n", n.cast("long")).where("n is not null").select("qid", "n", "id", "section", "text")


def number_sources(lists: dict[str, DataFrame]) -> DataFrame:
    """(qid, n, kind, title, text, link): sources of five kinds in their fixed order, cut to the kind's length.

    Each list has (qid, place, title, text, link).
    """
    whole = None
    for k, (kind, longest) in enumerate(SOURCES.items()):
        if kind in lists:
            part = lists[kind].select(
                "qid", F.lit(k).alias("_k"), "place", F.lit(kind).alias("kind"), "title", truncate(F.col("text"), longest).alias("text"), "link"
            )
            whole = part if whole is None else whole.unionByName(part)
    n = F.row_number().over(Window.partitionBy("qid").orderBy("_k", "place", "title"))
    return whole.withColumn("n", n).select("qid", "n", "kind", "title", "text", "link")


def compare_sheets(sheets: DataFrame, code_col: str, longest: int = 360) -> DataFrame:
    """Comparison table of sheets: the columns that differ between codes, the scene to fine in short (C20)."""
    scene = F.coalesce(F.get("to_fine", F.lit(0)), F.col("typification"))
    return sheets.select(
        F.col(code_col).alias("code"), "wording", "support", "severity", "points", "penalty", "measure", truncate(scene, longest).alias("to_fine")
    )


def widen(principal: DataFrame, asked: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, rank): the principal candidates, then entries that cover nearly as many words as any does.

    principal(qid, id, rank), asked(qid, term), words(id, term). A word is covered by one of similarity 0.8 or more; an
    entry must cover one word less than the best one, and two at least.
    """
    match = fuzzy_terms(asked.select("term"), words.select("term")).where("quality >= 0.8").select("term", "word")
    cover = asked.distinct().join(match, "term").join(words.distinct().withColumnRenamed("term", "word"), "word")
    cover = cover.groupBy("qid", "id").agg(F.countDistinct("term").alias("n"))
    best = F.max("n").over(Window.partitionBy("qid"))
    more = cover.withColumn("best", best).where(F.col("n") >= F.greatest(F.lit(2), F.col("best") - 1))
    both = principal.select("qid", "id", F.lit(0).alias("stage"), F.col("rank").cast("long").alias("place")).unionByName(
        more.select("qid", "id", F.lit(1).alias("stage"), (-F.col("n")).alias("place"))
    )
    once = first_wins(both, ["qid", "id"], F.col("stage"), F.col("place"))
    return rank_by(once, "qid", F.col("stage"), F.col("place"), F.col("id"), k=k).select("qid", "id", "rank")


def linked_mentions(texts: DataFrame, key: str, text: str, catalogue: DataFrame) -> DataFrame:
    """(key, pos, kind, text, number, title): a text cut at the procedures it names that the catalogue has.

    catalogue(number, title). Mentions of unknown numbers stay text; a text without mentions is one piece.
    """
    ends = F.split(F.col(text), PROCEDURE_MENTION, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(PROCEDURE_MENTION), 0)
    numbers = F.regexp_extract_all(F.col(text), F.lit(PROCEDURE_MENTION), 1)
    plain = F.transform(ends, lambda x, i: F.struct((2 * i).alias("pos"), x.alias("piece"), F.lit(None).cast("string").alias("number")))
    named = F.transform(F.arrays_zip(found.alias("f"), numbers.alias("n")), lambda x, i: F.struct((2 * i + 1).alias("pos"), x["f"].alias("piece"), x["n"].alias("number")))
    rows = texts.select(key, F.explode(F.concat(plain, named)).alias("p")).select(key, "p.*")
    rows = rows.join(catalogue.select("number", "title"), "number", "left")
    w = Window.partitionBy(key).orderBy("pos")
    run = F.sum(F.col("title").isNotNull().cast("int") + F.lag(F.col("title").isNotNull().cast("int"), 1, 0).over(w)).over(w)
    parts = rows.withColumn("run", run)
    # a mention has a run of its own: it adds one, and what follows adds one more
    whole = parts.groupBy(key, "run").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "piece")))["piece"], "").alias("text"),
        F.max("number").alias("_n"), F.max("title").alias("title"), F.min("pos").alias("pos"),
    )
    known = F.col("title").isNotNull()
    whole = whole.withColumn("pieces", F.count("*").over(Window.partitionBy(key)))
    return whole.where((F.col("text") != "") | (F.col("pieces") == 1)).select(
        key, "pos", F.when(known, "reference").otherwise("text").alias("kind"), "text", F.when(known, F.col("_n")).alias("number"), "title"
    )
