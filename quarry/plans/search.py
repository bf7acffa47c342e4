"""Retrieval queries: benchmark items ask the documents, every 50th vector asks the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import STOP_WORDS
from quarry.operators import retrieval as R
from quarry.operators.catalogues import field_terms
from quarry.operators.quality import ranking_metrics
from quarry.plans.base import Tables, query
from quarry.plans.scalar import FOLD


def doc_posts(t: Tables) -> DataFrame:
    return R.postings(t.documents, "doc_id", "text")


def doc_places(t: Tables, *keep: str) -> DataFrame:
    return R.positions(t.documents, "doc_id", "text", *keep)


def questions(t: Tables) -> DataFrame:
    """(qid, term): every word of three letters or more of the benchmark's items."""
    return R.postings(t.benchmark, "item_id", "text").withColumnRenamed("id", "qid")


TERMS = "list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda w: len(w) >= 3)".format(FOLD)
POSTS = f"SELECT doc_id AS id, unnest(list_distinct({TERMS})) AS term FROM documents"
ASKED = f"SELECT item_id AS qid, unnest(list_distinct({TERMS})) AS term FROM benchmark"
PLACES = (
    f"p00 AS MATERIALIZED (SELECT doc_id AS id, source, lang, {TERMS} AS terms, len({TERMS}) AS size FROM documents),"
    " p0 AS (SELECT id, source, lang, size, unnest(terms) AS term FROM p00),"
    " p AS MATERIALIZED (SELECT id, source, lang, term, size, count(*) AS n FROM p0 GROUP BY ALL)"
)


def lex_sql(condition: str = "TRUE", asked: str = ASKED) -> str:
    """CTEs q (asked words) and lex (the ranked list), over p (places); ``condition`` ties questions and documents."""
    return (
        f"{PLACES}, q AS ({asked}), n AS (SELECT qid, count(DISTINCT term) AS n FROM q GROUP BY qid), v AS (SELECT DISTINCT term FROM p),"
        " x AS (SELECT DISTINCT q.*, q.term AS word, 1 AS exact FROM q UNION ALL"
        " SELECT DISTINCT q.*, u.term, 0 FROM q JOIN (SELECT term, left(term, i) AS head FROM (SELECT term, unnest(range(4, length(term))) AS i FROM v)) u ON u.head = q.term),"
        " y AS MATERIALIZED (SELECT x.* EXCLUDE (term, exact), max(exact) AS exact FROM x GROUP BY ALL),"
        f" h AS (SELECT y.qid, p.id, sum(y.exact) AS coverage, sum(p.n) / ln(1 + max(p.size)) AS d FROM y JOIN p ON p.term = y.word AND {condition} GROUP BY ALL),"
        " lex AS (SELECT qid, id, coverage, n, coverage + d / (1 + d) AS score,"
        " row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, round(coverage + d / (1 + d), 9) DESC, id) AS rank FROM h JOIN n USING (qid)"
        " WHERE coverage >= CASE WHEN n >= 3 THEN 2 ELSE 1 END QUALIFY rank <= 10)"
    )


LEX = lex_sql()
VEC = (
    "v0 AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),"
    " vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, id) AS rank FROM v0 WHERE similarity >= 0.35 QUALIFY rank <= 10)"
)


def lexical(t: Tables) -> DataFrame:
    return R.lexical_search(questions(t), t.documents, "doc_id", "text")


def vector(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.vector_topk(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), v)


@query("r05_postings", f"WITH p AS ({POSTS}) SELECT id, count(*) AS terms, md5(string_agg(term, ' ' ORDER BY term)) AS all_terms FROM p GROUP BY id")
def r05(t: Tables) -> DataFrame:
    all_terms = F.md5(F.array_join(F.sort_array(F.collect_list("term")), " "))
    return doc_posts(t).groupBy("id").agg(F.count("*").alias("terms"), all_terms.alias("all_terms"))


@query(
    "a19_idf",
    f"WITH p AS ({POSTS}), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(1 + ln(1 + any_value(n) / (1 + count(*))), 6) AS idf FROM p, n GROUP BY term",
)
def a19(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count("*").alias("n"))
    v = R.vocabulary(doc_posts(t)).crossJoin(F.broadcast(n))  # one row
    return v.select("term", "df", F.round(1 + F.log(1 + F.col("n") / (1 + F.col("df"))), 6).alias("idf"))


@query("r06_lexical_topk", f"WITH {LEX} SELECT qid, id, coverage, round(score, 6) AS score, rank FROM lex")
def r06(t: Tables) -> DataFrame:
    return lexical(t).select("qid", "id", "coverage", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r04_prefix_terms", f"WITH p AS ({POSTS}), q AS ({ASKED}), v AS (SELECT DISTINCT term FROM p) SELECT DISTINCT q.term, v.term AS word FROM q JOIN v"
       " ON length(q.term) >= 4 AND length(v.term) > length(q.term) AND starts_with(v.term, q.term)")  # fmt: skip
def r04(t: Tables) -> DataFrame:
    return R.prefix_terms(questions(t), doc_posts(t).withColumnRenamed("term", "word"))


COLLECTION = "CASE item_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END"


@query(
    "r07_lexical_collection",
    f"WITH {lex_sql('p.lang = y.lang', f'SELECT item_id AS qid, {COLLECTION} AS lang, unnest(list_distinct({TERMS})) AS term FROM benchmark')} SELECT qid, id, coverage, rank FROM lex",
)
def r07(t: Tables) -> DataFrame:
    asked = R.postings(t.benchmark.withColumn("lang", F.expr(COLLECTION)), "item_id", "text", "lang").withColumnRenamed("id", "qid")
    out = R.lexical_search(asked, t.documents, "doc_id", "text", by="lang")
    return out.select("qid", "id", "coverage", F.col("rank").cast("long").alias("rank"))


@query(
    "r10_vector_collection",
    "WITH v AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0)"
    " SELECT qid, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, id) AS rank FROM v WHERE similarity >= 0.35 QUALIFY rank <= 10",
)
def r10(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    out = R.vector_topk(v.where("id % 50 = 0").withColumnRenamed("id", "qid"), v, by="label")
    return out.select("qid", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r09_vector_topk", f"WITH {VEC} SELECT qid, id, round(similarity, 6) AS similarity, rank FROM vec")
def r09(t: Tables) -> DataFrame:
    return vector(t).select("qid", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


# documents are titled by their first sentence; questions are the first sentences of every 50th document, and of these, by
# turns, the whole title, its first half, and its words the other way round
FIRST = "trim(split_part(text, '.', 1))"
TITLE_ASKED = f"CASE doc_id // 50 % 3 WHEN 0 THEN {FIRST} WHEN 1 THEN left({FIRST}, 1 + length({FIRST}) // 2) ELSE array_to_string(list_reverse(string_split({FIRST}, ' ')), ' ') END"
FOLDED = f"trim({FOLD.replace('text', 'title')})"


@query(
    "r12_catalogue",
    f"WITH t AS (SELECT id, {FOLDED} AS title FROM (SELECT doc_id AS id, {FIRST} AS title FROM documents)), q AS (SELECT qid, {FOLDED} AS q FROM (SELECT doc_id AS qid, {TITLE_ASKED} AS title FROM documents WHERE doc_id % 50 = 0)),"
    " w AS (SELECT id, title, list_distinct(list_filter(regexp_split_to_array(title, '[^a-z0-9]+'), lambda w: len(w) >= 3)) AS words FROM t WHERE title <> ''),"
    " a AS (SELECT qid, q, list_distinct(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: len(w) >= 3)) AS words FROM q WHERE q <> ''),"
    " m AS (SELECT qid, id, CASE WHEN title = q THEN 300.0 WHEN starts_with(title, q) THEN 200.0 ELSE 100.0 END AS score FROM a, w"
    " WHERE starts_with(title, q) OR (len(a.words) > 0 AND list_has_all(w.words, a.words)))"
    " SELECT qid, id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 30",
)
def r12(t: Tables) -> DataFrame:
    first = F.trim(F.split_part("text", F.lit("."), F.lit(1)))
    kind = F.floor(F.col("doc_id") / 50) % 3
    asked = F.when(kind == 0, first).when(kind == 1, F.left(first, (1 + F.floor(F.length(first) / 2)).cast("int"))).otherwise(F.array_join(F.reverse(F.split(first, " ")), " "))
    q = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), asked.alias("text"))
    titles = t.documents.select(F.col("doc_id").alias("id"), first.alias("title"))
    none = t.spark.createDataFrame([], "qid bigint, id bigint, score double")
    return R.catalogue_topk(q, titles, none).withColumn("rank", F.col("rank").cast("long"))


@query(
    "r13_max_page",
    "SELECT l_orderkey AS id, max(p) AS pages FROM (SELECT l_orderkey, max(l_linenumber) AS p FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 3 FROM orders) GROUP BY 1",
)
def r13(t: Tables) -> DataFrame:
    n = dict(t.lineitem.dtypes)["l_linenumber"]
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("p"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(3).cast(n).alias("p"))
    return a.unionByName(b).groupBy("id").agg(F.max("p").alias("pages"))


# A question's vector is the one of its number, and a document's likewise.
LISTS = (
    f"{LEX}, w AS (SELECT item_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM benchmark JOIN embeddings a ON a.vec_id = item_id, embeddings b),"
    " two AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, id) AS rank FROM w WHERE similarity >= 0.35 QUALIFY rank <= 10)"
)


def second(t: Tables) -> DataFrame:
    """The list by vectors."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.join(t.benchmark.select(F.col("item_id").alias("id")), "id", "left_semi")
    return R.vector_topk(asked.withColumnRenamed("id", "qid"), v).select("qid", "id", "rank")


@query(
    "k01_rrf",
    f"WITH {LISTS}, u AS (SELECT qid, id, rank FROM lex UNION ALL SELECT * FROM two) SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL",
)
def k01(t: Tables) -> DataFrame:
    lists = lexical(t).select("qid", "id", "rank").unionByName(second(t))
    return R.rrf(lists).select("qid", "id", F.round("score", 9).alias("score"))


@query(
    "k02_weighted_rrf",
    f"WITH {LISTS}, u AS (SELECT qid, id, rank, 0.7 AS w FROM lex UNION ALL SELECT *, 0.3 FROM two) SELECT qid, id, round(sum(w::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL",
)
def k02(t: Tables) -> DataFrame:
    lists = lexical(t).select("qid", "id", "rank", F.lit(0.7).alias("w")).unionByName(second(t).withColumn("w", F.lit(0.3)))
    return R.rrf(lists, weight=F.col("w")).select("qid", "id", F.round("score", 9).alias("score"))


# A document that begins as the question does is what it names; one in English is of the kind asked for.
RERANK = (
    f"{LISTS}, j AS (SELECT qid, id, coverage, n, l.rank AS lex, r.rank AS vec FROM lex l FULL JOIN two r USING (qid, id)),"
    " g AS (SELECT item_id AS qid, doc_id AS id, left(b.text, 24) = left(d.text, 24) AS exact, d.lang = 'en' AS typed FROM benchmark b, documents d WHERE left(b.text, 24) = left(d.text, 24) OR d.lang = 'en'),"
    " s AS (SELECT qid, id, CASE WHEN exact THEN 100 ELSE 0 END + 2 * coalesce(coverage / n, 0) + coalesce(0.8 / lex, 0) + coalesce(0.5 / vec, 0)"
    " + CASE WHEN typed THEN 1.2 ELSE 0 END + 0.25 AS score FROM j LEFT JOIN g USING (qid, id)),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)"
)


def reranked(t: Tables) -> DataFrame:
    lex, vec = lexical(t), second(t)
    head = F.left("text", F.lit(24))
    asked = t.benchmark.select(F.col("item_id").alias("qid"), head.alias("q"))
    docs = t.documents.select(F.col("doc_id").alias("id"), head.alias("d"), "lang")

    def signals(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked, "qid", "left").join(docs, "id", "left")
        return both.withColumns({"exact": F.col("q") == F.col("d"), "typed": F.col("lang") == "en"})

    return R.rerank(lex, vec, signals)


@query("k04_rerank", f"WITH {RERANK} SELECT qid, id, round(score, 9) AS score, rank FROM r")
def k04(t: Tables) -> DataFrame:
    return reranked(t).select("qid", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "k06_ambiguous",
    f"WITH {RERANK}, gap AS (SELECT qid, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM r GROUP BY qid)"
    " SELECT qid, round(a - b, 9) AS gap, coalesce(round(a - b, 9) <= 0.05, false) AS ambiguous FROM gap",
)
def k06(t: Tables) -> DataFrame:
    return R.ambiguous(reranked(t)).select("qid", F.round("gap", 9).alias("gap"), "ambiguous")


@query("k10_fuzzy_search")
def k10(t: Tables) -> DataFrame:
    asked = R.postings(t.benchmark, "item_id", "text").withColumnRenamed("id", "qid")  # every word of three letters or more
    out = R.fuzzy_documents(asked, t.documents, "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"))
    return out.select("qid", "id", "coverage", F.round("score", 6).alias("score"), "rank")


#: Titles of the catalogue, by turns, and the phrases that questions end with.
NAMED = ("Motocicleta nova", "Motoneta e ciclomotor", "Acidente de trânsito", "Telefone celular", "Disputa de corrida", "Veículo parado", "Automóvel azul", "Certificado de Licenciamento")
PHRASES = ("moto", "batida de carro", "celular", "racha", "documento do carro", "carro com zap", "batda acidentes", "sem 12")
#: Groups of words that the phrases stand for, and the folded words that stand alone.
CONCEPTS = (
    "[[['moto'], ['motocicleta'], ['motoneta'], ['ciclomotor']]]", "[[['batida', 'carro'], ['acidente', 'transito']]]", "[[['celular'], ['telefone', 'celular']]]",
    "[[['racha'], ['disputa', 'corrida'], ['competicao']]]", "[[['documento', 'carro'], ['certificado', 'licenciamento'], ['crlv'], ['licenciamento']]]",
    "[[['carro'], ['automovel'], ['veiculo']], [['zap'], ['telefone', 'celular']]]", "[]", "[]",
)
ALONE = ("[]", "[]", "[]", "[]", "[]", "[]", "['batda', 'acidentes']", "['sem']")
TOKENS = f"list_distinct(list_filter(regexp_split_to_array({FOLD}, '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})))"
CASES = lambda key, options: f"CASE {key} % {len(options)} " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options)) + " END"
TITLED = CASES("doc_id", [f"'{n}'" for n in NAMED])


@query(
    "k10_concepts",
    f"WITH b AS (SELECT doc_id AS id, {TOKENS} AS body, {TOKENS.replace('text', TITLED)} AS head FROM documents), nn AS (SELECT count(*) AS nn FROM documents),"
    " fields AS MATERIALIZED (SELECT id, term, max(w) AS w FROM (SELECT id, unnest(head) AS term, 3.0 AS w FROM b UNION ALL SELECT id, unnest(body), 1.0 FROM b) GROUP BY ALL),"
    f" q0 AS (SELECT item_id AS qid, list_concat({TOKENS.removeprefix('list_distinct(').removesuffix(')').replace('text', FIRST)}, {CASES('item_id', ALONE)}) AS words, {CASES('item_id', CONCEPTS)}::VARCHAR[][][] AS more FROM benchmark),"
    " g0 AS (SELECT qid, list_concat(list_transform(list_filter(words, lambda x, i: list_position(words, x) = i), lambda t: [[t]]), more)[:24] AS gs FROM q0),"
    " g1 AS (SELECT qid, grp, gs[grp] AS alts FROM (SELECT qid, gs, unnest(range(1, len(gs) + 1)) AS grp FROM g0)),"
    " groups AS MATERIALIZED (SELECT qid, grp, alt, unnest(alts[alt]) AS term, len(alts[alt]) AS words FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS alt FROM g1)),"
    " v AS MATERIALIZED (SELECT term AS word, count(*) AS df FROM fields GROUP BY 1), t AS MATERIALIZED (SELECT DISTINCT term FROM groups),"
    f" root AS (SELECT word, df, CASE WHEN length(word) >= 7 THEN regexp_replace(word, '{R.VERB_ENDINGS}', '') ELSE word END AS r FROM v),"
    f" ask AS (SELECT term, term IN (SELECT word FROM v) AS known, CASE WHEN length(term) >= 7 THEN regexp_replace(term, '{R.VERB_ENDINGS}', '') ELSE term END AS r FROM t),"
    " m0 AS (SELECT term, word, df, CASE WHEN term = word THEN 1.0 WHEN regexp_matches(term || word, '[0-9]') THEN 0 WHEN length(term) >= 4 AND starts_with(word, term) THEN 0.88"
    " WHEN length(term) >= 5 AND length(word) >= 5 AND ask.r = root.r THEN 0.86 WHEN known OR length(term) < 5 OR length(word) < 5 OR abs(length(term) - length(word)) > 2 THEN 0"
    " ELSE CASE damerau_levenshtein(term, word) WHEN 1 THEN 0.72 WHEN 2 THEN CASE WHEN length(term) >= 9 AND length(word) >= 9 THEN 0.6 ELSE 0 END ELSE 0 END END AS quality FROM ask, root),"
    " m AS MATERIALIZED (SELECT term, word, quality * (1 + ln(1 + nn / (1 + df))) AS value FROM m0, nn WHERE quality > 0),"
    " p1 AS (SELECT qid, id, grp, alt, groups.term, any_value(words) AS words, max(value * w) AS s FROM groups JOIN m USING (term) JOIN fields ON fields.term = m.word GROUP BY ALL),"
    " p2 AS (SELECT qid, id, grp, alt, sum(s) / any_value(words) AS s FROM p1 GROUP BY ALL HAVING count(*) = any_value(words)),"
    " p3 AS (SELECT qid, id, grp, max(s) AS s FROM p2 GROUP BY ALL), n AS (SELECT qid, count(DISTINCT grp) AS n FROM groups GROUP BY 1),"
    " p4 AS (SELECT qid, id, count(*) AS coverage, sum(s) * (0.5 + 0.5 * count(*) / any_value(n)) AS score, any_value(n) AS n FROM p3 JOIN n USING (qid) GROUP BY ALL),"
    " p5 AS (SELECT * FROM p4 WHERE coverage >= ceil(n / 2) QUALIFY coverage = max(coverage) OVER (PARTITION BY qid)),"
    " p6 AS (SELECT * FROM p5 QUALIFY score >= 0.45 * max(score) OVER (PARTITION BY qid))"
    " SELECT qid, id, coverage, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM p6 QUALIFY rank <= 10",
)
def k10_concepts(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.expr(TITLED).alias("title"), "text")
    fields = field_terms(docs, "doc_id", {"title": 3.0, "text": 1.0})
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.concat(F.expr(FIRST), F.lit(" "), F.expr(CASES("item_id", [f"'{p}'" for p in PHRASES]))).alias("text"))
    out = R.concept_search(asked, fields, t.documents.count())
    return out.select("qid", "id", F.col("coverage").cast("long").alias("coverage"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "a09_metrics",
    f"WITH {LEX}, e AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)),"
    " f AS (SELECT e.qid, min(rank) AS pos FROM e LEFT JOIN lex ON lex.qid = e.qid AND lex.id = e.id WHERE e.id IS NOT NULL GROUP BY e.qid),"
    " z AS (SELECT e.qid, max(CASE WHEN lex.qid IS NULL THEN 0.0 ELSE 1.0 END) AS got FROM e LEFT JOIN lex ON lex.qid = e.qid WHERE e.id IS NULL GROUP BY e.qid)"
    " SELECT round(avg(CASE WHEN pos = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN pos <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3,"
    " round(avg(coalesce(1.0 / pos, 0)), 6) AS mrr, (SELECT coalesce(round(avg(got), 6), 0)::DOUBLE FROM z) AS false_positives FROM f",
)
def a09(t: Tables) -> DataFrame:
    """Items whose passage stands in documents expect those; the others expect nothing."""
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    all_words = R.all_words(questions(t), t.documents, "doc_id", "text")
    texts = all_words.join(asked, "qid").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    holds = texts.where(F.contains("text", "passage")).select("qid", "id")
    m = ranking_metrics(lexical(t), asked.select("qid").join(holds, "qid", "left"))
    return m.select(*[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "mrr", "false_positives")])


def hybrid(t: Tables) -> DataFrame:
    """Flagship: search by words and by vectors, merged and re-ranked by all signals."""
    return reranked(t)
