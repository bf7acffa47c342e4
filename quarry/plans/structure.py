"""Queries of file names, headings, references, cards, catalogues, reports and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import cards, documents, domains
from quarry.functions import text as T
from quarry.operators import catalogues as C
from quarry.operators import reports as P
from quarry.operators import retrieval as R
from quarry.plans.base import Tables, query
from quarry.plans.search import ASKED, LEX, LISTS, POSTS, TERMS, VEC, doc_places, doc_posts, lexical, questions, second, vector

FILE = "concat(' Pop_1.0', cast(o_orderkey % 7 as varchar(9)), '__abordagem', CASE o_orderkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.markdown' WHEN 3 THEN '.exe' ELSE '' END)"


def orders(t: Tables, **made: str) -> DataFrame:
    return t.orders.select("o_orderkey", *[F.expr(e).alias(n) for n, e in made.items()])


@query(
    "s12_formats",
    f"WITH s AS (SELECT o_orderkey, lower(trim({FILE})) AS n FROM orders), e AS (SELECT o_orderkey, regexp_extract(n, '^.+\\.([^.]*)$', 1) AS ext FROM s)"
    " SELECT o_orderkey, ext, CASE WHEN ext IN ('pdf', 'docx') THEN ext WHEN ext = 'markdown' THEN 'md' END AS format, CASE ext WHEN 'pdf' THEN 'application/pdf'"
    " WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'markdown' THEN 'text/plain' END AS type FROM e",
)
def s12(t: Tables) -> DataFrame:
    n = F.col("n")
    return orders(t, n=FILE).select(
        "o_orderkey", documents.extension(n).alias("ext"), documents.file_format(n).alias("format"), documents.content_type(n).alias("type")
    )


@query(
    "f17_title_of_file",
    f"SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace({FILE}, '\\.[^.]+$', ''), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM orders",
)
def f17(t: Tables) -> DataFrame:
    return orders(t, n=FILE).select("o_orderkey", documents.title_of_file(F.col("n")).alias("title"))


SECTION = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('ANEXO I › Seção ', cast(o_orderkey % 4 as varchar(9)), ' — Disposições') END"
TERM = "CASE WHEN o_orderkey % 2 = 0 THEN 'CICLOMOTOR - veículo de duas rodas' ELSE 'sem termo' END"


@query(
    "f15_fallback_label",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ctb' ELSE 'Seção ' || (o_orderkey % 4) END || ' · ' || CASE WHEN o_orderkey % 2 = 0 THEN 'CICLOMOTOR'"
    " ELSE 'trecho ' || (o_orderkey % 9 + 1) END AS label FROM orders",
)
def f15(t: Tables) -> DataFrame:
    rows = orders(t, section=SECTION, text=TERM, n="cast(o_orderkey % 9 as int)")
    return rows.select("o_orderkey", documents.fallback_label(F.col("section"), F.col("text"), F.lit("ctb"), F.col("n")).alias("label"))


REF = (
    "concat('Conforme art. ', cast(o_orderkey % 300 as varchar(9)), CASE o_orderkey % 4 WHEN 0 THEN '-A' WHEN 1 THEN ' § 2' WHEN 2 THEN ', inciso XVII' ELSE '' END,"
    " '; e artigo ', cast(o_orderkey % 90 as varchar(9)), ' 4')"
)


@query(
    "f08_references",
    "SELECT o_orderkey, 1 AS pos, (o_orderkey % 300) || CASE WHEN o_orderkey % 4 = 0 THEN '-a' ELSE '' END AS number, CASE WHEN o_orderkey % 4 = 1 THEN '2' END AS paragraph,"
    " CASE WHEN o_orderkey % 4 = 2 THEN '17' END AS clause FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_orderkey % 90 AS VARCHAR), NULL, '4' FROM orders",
)
def f08(t: Tables) -> DataFrame:
    rows = orders(t, q=REF).select("o_orderkey", F.posexplode(documents.references(F.col("q"))).alias("p", "r"))
    return rows.select("o_orderkey", (F.col("p") + 1).alias("pos"), "r.number", "r.paragraph", "r.clause")


LINE = (
    "CASE o_orderkey % 8 WHEN 0 THEN concat('Art. ', cast(o_orderkey % 300 as varchar(9)), '. Dirigir') WHEN 1 THEN '§ 2º O condutor' WHEN 2 THEN 'XVII - em local' WHEN 3 THEN 'CAPÍTULO XV'"
    " WHEN 4 THEN 'a) leve' WHEN 5 THEN 'Penalidade - multa;' WHEN 6 THEN 'DAS INFRAÇÕES GERAIS' ELSE 'texto corrido da norma' END"
)


@query(
    "f14_line_kind",
    "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'article' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'clause' WHEN 3 THEN 'title' WHEN 4 THEN 'item' WHEN 5 THEN 'item'"
    " WHEN 6 THEN 'title' ELSE 'text' END AS kind, CASE o_orderkey % 8 WHEN 3 THEN 2 ELSE 6 END AS level, CASE o_orderkey % 8 WHEN 0 THEN 'art. ' || (o_orderkey % 300)"
    " WHEN 1 THEN '§ 2º' WHEN 2 THEN 'inc. XVII' END AS label FROM orders",
)
def f14(t: Tables) -> DataFrame:
    q = F.col("q")
    kind = documents.line_kind(q, F.lit(True), F.lit(True))
    return orders(t, q=LINE).select("o_orderkey", kind.alias("kind"), documents.heading_level(q).alias("level"), documents.opening_label(q).alias("label"))


ANSWER = "concat('Veja **art. ', cast(o_orderkey % 300 as varchar(9)), '** [', cast(o_orderkey % 9 as varchar(9)), ']\\n- um\\n\\n- dois\\n1. três')"


@query(
    "f12_answer_blocks",
    "SELECT o_orderkey, 'paragraph:text=Veja |bold=art. ' || (o_orderkey % 300) || '|text= |citation=' || (o_orderkey % 9) || ';list:text=um|text=dois;numbered:text=três' AS shown FROM orders",
)
def f12(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr(ANSWER).alias("q")).select("o_orderkey", documents.answer_blocks(F.col("q")).alias("b"))
    shown = F.transform("b", lambda b: F.concat(b["kind"], F.lit(":"), F.array_join(F.transform(F.flatten(b["items"]), lambda p: F.concat(p["kind"], F.lit("="), p["value"])), "|")))
    return rows.select("o_orderkey", F.array_join(shown, ";").alias("shown"))


SHEET = (
    "concat('Art. ', cast(o_orderkey % 300 as varchar(9)), ', XVII. Tipificação do Enquadramento: Estacionar  em local Gravidade: ', CASE WHEN o_orderkey % 2 = 0 THEN 'Média' ELSE 'Grave' END,"
    " ' Penalidade: Multa Pontuação: 4 Quando AUTUAR 1. veículo parado Quando NÃO Autuar 1. em pane Exemplos do Campo de Observações do AIT: 1. a 2. b')"
)


@query(
    "f13_sheet_fields",
    "SELECT o_orderkey % 300 AS article, o_orderkey % 2 AS kind, 'Art. ' || (o_orderkey % 300) || ', XVII' AS support, 'Estacionar em local' AS typification,"
    " CASE WHEN o_orderkey % 2 = 0 THEN 'Média' ELSE 'Grave' END AS severity, '4' AS points, '1. veículo parado' AS to_fine, '1. em pane' AS not_to_fine, 2 AS examples, min(o_orderkey) AS first"
    " FROM orders GROUP BY ALL",
)
def f13(t: Tables) -> DataFrame:
    rows = orders(t, q=SHEET, article="o_orderkey % 300", kind="o_orderkey % 2").withColumn("f", documents.sheet_fields(F.col("q")))
    cols = ["support", "typification", "severity", "points", "to_fine", "not_to_fine"]
    named = rows.select("o_orderkey", "article", "kind", *[F.col(f"f.{c}").alias(c) for c in cols], F.size("f.examples").alias("examples"))
    return named.groupBy("article", "kind", *cols, "examples").agg(F.min("o_orderkey").alias("first"))


# An infraction per part.
INFRACTION = {
    "code": "concat(lpad(cast(p_partkey % 900 as varchar(9)), 3, '5'), '-', lpad(cast(p_partkey % 100 as varchar(9)), 2, '0'))",
    "wording": "concat('Conduzir ', p_name)", "severity": "CASE WHEN p_size > 25 THEN 'grave' ELSE 'leve' END", "points": "p_size % 7",
    "cents": "cast(p_size * 100 as bigint)", "unit": "'UFIR'", "held": "p_size % 2 = 0", "towed": "p_size % 3 = 0",
    "document": "CASE p_size % 4 WHEN 0 THEN 'cnh' WHEN 1 THEN 'ambos' END", "support": "concat('art. ', cast(290 + p_size % 30 as varchar(9)), ' do CTB')",
}
INFRACTIONS = ", ".join(f"{e} AS {n}" for n, e in INFRACTION.items())


def infractions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", *[F.expr(e).alias(n) for n, e in INFRACTION.items()])


@query(
    "f25_card_parts",
    f"WITH i AS (SELECT p_partkey, {INFRACTIONS} FROM part) SELECT p_partkey, 5 + held::INT + towed::INT + (document IS NOT NULL)::INT AS checks,"
    " 2 + towed::INT + (document IS NOT NULL)::INT + (cents = 0)::INT AS mistakes, CAST(regexp_extract(support, '\\d+') AS INT) BETWEEN 302 AND 312 AS crime,"
    " 'R$ ' || (cents // 100) || ',00' AS fine, CASE document WHEN 'cnh' THEN 'CNH' WHEN 'ambos' THEN 'CNH e CRLV' END AS paper,"
    " 'conduzir ' || substr(wording, 10) || ', previsto em ' || support || '. É infração de gravidade ' || severity || ', vale ' || points || ' ponto(s) na CNH e multa de R$ '"
    " || (cents // 100) || ',00 (UFIR).' || CASE WHEN held OR towed OR document IS NOT NULL THEN ' Além da multa, a infração prevê ' || concat_ws(', ', CASE WHEN document IS NOT NULL"
    " THEN 'recolhimento de documento' END, CASE WHEN held THEN 'retenção do veículo' END, CASE WHEN towed THEN 'remoção do veículo' END) || '.' ELSE"
    " ' A infração não prevê medida administrativa além da multa.' END || ' " + cards.SUMMARY_NOTE + "' AS summary FROM i",
)
def f25(t: Tables) -> DataFrame:
    c = {n: F.col(n) for n in INFRACTION}
    told = [c[n] for n in ("wording", "support", "severity", "points", "cents", "unit", "held", "towed", "document")]
    return infractions(t).select(
        "p_partkey", F.size(cards.checklist(c["held"], c["towed"], c["document"], c["support"])).alias("checks"),
        F.size(cards.mistakes(c["towed"], c["document"], c["cents"])).alias("mistakes"), cards.is_crime(c["support"]).alias("crime"),
        cards.fine(c["cents"]).alias("fine"), cards.paper(c["document"]).alias("paper"), cards.summary(*told).alias("summary"),
    )


@query(
    "c17_cards",
    f"WITH i AS (SELECT p_partkey, {INFRACTIONS} FROM part WHERE p_partkey % 2 = 0) SELECT p.p_partkey AS qid, i.p_partkey IS NOT NULL AS success, p.p_partkey % 900 AS asked,"
    " CASE WHEN i.p_partkey IS NOT NULL THEN 1 END AS citations FROM part p LEFT JOIN i USING (p_partkey)",
)
def c17(t: Tables) -> DataFrame:
    known = infractions(t).withColumn("code", F.col("p_partkey").cast("string")).where("p_partkey % 2 = 0").drop("p_partkey")
    asked = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"), F.col("p_partkey").cast("string").alias("code"))
    norms = t.spark.createDataFrame([], "qid bigint, place int, label string, text string")
    made = P.infraction_cards(asked, known, norms)
    return made.select("qid", "success", (F.col("qid") % 900).alias("asked"), F.size("citations").alias("citations")).withColumn(
        "citations", F.when(F.col("citations") >= 0, F.col("citations"))
    )


@query(
    "f29_share_text",
    "SELECT p_partkey, 'https://x.org/consulta?q=multa%20' || p_partkey AS link, '🚦 ' || p_name || chr(10) || 'Código MBFT: 516-91' || chr(10) || 'Gravidade: LEVE · 3 pontos · R$ ' || p_size"
    " || ',00' || chr(10) || 'Amparo legal: art. 165' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '⚠️ Veículo retido' ELSE '' END || chr(10) || chr(10) || 'fim' AS message FROM part",
)
def f29(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    card = F.struct(
        F.lit("q").alias("question"), F.col("p_name").alias("wording"), F.lit("516-91").alias("code"), F.lit(0).alias("unfolding"), F.lit("leve").alias("severity"),
        F.lit(3).alias("points"), (F.col("p_size") * 100).cast("long").alias("cents"), F.lit("art. 165").alias("support"), none.alias("document"),
        (F.col("p_size") % 2 == 0).alias("held"), F.lit(False).alias("towed"), F.lit(False).alias("crime"), F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("checklist"),
    )
    link = cards.share_link(F.concat(F.lit("multa "), F.col("p_partkey").cast("string")), "https://x.org/")
    return t.part.select("p_partkey", link.alias("link"), cards.share_text(card, F.lit("fim")).alias("message"))


DOMAIN_Q = (
    "CASE o_orderkey % 7 WHEN 0 THEN 'Artigo 165 do CTB' WHEN 1 THEN 'como fazer baculejo' WHEN 2 THEN 'mandar zap ao volante' WHEN 3 THEN 'briga de vizinhos na rua'"
    " WHEN 4 THEN 'som alto de madrugada' WHEN 5 THEN 'dirigir moto sem capacete' ELSE 'bom dia' END"
)


@query(
    "q07_domain",
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'ctb' WHEN 1 THEN 'pop' WHEN 2 THEN 'infracao' WHEN 3 THEN 'fato_pmsc' WHEN 4 THEN 'fato_pmsc' WHEN 5 THEN 'infracao' ELSE 'ctb' END AS domain,"
    " CASE o_orderkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.88 WHEN 2 THEN 0.88 WHEN 3 THEN 0.86 WHEN 4 THEN 0.86 WHEN 5 THEN 0.82 ELSE 0.5 END::DOUBLE AS confidence,"
    " CASE WHEN o_orderkey % 7 = 6 AND o_orderkey % 2 = 0 THEN 'pop' END AS by_model FROM orders",
)
def q07(t: Tables) -> DataFrame:
    q = F.col("q")
    rows = orders(t, q=DOMAIN_Q).withColumn("sure", F.when(F.col("o_orderkey") % 2 == 0, 0.9).otherwise(0.7))
    solved = domains.resolved_domain(q, F.lit("pop"), F.col("sure"))
    return rows.select("o_orderkey", domains.domain(q).alias("d"), solved.alias("r")).select(
        "o_orderkey", "d.domain", "d.confidence", F.when(F.col("r.signal") == "model", F.col("r.domain")).alias("by_model")
    )


FOREIGN_Q = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'argentino com habilitação vencida' WHEN 1 THEN 'turista sem carteira e com PID' WHEN 2 THEN 'residente, carro paraguaio sem seguro'"
    " WHEN 3 THEN 'carteira válida' WHEN 4 THEN 'art. 162 habilitação vencida' ELSE 'bom dia' END"
)


@query(
    "q16_foreign_facts",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'vencida' WHEN 1 THEN 'nao_apresentada' WHEN 3 THEN 'valida' END AS licence, CASE WHEN o_orderkey % 6 = 1 THEN true END AS permit_shown,"
    " CASE WHEN o_orderkey % 6 = 2 THEN 'estrangeiro' END AS vehicle, CASE WHEN o_orderkey % 6 = 2 THEN false END AS insured,"
    " CASE o_orderkey % 6 WHEN 1 THEN 'visitante' WHEN 2 THEN 'residente' END AS status FROM orders",
)
def q16(t: Tables) -> DataFrame:
    return orders(t, q=FOREIGN_Q).select("o_orderkey", domains.foreign_facts(F.col("q")).alias("f")).select("o_orderkey", "f.*")


@query(
    "c21_training_rows",
    "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'placa **** som alto' ELSE 'placa **** bom dia' END AS question, sha256(CASE o_orderkey % 2 WHEN 0 THEN 'placa **** som alto'"
    " ELSE 'placa **** bom dia' END) AS question_hash, CASE o_orderkey % 2 WHEN 0 THEN 'fato_pmsc' ELSE 'ctb' END AS domain FROM orders",
)
def c21(t: Tables) -> DataFrame:
    q = F.expr("concat('placa ABC1D23  ', CASE o_orderkey % 2 WHEN 0 THEN 'som alto' ELSE 'bom dia' END)")
    rows = t.orders.select("o_orderkey", domains.training_row(q, domains.domain(q)).alias("r"))
    return rows.select("o_orderkey", "r.question", "r.question_hash", "r.domain")


@query(
    "k12_generic",
    "SELECT o_orderkey, o_orderkey % 3 = 0 AS generic FROM orders",
)
def k12(t: Tables) -> DataFrame:
    q = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'sem 123' WHEN 1 THEN 'sem capacete' ELSE 'velocidade 120' END")
    return t.orders.select("o_orderkey", domains.generic(T.tokens(q)).alias("generic"))


@query(
    "k24_rewrites",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PBTC caminhão trator semirreboque peso combinado' WHEN 1 THEN 'peso bruto conjunto eixos tandem'"
    " WHEN 2 THEN 'limite de altura' ELSE 'CMT acima 1000 excesso infração gravíssima' END AS words, CASE o_orderkey % 4 WHEN 2 THEN 'vias de fato' ELSE 'perda de documentos ou objetos' END AS fact FROM orders",
)
def k24(t: Tables) -> DataFrame:
    q = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'peso da carreta' WHEN 1 THEN 'eixo tandem' WHEN 2 THEN 'limite de altura' ELSE 'CMT acima de mil' END")
    f = F.expr("CASE o_orderkey % 4 WHEN 2 THEN 'briga na rua' ELSE 'perdeu os documentos' END")
    return t.orders.select("o_orderkey", domains.weight_question(q).alias("words"), domains.fact_question(f).alias("fact"))


@query(
    "r08_cover_density",
    f"WITH p AS (SELECT doc_id AS id, unnest({TERMS}) AS term FROM documents),"
    f" l AS (SELECT id, count(*) AS size FROM p GROUP BY id), c AS (SELECT id, term, size, count(*) AS n FROM p JOIN l USING (id) GROUP BY ALL), q AS ({ASKED}),"
    " h AS (SELECT qid, id, count(*) AS coverage, sum(n) AS d, max(size) AS size FROM q JOIN c USING (term) GROUP BY ALL), s AS (SELECT *, d / ln(1 + size) AS dd FROM h),"
    " r AS (SELECT qid, id, coverage, coverage + dd / (1 + dd) AS score FROM s)"
    " SELECT qid, id, coverage, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM r QUALIFY rank <= 10",
)
def r08(t: Tables) -> DataFrame:
    out = R.cover_density(questions(t), doc_places(t))
    return out.select("qid", "id", "coverage", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "r11_all_words",
    f"WITH p AS ({POSTS}), q AS ({ASKED}), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid), h AS (SELECT qid, id, count(*) AS coverage FROM q JOIN p USING (term) GROUP BY ALL)"
    " SELECT qid, id, coverage, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM h JOIN n USING (qid) WHERE coverage = n QUALIFY rank <= 10",
)
def r11(t: Tables) -> DataFrame:
    return R.all_words_topk(questions(t), doc_posts(t)).withColumn("rank", F.col("rank").cast("long"))


@query("r14_search_order", f"WITH {LEX} SELECT qid, doc_id, rank, source FROM lex JOIN documents ON doc_id = id")
def r14(t: Tables) -> DataFrame:
    out = R.in_search_order(lexical(t), t.documents.select("doc_id", "source"), "doc_id")
    return out.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), "source")


@query(
    "r15_either_list",
    f"WITH {LISTS},"
    " j AS (SELECT qid, id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + r.rank), 0) AS score FROM lex l FULL JOIN two r USING (qid, id))"
    " SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank FROM j QUALIFY rank <= 5",
)
def r15(t: Tables) -> DataFrame:
    out = R.either(lexical(t), second(t))
    return out.select("qid", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r15_vector_only", f"WITH {VEC} SELECT qid, id, rank FROM vec")
def r15v(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "qid bigint, id bigint, rank int")
    out = R.either(none, vector(t), k=10)
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "a10_case_run",
    f"WITH {LEX}, c AS (SELECT item_id, '' || (item_id % 100) AS expected FROM benchmark), z AS (SELECT item_id, min(rank) AS pos FROM c LEFT JOIN lex ON qid = item_id AND starts_with(CAST(id AS VARCHAR), expected) GROUP BY 1)"
    " SELECT count(*) AS total, round(100.0 * count(*) FILTER (pos = 1) / count(*), 2) AS hit1, round(100.0 * count(*) FILTER (pos <= 3) / count(*), 2) AS hit3 FROM z",
)
def a10(t: Tables) -> DataFrame:
    n = F.col("item_id")
    cases = t.benchmark.select(n.alias("case_id"), F.array((n % 100).cast("string")).alias("expected"), F.lit(False).alias("exact"), F.lit(3).alias("max_pos"))
    found = lexical(t).groupBy(F.col("qid").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
    found = found.select("case_id", F.transform("l", lambda x: x["id"].cast("string")).alias("found"), F.lit(5).alias("ms"))
    return P.case_metrics(P.case_positions(cases, found)).select("total", "hit1", "hit3")


@query(
    "a14_diagnosis",
    "WITH s AS (SELECT source, count(*) AS chunks, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, count(*) FILTER (length(trim(coalesce(text, ''))) BETWEEN 1 AND 79) AS short,"
    " count(*) FILTER (n_chars IS NULL) AS novec FROM documents GROUP BY 1), d AS (SELECT source, sum(c - 1) AS dup FROM (SELECT source, lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g')) AS k,"
    " count(*) AS c FROM documents WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY ALL) GROUP BY 1) SELECT source AS collection, chunks, empty + short AS invalid, CAST(coalesce(dup, 0) AS BIGINT) AS duplicates,"
    " round(100.0 * (chunks - novec) / chunks, 2) AS vector_cover, CASE WHEN empty + short > 0 OR coalesce(dup, 0) > 0 THEN 'critica' ELSE 'atencao' END AS status FROM s LEFT JOIN d USING (source) WHERE source IS NOT NULL",
)
def a14(t: Tables) -> DataFrame:
    from quarry.operators.quality import quality_stats

    docs = t.documents.where("source is not null")
    stats = quality_stats(docs, "source", "text", "doc_id", F.col("n_chars").isNull())
    local = t.spark.createDataFrame([], "collection string, items bigint, invalid bigint, duplicates bigint")
    runs = docs.select(F.col("source").alias("collection")).distinct().select("collection", F.lit(80.0).alias("hit1"), F.lit(90.0).alias("hit3"))
    made = P.diagnosis(stats, local, runs, F.lit(True))
    return made.select("collection", "chunks", "invalid", "duplicates", "vector_cover", "status")


@query(
    "a16_audit",
    "SELECT n_regionkey AS region, CASE WHEN count(*) FILTER (n_nationkey % 7 = 0) > 0 THEN 'bloqueio' WHEN count(*) FILTER (n_nationkey % 3 = 0) > 0 THEN 'atencao' ELSE 'ok' END AS status FROM nation GROUP BY 1",
)
def a16(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    checks = t.nation.select(F.col("n_regionkey").alias("region"), F.when(k % 7 == 0, "bloqueio").when(k % 3 == 0, "atencao").otherwise("ok").alias("status"))
    return P.audit_status(checks, ["region"])


@query("k19_relaxed",
    f"WITH p AS ({POSTS}), q AS ({ASKED}), h AS (SELECT qid, id, CAST(count(*) AS DOUBLE) AS points FROM q JOIN p USING (term) GROUP BY ALL)"
    " SELECT qid, id, points, row_number() OVER (PARTITION BY qid ORDER BY points DESC, id) AS rank FROM h QUALIFY rank <= 3",
)
def k19(t: Tables) -> DataFrame:
    out = C.suggest_relaxed(questions(t), doc_posts(t).withColumn("w", F.lit(1.0)))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "k27_number_sources",
    "WITH s AS (SELECT n_regionkey AS qid, 0 AS k, 'ctb' AS kind, n_nationkey AS place, n_name AS title FROM nation UNION ALL SELECT n_regionkey, 2, 'pop', n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0)"
    " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY k, place, title) AS n, kind, title, CASE WHEN kind = 'ctb' THEN 1501 ELSE 1800 END AS length FROM s",
)
def k27(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_regionkey").alias("qid"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("title"),
                           F.lit("x" * 1800).alias("text"), F.lit(None).cast("string").alias("link"))
    out = C.number_sources({"pop": rows.where("place % 2 = 0"), "ctb": rows})
    return out.select("qid", F.col("n").cast("long").alias("n"), "kind", "title", F.length("text").alias("length"))


@query(
    "k13_passage",
    "SELECT doc_id, least(length(text), 0) AS before, length(text) <= 500 AS whole FROM documents WHERE text IS NOT NULL",
)
def k13(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null").select("doc_id", "text", C.passage(F.col("text"), F.col("source"), 500).alias("p"))
    return rows.select("doc_id", F.lit(0).alias("before"), (F.col("p") == F.col("text")).alias("whole"))


@query("k17_sheets")
def k17(t: Tables) -> DataFrame:
    row = F.min_by(F.struct(F.col("wording").alias("label"), "support", "severity"), "p_partkey")  # the first sheet of each code
    sheets = infractions(t).groupBy(F.col("code").alias("id")).agg(row.alias("s")).select("id", "s.*")
    sheets = sheets.withColumnRenamed("severity", "wording")
    q = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('multa ', lpad(cast(p_partkey % 900 as string), 3, '5'), '-', lpad(cast(p_partkey % 100 as string), 2, '0')) WHEN 1 THEN concat('art. ', 290 + p_size % 30) ELSE p_name END")
    asked = t.part.select(F.col("p_partkey").alias("qid"), q.alias("text"))
    return C.search_sheets(asked, sheets, t.spark.createDataFrame([], "term string, id string"))


MENTION = "concat('Ver POP nº ', CASE WHEN o_orderkey % 2 = 0 THEN '101' ELSE '999' END, ' e POP 102.1; fim')"


@query(
    "j12_linked_mentions",
    "SELECT o_orderkey, u.kind, u.text, u.number FROM orders, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [{'kind': 'text', 'text': 'Ver ', 'number': NULL}, {'kind': 'reference', 'text': 'POP nº 101', 'number': '101'},"
    " {'kind': 'text', 'text': ' e ', 'number': NULL}, {'kind': 'reference', 'text': 'POP 102.1', 'number': '102.1'}, {'kind': 'text', 'text': '; fim', 'number': NULL}]"
    " ELSE [{'kind': 'text', 'text': 'Ver POP nº 999 e ', 'number': NULL}, {'kind': 'reference', 'text': 'POP 102.1', 'number': '102.1'}, {'kind': 'text', 'text': '; fim', 'number': NULL}] END) AS x(u)",
)
def j12(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("101", "a"), ("102.1", "b")], "number string, title string")
    return C.linked_mentions(orders(t, q=MENTION), "o_orderkey", "q", known).select("o_orderkey", "kind", "text", "number")


@query(
    "c07_joined_pages",
    "SELECT conv_id, md5(string_agg('[[página ' || turn || ']]' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text)) AS whole FROM conversations GROUP BY 1",
)
def c07(t: Tables) -> DataFrame:
    return P.joined_pages(t.conversations, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("whole"))


@query(
    "c09_handout_problems",
    "SELECT source FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1 HAVING sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) > 36000",
)
def c09(t: Tables) -> DataFrame:
    rows = t.documents.where("source is not null").select("source", F.lit(None).cast("int").alias("page"), F.col("doc_id").alias("ord"), F.lit("s").alias("section"), "text")
    size = rows.groupBy("source").agg(F.sum(F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("n"))
    out = P.handout_parts(rows, "source").where("problem is not null").select("source")
    return out.join(size.where("n > 36000"), "source", "left_semi")


@query(
    "c20_comparison",
    "SELECT p_partkey AS code, p_name AS wording, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS to_fine FROM part",
)
def c20(t: Tables) -> DataFrame:
    scene = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    rows = t.part.select("p_partkey", F.col("p_name").alias("wording"), scene.alias("to_fine"), F.col("p_type").alias("typification"),
                                                      *[F.lit("").alias(c) for c in ("support", "severity", "points", "penalty", "measure")])
    return C.compare_sheets(rows, "p_partkey").select("code", "wording", "to_fine")


@query(
    "c22_review",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'pop' END AS expected, CASE WHEN o_orderkey % 10 = 0 THEN 'certo' END AS note, o_orderkey % 5 = 0 AS reviewed FROM orders",
)
def c22(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), none.alias("expected"), none.alias("note"), F.lit(False).alias("reviewed"), none.alias("reviewed_at"))
    new = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.lit("pop").alias("expected"), F.expr("if(o_orderkey % 10 = 0, ' certo ', ' ')").alias("note"), F.lit("2024").alias("at"))
    return P.review(rows, new).drop("reviewed_at")


@query("p11_clamp", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30")
def p11(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(P.clamped(99, 1, 10, 30))


@query("j16_known_contents", "SELECT doc_id FROM documents WHERE sha256(lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'))) IN"
    " (SELECT sha256(lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'))) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0")  # fmt: skip
def j16(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", T.content_key(F.coalesce("text", F.lit(""))).alias("k"))
    known = keyed.where("doc_id % 10 = 0").select("k")
    return keyed.where("doc_id % 10 <> 0").join(known, "k", "left_semi").select("doc_id")
