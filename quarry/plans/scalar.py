"""Queries over the scalar text functions. Questions are made from order keys, in both engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import rules
from quarry.plans.base import Tables, query

FOLD = "strip_accents(lower(text))"


@query("f01_fold", f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def f01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(
    "f02_match_form",
    f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({FOLD}, '\\bs\\s*/\\s*', 'sem ', 'g'),"
    " '\\bc\\s*/\\s*', 'com ', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS form FROM documents",
)
def f02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.match_form(F.col("text"))).alias("form"))


@query("f03_content_key", "SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS k FROM documents")
def f03(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.content_key(F.col("text")).alias("k"))


def _text(t: Tables, expr: str) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr(expr).alias("q"))


PII = (
    "concat('Placa ABC', lpad(cast(o_orderkey % 10000 as varchar(9)), 4, '0'), ' CPF 123.456.789-', lpad(cast(o_orderkey % 100 as varchar(9)), 2, '0'),"
    " ' CNPJ 12.345.678/0001-', lpad(cast(o_orderkey % 100 as varchar(9)), 2, '0'), ' art. ', cast(o_orderkey % 300 as varchar(9)))"
)


@query(
    "f04_mask_identifiers",
    f"SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace({PII}, '\\b[A-Za-z]{{3}}-?\\d[A-Za-z0-9]\\d{{2}}\\b', '****', 'g'),"
    " '\\b\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}\\b', '****-****', 'g'),"
    " '\\b\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}\\b|\\b\\d{11}\\b', '***-****', 'g') AS masked FROM orders",
)
def f04(t: Tables) -> DataFrame:
    return _text(t, PII).select("o_orderkey", T.mask_identifiers(F.col("q")).alias("masked"))


CITE = (
    "concat('Ver art. ', cast(o_orderkey % 300 as varchar(9)), ' e Res. ', cast(o_orderkey % 900 as varchar(9)), '/2013; artigo e art. ',"
    " cast(o_orderkey % 7 as varchar(9)), ', Portaria ', cast(o_orderkey % 11 as varchar(9)), '/2020')"
)


@query(
    "f07_citations",
    f"WITH s AS (SELECT o_orderkey, {CITE} AS q FROM orders), c AS (SELECT o_orderkey,"
    " list_transform(regexp_extract_all(q, '(?i)art\\.?\\s+(\\d+)', 1), lambda x: concat('art. ', x)) AS a,"
    " list_transform(regexp_extract_all(q, '(?i)(?:res\\.?|resolução)\\s+(\\d+/\\d+)', 1), lambda x: concat('res. ', x)) AS r,"
    " list_transform(regexp_extract_all(q, '(?i)(?:port\\.?|portaria)\\s+(\\d+/\\d+)', 1), lambda x: concat('port. ', x)) AS p FROM s)"
    " SELECT o_orderkey, array_to_string(CASE WHEN len(a) = 2 AND a[1] = a[2] THEN a[1:1] ELSE a END || r || p, '|') AS found FROM c",
)
def f07(t: Tables) -> DataFrame:
    return _text(t, CITE).select("o_orderkey", F.array_join(T.citations(F.col("q")), "|").alias("found"))


CODE_Q = (
    "concat('multa ', lpad(cast(o_orderkey % 1000 as varchar(9)), 3, '1'), CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN ' ' WHEN 2 THEN '/' ELSE '' END,"
    " lpad(cast(o_orderkey % 100 as varchar(9)), 2, '0'), CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE ' hoje' END)"
)


@query(
    "q02_code",
    f"WITH s AS (SELECT o_orderkey, {CODE_Q} AS q FROM orders), d AS (SELECT o_orderkey, regexp_replace(regexp_extract(' ' || q || ' ',"
    " '[^\\p{L}\\d./-](\\d{3}\\s*[-–/.]\\s*\\d{2}|\\d{4}\\s*[-–/.]\\s*\\d|\\d{3}\\s+\\d{2}|\\d{5})[^\\p{L}\\d./-]', 1), '\\D', '', 'g') AS n FROM s)"
    " SELECT o_orderkey, CASE WHEN n <> '' THEN substr(n, 1, 3) || '-' || substr(n, 4) END AS code FROM d",
)
def q02(t: Tables) -> DataFrame:
    return _text(t, CODE_Q).select("o_orderkey", T.code(F.col("q")).alias("code"))


ASK = (
    "CASE o_orderkey % 6 WHEN 0 THEN concat('Artigo ', cast(o_orderkey % 300 as varchar(9)), ' do CTB') WHEN 1 THEN concat('POP nº ', cast(o_orderkey % 200 as varchar(9)))"
    " WHEN 2 THEN 'dirigir moto sem capacete' WHEN 3 THEN 'qual a natureza da ocorrência' WHEN 4 THEN 'como fazer abordagem' ELSE 'bom dia' END"
)


@query(
    "q03_article",
    f"WITH s AS (SELECT o_orderkey, {ASK} AS q FROM orders) SELECT o_orderkey, nullif(regexp_extract(lower(q), '\\bart(?:igo)?\\.?\\s*(\\d{{1,3}})', 1), '') AS article FROM s",
)
def q03(t: Tables) -> DataFrame:
    return _text(t, ASK).select("o_orderkey", T.article_number(F.col("q")).alias("article"))


@query(
    "q04_procedure",
    f"WITH s AS (SELECT o_orderkey, {ASK} AS q FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(q, 'POP nº \\d') THEN lpad(regexp_extract(q, 'POP nº (\\d+)', 1), 3, '0') END AS procedure FROM s",
)
def q04(t: Tables) -> DataFrame:
    return _text(t, ASK).select("o_orderkey", T.procedure(F.col("q")).alias("procedure"))


@query(
    "q06_intent",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'artigo' WHEN 1 THEN 'pop' WHEN 2 THEN 'infracao' WHEN 3 THEN 'natureza_pmsc'"
    " WHEN 4 THEN 'pop' ELSE 'consulta_geral' END AS intent, CASE o_orderkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.82 WHEN 3 THEN 0.88"
    " WHEN 4 THEN 0.84 ELSE 0.5 END::DOUBLE AS confidence, CASE o_orderkey % 6 WHEN 0 THEN 'article' ELSE 'situation' END AS kind FROM orders",
)
def q06(t: Tables) -> DataFrame:
    return _text(t, ASK).select("o_orderkey", T.intent(F.col("q")).alias("i"), T.query_type(F.col("q")).alias("kind")).select(
        "o_orderkey", "i.intent", "i.confidence", "kind"
    )


@query(
    "k14_tokens",
    f"WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array({FOLD}, '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN"
    f" ({', '.join(repr(w) for w in T.STOP_WORDS)}))) AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(list_sort(w), ' ')) AS words FROM s",
)
def k14(t: Tables) -> DataFrame:
    w = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(F.sort_array(w), " ")).alias("words"))


@query(
    "f20_money",
    "SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS price FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)",
)
def f20(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.money(F.floor("o_totalprice") * 100).alias("price"))


@query("f23_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS short FROM documents")
def f23(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate(F.col("text"), 80).alias("short"))


STEP = "CASE WHEN x <= 600 THEN 532 WHEN x <= 800 THEN 1064 WHEN x <= 1000 THEN 2128 WHEN x <= 3000 THEN 3192 WHEN x <= 5000 THEN 4256 ELSE 5320 END"


@query(
    "f26_weight_fine",
    "WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 10) AS BIGINT) - 500 AS x FROM lineitem)"
    f" SELECT l_orderkey, l_linenumber, x AS excess, CAST(CASE WHEN x <= 0 THEN 0 ELSE ceil(x / 200.0) * ({STEP}) END AS BIGINT) AS cents,"
    " CASE WHEN x <= 0 THEN NULL WHEN x <= 600 THEN '688-20' WHEN x <= 1000 THEN '689-00' ELSE '690-40' END AS code,"
    " CAST(CASE WHEN x <= 0 THEN NULL WHEN x <= 600 THEN 13016 WHEN x <= 1000 THEN 19523 ELSE ceil(x / 500.0) * 29347 END AS BIGINT) AS traction FROM s",
)
def f26(t: Tables) -> DataFrame:
    x = (F.floor(F.col("l_extendedprice") / 10) - 500).cast("long")
    s = t.lineitem.select("l_orderkey", "l_linenumber", x.alias("excess"))
    tr = rules.traction_fine(F.col("excess"))
    return s.select("*", rules.excess_fine(F.col("excess")).alias("cents"), tr["code"].alias("code"), tr["cents"].alias("traction"))


@query(
    "c11_weight_limit",
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 90 END AS b,"
    " CASE WHEN l_linenumber % 3 = 0 THEN 2500.0 END AS c FROM lineitem), o AS (SELECT *, least(a, coalesce(b, 1e18), coalesce(c, 1e18)) AS kg FROM s)"
    " SELECT l_orderkey, l_linenumber, CAST(kg AS DOUBLE) AS kg, CASE WHEN kg = a THEN 'legal' WHEN kg = b THEN 'tecnico' ELSE 'cmt' END AS factor FROM o",
)
def c11(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    low = rules.weight_limit(
        F.col("l_quantity") * 100, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 90),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(2500.0)), none, none,
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", low["kg"].alias("kg"), low["factor"].alias("factor"))


@query(
    "c16_foreign_driver",
    "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'vencida' WHEN 1 THEN 'nao_apresentada' ELSE 'valida' END AS h, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 2 = 0 END AS c,"
    " o_orderkey % 4 <> 0 AS i, o_orderkey % 7 = 0 AS p, CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS pending FROM orders)"
    " SELECT o_orderkey, CASE WHEN pending > 0 THEN '' ELSE array_to_string(list_filter([CASE h WHEN 'vencida' THEN 'expired' WHEN 'nao_apresentada' THEN 'no licence' END,"
    " CASE WHEN NOT c THEN 'category' END, CASE WHEN NOT i THEN 'identity' END, CASE WHEN p AND h = 'nao_apresentada' THEN 'permit only' END], lambda x: x IS NOT NULL), '|') END AS found FROM s",
)
def c16(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.when(k % 3 == 0, "vencida").when(k % 3 == 1, "nao_apresentada").otherwise("valida")
    found = rules.foreign_driver(h, F.when(k % 5 < 4, k % 2 == 0), k % 4 != 0, k % 7 == 0, F.when(k % 10 == 9, 1).otherwise(0))
    return t.orders.select("o_orderkey", F.array_join(found, "|").alias("found"))


@query(
    "c14_guided",
    "WITH c AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey % 5 AS code FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY code) - 1 AS place FROM c),"
    " a AS (SELECT r.*, k.n, (case_id + k.n) % 3 AS w, k.n % 2 = 0 AS good_side FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) k),"
    " g AS (SELECT case_id, code, place, count(*) FILTER (w < 2 AND good_side = (w = 0)) AS yes, count(*) FILTER (w < 2 AND good_side <> (w = 0)) AS no FROM a GROUP BY ALL)"
    " SELECT case_id, CAST(code AS BIGINT) AS code, CAST(100 - place + 20 * yes - 30 * no AS BIGINT) AS score, bool_or(yes > 0 AND no > 0) OVER (PARTITION BY case_id) AS contradiction FROM g",
)
def c14(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    cand = t.lineitem.select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 5).cast("long").alias("code")).distinct()
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("code")) - 1
    cand = cand.withColumn("place", place.cast("long"))
    points = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("criterion")
    source = F.when(F.col("criterion") % 2 == 0, "quando_autuar").otherwise("quando_nao_autuar").alias("source")
    criteria = cand.select("code").distinct().select("code", points).select("code", "criterion", source)
    w = (F.col("case_id") + F.col("criterion")) % 3
    answers = cand.select("case_id").distinct().select("case_id", points)
    answers = answers.withColumn("answer", F.when(w == 0, "sim").when(w == 1, "nao").otherwise("nao_informado"))
    return rules.guided(cand, criteria, answers)
