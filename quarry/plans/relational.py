"""Queries of predicates, orderings, set operations, question understanding and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import questions as Q
from quarry.functions import text as T
from quarry.functions import vocabulary as V
from quarry.operators import matching as M
from quarry.operators import rules, usage
from quarry.plans.base import Tables, query

MASKED = (
    "regexp_replace(regexp_replace(regexp_replace(text, '\\b[A-Za-z]{3}-?\\d[A-Za-z0-9]\\d{2}\\b', '****', 'g'), '\\b\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}\\b', '****-****', 'g'),"
    " '\\b\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}\\b|\\b\\d{11}\\b', '***-****', 'g')"
)
LABEL = "concat('Art. ', cast(o_orderkey % 300 as varchar(9)), CASE o_orderkey % 4 WHEN 1 THEN '-A' WHEN 2 THEN ' XVII' ELSE '' END)"


def labels(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr(LABEL).alias("label"))


@query("p01_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 32 LIMIT 1")
def p01(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 32").select("o_orderkey", "o_orderstatus").limit(1)


@query("p02_literal_like", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def p02(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_name") == "customer#000000007").select("c_custkey")


@query(
    "p03_reference",
    f"WITH s AS (SELECT o_orderkey, {LABEL} AS label FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(label, '\\sXVII$') THEN 10 ELSE 0 END AS points"
    " FROM s WHERE regexp_extract(lower(label), 'art\\. (\\d+(?:-[a-z])?)', 1) = '16'",
)
def p03(t: Tables) -> DataFrame:
    hit = labels(t).where(F.contains(F.lower("label"), F.lit("art. 16")))
    hit = hit.where(F.regexp_extract(F.lower("label"), r"art\. (\d+(?:-[a-z])?)", 1) == "16")
    return hit.select("o_orderkey", F.when(F.col("label").rlike(r"\sXVII$"), 10).otherwise(0).alias("points"))


@query("p04_infraction_range", "SELECT o_orderkey, o_orderkey % 300 BETWEEN 161 AND 255 AS infraction FROM orders")
def p04(t: Tables) -> DataFrame:
    n = F.regexp_extract("label", r"(\d+)", 1).try_cast("int")
    return labels(t).select("o_orderkey", n.between(161, 255).alias("infraction"))


@query("p05_prefix_set", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#4')")
def p05(t: Tables) -> DataFrame:
    return t.part.where(F.exists(F.array(F.lit("Brand#1"), F.lit("Brand#4")), lambda x: F.startswith("p_brand", x))).select("p_partkey")


@query("p06_in_list", "SELECT doc_id, source FROM documents WHERE doc_id IN (1, 5, 9, 70000)")
def p06(t: Tables) -> DataFrame:
    return t.documents.where(F.col("doc_id").isin(1, 5, 9, 70000)).select("doc_id", "source")


@query("p07_pending", "SELECT count(*) FILTER (embedding IS NULL) AS vectors, count(*) AS n FROM embeddings")
def p07(t: Tables) -> DataFrame:
    return t.embeddings.agg(F.count_if(F.col("embedding").isNull()).alias("vectors"), F.count("*").alias("n"))


@query("p08_eligible", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 0")
def p08(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 0)).select("o_orderkey")


@query("p13_any_keyword", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'red') OR contains(lower(concat_ws(' ', p_name, p_type)), 'gizmo') ORDER BY p_partkey LIMIT 10")
def p13(t: Tables) -> DataFrame:
    both = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.where(F.exists(F.array(F.lit("red"), F.lit("gizmo")), lambda k: F.contains(both, k))).select("p_partkey").orderBy("p_partkey").limit(10)


@query(
    "p16_question_tests",
    "SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{N}]') AS searchable, regexp_matches(text, '(?i)tr[âa]nsito|9\\.503|\\bCTB\\b|ve[íi]culo|condutor|habilita[çc][ãa]o|motorista|rodovi') AS traffic FROM documents",
)
def p16(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", Q.searchable(c).alias("searchable"), Q.about_traffic(c).alias("traffic"))


MARKS = ", ".join(repr(w) for w in V.ENGLISH)


@query(
    "p19_english",
    "WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ú]+') AS w FROM documents),"
    f" m AS (SELECT doc_id, text, len(w) AS n, len(list_filter(w, lambda x: x IN ({MARKS}))) AS m FROM w) SELECT doc_id, n >= 3 AND"
    " (regexp_matches(text, '(?im)(?:^|\\n)\\s*(?:summary|answer|procedure|steps?|source|question|response)\\s*:') OR m >= 3 OR (m >= 2 AND m / n >= 0.12)) AS english FROM m",
)
def p19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", Q.looks_english(F.col("text")).alias("english"))


@query(
    "p20_metadata",
    "SELECT o_orderkey, try_cast(d AS DATE) IS NULL AS unreal, coalesce(try_cast(d AS DATE) > DATE '1998-01-15', false) AS future FROM"
    " (SELECT o_orderkey, concat('1998-01-', lpad(cast(o_orderkey % 40 as varchar(9)), 2, '0')) AS d FROM orders)",
)
def p20(t: Tables) -> DataFrame:
    d = F.try_to_date(F.concat(F.lit("1998-01-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")))
    return t.orders.select("o_orderkey", d.isNull().alias("unreal"), F.coalesce(d > F.lit("1998-01-15").cast("date"), F.lit(False)).alias("future"))


@query(
    "p21_constraints",
    "SELECT doc_id, (n_chars IS NOT NULL AND n_chars >= 0) AS has_length, lang IS NOT NULL AS has_lang, coalesce(length(text) = n_chars, false) AS agrees FROM documents",
)
def p21(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select("doc_id", (n.isNotNull() & F.coalesce(n >= 0, F.lit(False))).alias("has_length"), F.col("lang").isNotNull().alias("has_lang"),
                              F.coalesce(F.length("text") == n, F.lit(False)).alias("agrees"))


KEY = "lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query(
    "a02_local_integrity",
    f"WITH r AS (SELECT doc_id, length(trim(coalesce(text, ''))) AS n, source IS NULL AS loose, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS k FROM documents)"
    " SELECT count(*) AS items, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n BETWEEN 1 AND 19) AS short, count(*) FILTER (loose) AS unstructured,"
    " count(*) FILTER (n > 0 AND k > 1) AS duplicates FROM r",
)
def a02(t: Tables) -> DataFrame:
    c = F.coalesce("text", F.lit(""))
    n, w = F.length(F.trim(c)), Window.partitionBy(T.content_key(c)).orderBy("doc_id")
    r = t.documents.select(n.alias("n"), F.col("source").isNull().alias("loose"), F.row_number().over(w).alias("k"))
    return r.agg(F.count("*").alias("items"), F.count_if(F.col("n") == 0).alias("empty"),
                 F.count_if(F.col("n").between(1, 19)).alias("short"), F.count_if("loose").alias("unstructured"),
                 F.count_if((F.col("n") > 0) & (F.col("k") > 1)).alias("duplicates"))


@query(
    "a04_cache_stats",
    "SELECT count(*) AS total, count(*) FILTER (NOT e) AS valid, count(*) FILTER (e) AS expired, max(ts) AS latest FROM"
    " (SELECT ts, date_diff('day', CAST(ts AS DATE), DATE '2024-03-01') > user_id % 30 AS e FROM events)",
)
def a04(t: Tables) -> DataFrame:
    old = F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("ts")) > F.col("user_id") % 30
    return t.events.agg(F.count("*").alias("total"), F.count_if(~old).alias("valid"), F.count_if(old).alias("expired"), F.max("ts").alias("latest"))


@query(
    "a11_grouped_questions",
    f"SELECT role, lower(trim({MASKED})) AS q, count(*) AS frequency FROM conversations WHERE trim(text) <> '' GROUP BY ALL",
)
def a11(t: Tables) -> DataFrame:
    q = F.lower(F.trim(T.mask_identifiers(F.col("text"))))
    return t.conversations.where("trim(text) != ''").groupBy("role", q.alias("q")).agg(F.count("*").alias("frequency"))


@query("a18_totals", "SELECT CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (text IS NULL) AS pending, bool_or(lang = 'en') AS any_en FROM documents")
def a18(t: Tables) -> DataFrame:
    return t.documents.agg(F.sum("n_chars").alias("chars"), F.count_if(F.col("text").isNull()).alias("pending"), F.bool_or(F.col("lang") == "en").alias("any_en"))


@query(
    "o02_reading_order",
    f"WITH s AS (SELECT o_orderkey, {LABEL} AS label FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY CAST(regexp_extract(label, '(\\d+)', 1) AS BIGINT),"
    " CASE WHEN label LIKE '%-A' THEN 'a' ELSE '' END, length(label), o_orderkey) AS place FROM s",
)
def o02(t: Tables) -> DataFrame:
    return usage.numbered(labels(t).withColumn("k", Q.article_key(F.col("label"))), ("k", "asc"), ("o_orderkey", "asc")).select("o_orderkey", "place")


@query(
    "o05_recent_distinct",
    "SELECT user_id, event_type, latest FROM (SELECT user_id, event_type, max(ts) AS latest FROM events GROUP BY ALL)"
    " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, event_type) <= 5",
)
def o05(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("latest"))
    w = Window.partitionBy("user_id").orderBy(F.col("latest").desc(), "event_type")
    return last.withColumn("_r", F.row_number().over(w)).where("_r <= 5").drop("_r")


@query(
    "w02_limit_before",
    "SELECT event_id, used < 5 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS used FROM events)",
)
def w02(t: Tables) -> DataFrame:
    return usage.rolling_limit(t.events, "user_id", "ts", 5).select("event_id", (F.col("used") - 1 < 5).alias("allowed"))


@query(
    "t07_breaker",
    "WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type = 'click' AS f FROM events), g AS (SELECT *, count(*) FILTER (NOT f) OVER (PARTITION BY user_id ORDER BY us, event_id"
    " ROWS UNBOUNDED PRECEDING) AS g FROM c), s AS (SELECT *, count(*) FILTER (f) OVER (PARTITION BY user_id, g ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)"
    " SELECT event_id, streak, CASE WHEN f AND streak >= 2 THEN us + 120000000 END AS blocked_until FROM s",
)
def t07(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    calls = t.events.select("event_id", "user_id", us.alias("us"), (F.col("event_type") == "click").alias("failed"))
    return usage.breaker(calls, "user_id", "us", "event_id", "failed").select("event_id", "streak", "blocked_until")


@query(
    "c12_inspection",
    "WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000 AS DOUBLE) AS kg, CASE WHEN l_linenumber = 7 THEN NULL ELSE 24000.0::DOUBLE END AS lim, l_linenumber % 2 = 0 AS scale FROM lineitem),"
    " e AS (SELECT *, CASE WHEN scale THEN lim * 1.05::DOUBLE ELSE lim END AS top FROM s), x AS (SELECT *, greatest(kg - top, 0) AS x, greatest(kg - 40000, 0) AS p FROM e)"
    " SELECT l_orderkey, l_linenumber, CASE WHEN lim IS NULL THEN 'inconclusivo' WHEN x > 0 OR p > 0 THEN 'autuavel' WHEN scale AND kg > lim THEN 'dentro-tolerancia' ELSE 'regular' END AS status,"
    " CASE WHEN lim IS NULL THEN '' ELSE concat_ws(',', CASE WHEN x > 0 THEN '683-11' END, CASE WHEN p > 1000 THEN '690-40' WHEN p > 600 THEN '689-00' WHEN p > 0 THEN '688-20' END) END AS codes,"
    " CAST(CASE WHEN lim IS NULL THEN 0 ELSE CASE WHEN x > 0 THEN 13016 + ceil(x / 200) * (CASE WHEN x <= 600 THEN 532 WHEN x <= 800 THEN 1064 WHEN x <= 1000 THEN 2128 WHEN x <= 3000 THEN 3192 WHEN x <= 5000 THEN 4256 ELSE 5320 END) ELSE 0 END"
    " + CASE WHEN p > 1000 THEN ceil(p / 500) * 29347 WHEN p > 600 THEN 19523 WHEN p > 0 THEN 13016 ELSE 0 END END AS BIGINT) AS cents FROM x",
)
def c12(t: Tables) -> DataFrame:
    kg, n, none = F.col("l_quantity") * 1000.0, F.col("l_linenumber"), F.lit(None).cast("double")
    axles = F.lit(None).cast("array<struct<kg:double,legal:double,technical:double>>")
    out = rules.inspection(F.when(n != 7, F.lit(24000.0)), F.when(n % 2 == 0, "balanca").otherwise("peso-bruto-total"), none, none, kg, kg, F.lit(40000.0), axles, F.lit(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", out.alias("o")).select("l_orderkey", "l_linenumber", "o.status", F.array_join("o.codes", ",").alias("codes"), "o.cents")


ASKED = "CASE o_orderkey % 5 WHEN 0 THEN 'moto sem capacete' WHEN 1 THEN 'celular na mao' WHEN 2 THEN 'dirigir bebado' WHEN 3 THEN 'vias de fato na rua' ELSE 'bom dia' END"


@query(
    "q09_synonyms",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'moto sem capacete motocicleta motoneta ciclomotor capacete de segurança' WHEN 1 THEN 'celular na mao telefone celular segurando telefone celular'"
    " WHEN 2 THEN 'dirigir bebado influência de álcool' WHEN 3 THEN 'vias de fato na rua' ELSE 'bom dia' END AS expanded FROM orders",
)
def q09(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", Q.expand(F.expr(ASKED)).alias("expanded"))


@query(
    "q12_compare_codes",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('516-9', o_orderkey % 10) ELSE '' END AS codes FROM orders",
)
def q12(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % 10).cast("string")
    q = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "comparar 516-9").otherwise("ver 516-9"), n, F.lit(" e 5169"), n)
    return t.orders.select("o_orderkey", F.array_join(Q.codes_to_compare(q), ",").alias("codes"))


@query(
    "f21_page_selection",
    "SELECT o_orderkey, CASE WHEN a < 1 THEN '' WHEN b = 0 THEN concat(a, ', ', a + 20) ELSE concat(a, '–', a + b, ', ', a + 20) END AS canonical,"
    " CASE WHEN a < 1 THEN 'below one' END AS problem FROM (SELECT o_orderkey, o_orderkey % 7 AS a, o_orderkey % 9 AS b FROM orders)",
)
def f21(t: Tables) -> DataFrame:
    a, b = F.col("o_orderkey") % 7, F.col("o_orderkey") % 9
    s = F.concat((a + 20).cast("string"), F.lit(", "), a.cast("string"), F.lit("-"), (a + b).cast("string"))
    return t.orders.select("o_orderkey", F.inline(F.array(Q.page_selection(s)))).drop("pages")


@query("k15_label_matcher")
def k15(t: Tables) -> DataFrame:
    pairs = [(term, d) for terms, dest in V.CODE_ALIASES for term in terms for d in dest]
    aliases = t.spark.createDataFrame(pairs, "term string, id string")  # the fixed table
    items = aliases.select("id").distinct().withColumn("label", F.concat(F.lit("codigo "), "id"))
    asked = t.orders.select(F.col("o_orderkey").alias("qid"), F.expr(ASKED).alias("text"))
    return M.match_labels(asked, items, aliases).select("qid", "id", "score", "method", F.col("rank").cast("long").alias("rank"))


@query(
    "k23_longest_key",
    "SELECT c_custkey AS qid, n_nationkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def k23(t: Tables) -> DataFrame:
    q = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    q = q.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("motorista de "), "n_name", F.lit(" no pais")).alias("text"))
    keys = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"))
    return M.longest_key(q, keys).select("qid", "id")


@query(
    "k25_suggest",
    "SELECT c_custkey AS qid, n_nationkey AS id FROM customer, nation WHERE starts_with(lower(n_name), lower(left((SELECT any_value(x.n_name) FROM nation x WHERE x.n_nationkey = c_nationkey), 4)))"
    " QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(n_name), lower(n_name), n_nationkey) <= 5",
)
def k25(t: Tables) -> DataFrame:
    q = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    q = q.select(F.col("c_custkey").alias("qid"), F.left("n_name", F.lit(4)).alias("text"))
    return M.suggest(q, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("qid", "id")


@query(
    "q13_keywords",
    "WITH w AS (SELECT conv_id, turn, text, regexp_split_to_array(lower(text), '[^a-zà-ú0-9]+') AS w FROM conversations), f AS (SELECT conv_id, turn, list_filter(w,"
    f" lambda x: len(x) >= 4 AND x NOT IN ({', '.join(repr(w) for w in Q.EMPTY_WORDS)})) AS w FROM w)"
    " SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:6], ' ') AS words FROM f WHERE w IS NOT NULL",
)
def q13(t: Tables) -> DataFrame:
    return t.conversations.where("text is not null").select("conv_id", "turn", F.array_join(Q.keywords(F.col("text")), " ").alias("words"))


@query(
    "q14_follow_up",
    "SELECT conv_id, turn, md5(concat_ws(' ', lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), text)) AS context FROM conversations WHERE role = 'user'",
)
def q14(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    asked = t.conversations.where("role = 'user'")
    return asked.select("conv_id", "turn", F.md5(F.concat_ws(" ", F.lag("text").over(w), "text")).alias("context"))


@query(
    "s23_newest_version",
    "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1",
)
def s23(t: Tables) -> DataFrame:
    return usage.latest(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], F.col("doc_id").desc())


@query("s22_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def s22(t: Tables) -> DataFrame:
    gone = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("j01_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    "j04_lateral_first",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey",
)
def j04(t: Tables) -> DataFrame:
    one = usage.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey"))
    return t.customer.join(one, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("u02_distinct", "SELECT DISTINCT lang, source FROM documents")
def u02(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()


@query(
    "c19_dossier_key",
    "SELECT o_orderkey, concat_ws(':', o_orderpriority, CASE WHEN o_orderstatus < 'b' THEN o_orderstatus || '+b' ELSE 'b+' || o_orderstatus END, 'v1') AS k FROM orders",
)
def c19(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", rules.dossier_key(F.col("o_orderpriority"), F.array("o_orderstatus", F.lit("b")), F.lit("v1")).alias("k"))


@query(
    "s04_inline_table",
    "SELECT n_nationkey, n_name AS country, array_to_string(list_filter(string_split(CASE n_nationkey % 3 WHEN 0 THEN 'A,R' WHEN 1 THEN 'V' ELSE '' END, ','), lambda x: x <> ''), '+') AS instruments FROM nation",
)
def s04(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    line = F.concat_ws("|", "n_name", F.when(k % 3 == 0, "A,R").when(k % 3 == 1, "V").otherwise(""), k.cast("string"))
    cells = F.split(line, r"\|", -1)
    signs = F.filter(F.split(cells[1], ","), lambda x: x != "")
    return t.nation.select("n_nationkey", cells[0].alias("country"), F.array_join(signs, "+").alias("instruments"))


@query("p12_array_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'small', 'green'])")
def p12(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("red", "small", "green")))
    return t.part.where(F.arrays_overlap(F.split(F.lower("p_name"), " "), wanted)).select("p_partkey")


@query("p14_in_force", "SELECT doc_id, lang IS NULL AS in_force FROM documents")
def p14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("lang").isNull().alias("in_force"))


@query(
    "k03_prior",
    "WITH s AS (SELECT o_custkey AS qid, o_orderkey AS id, round(o_totalprice * CASE WHEN o_orderkey % 300 BETWEEN 161 AND 255 THEN 1.04::DOUBLE ELSE 1 END, 6) AS score FROM orders)"
    " SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s",
)
def k03(t: Tables) -> DataFrame:
    prior = F.when((F.col("o_orderkey") % 300).between(161, 255), 1.04).otherwise(1.0)
    s = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * prior, 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return s.select("qid", "id", F.row_number().over(w).cast("long").alias("rank"))


@query("a08_exact_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM documents WHERE text IS NULL) AS pending")
def a08(t: Tables) -> DataFrame:
    counts = (("orders", t.orders), ("customers", t.customer), ("pending", t.documents.where("text is null")))
    one = [d.agg(F.count("*").alias(n)) for n, d in counts]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


@query("a23_pending_per_document", "SELECT source, count(*) FILTER (lang IS NULL) AS pending, count(*) AS n FROM documents GROUP BY source")
def a23(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count_if(F.col("lang").isNull()).alias("pending"), F.count("*").alias("n"))


@query("o01_mixed_order", "SELECT doc_id, lang, row_number() OVER (ORDER BY lang ASC NULLS LAST, n_chars DESC NULLS LAST, doc_id) AS place FROM documents")
def o01(t: Tables) -> DataFrame:
    order = (("lang", "asc_nulls_last"), ("n_chars", "desc_nulls_last"), ("doc_id", "asc"))
    return usage.numbered(t.documents.drop("text"), *order).select("doc_id", "lang", "place")


@query("u01_union_all", "SELECT c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_name, 's' FROM supplier")
def u01(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_name").alias("name"), F.lit("c").alias("kind")).unionByName(
        t.supplier.select(F.col("s_name").alias("name"), F.lit("s").alias("kind"))
    )


@query("j14_folded_name", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON lower(a.n_name) = lower(upper(b.n_name))")
def j14(t: Tables) -> DataFrame:
    left = t.nation.select(F.col("n_nationkey").alias("a"), T.fold(F.col("n_name")).alias("k"))
    right = t.nation.select(F.col("n_nationkey").alias("b"), T.fold(F.upper("n_name")).alias("k"))
    return left.join(right, "k").select("a", "b")


@query("f16_embedding_input", "SELECT doc_id, md5(concat_ws(' · ', source, lang) || chr(10) || coalesce(text, '')) AS input FROM documents")
def f16(t: Tables) -> DataFrame:
    whole = F.concat(F.concat_ws(" · ", "source", "lang"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", F.md5(whole).alias("input"))


@query("f22_clamp", "SELECT o_orderkey, greatest(1, least(coalesce(nullif(o_orderkey % 200, 0), 10), 100)) AS n FROM orders")
def f22(t: Tables) -> DataFrame:
    n = F.coalesce(F.nullif(F.col("o_orderkey") % 200, F.lit(0)), F.lit(10))
    return t.orders.select("o_orderkey", F.greatest(F.lit(1), F.least(n, F.lit(100))).cast("long").alias("n"))
