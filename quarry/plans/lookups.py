"""Queries of the lookups, each asked with every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import lookups as L
from quarry.plans.base import Tables, query

#: What customers type for a nation: its name, a wildcard for a letter, its first letters and a wildcard, and a backslash.
TYPED = "CASE c_custkey % 4 WHEN 0 THEN concat(' ', lower(n_name)) WHEN 1 THEN replace(n_name, 'A', '_') WHEN 2 THEN concat(left(n_name, 2), '%') ELSE concat(n_name, chr(92)) END"


@query(
    "p02_label_lookup",
    f"WITH a AS (SELECT c_custkey AS qid, {TYPED} AS typed FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT qid, n_nationkey AS id,"
    r" n_name ILIKE replace(replace(replace(trim(typed), '\', '\\'), '%', '\%'), '_', '\_') ESCAPE '\' AS literal FROM a JOIN nation ON lower(n_name) = lower(trim(typed))",
)
def p02(t: Tables) -> DataFrame:
    typed = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    typed = typed.select(F.col("c_custkey").alias("qid"), F.expr(TYPED).alias("text"))
    names = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(None).cast("int").alias("place"))
    found = L.by_label(typed, names).join(typed, "qid").join(names.select("id", "label"), "id")
    return found.select("qid", "id", F.ilike("label", L.like_pattern(F.trim("text")), F.lit("\\")).alias("literal"))


@query(
    "p02_literal_pattern",
    "SELECT p_partkey, contains(lower(p_name), 'red') AS plain, contains(p_type || '50%_' || p_brand, '0%_B') AS wild, contains(p_name, 'r%d') AS none FROM part",
)
def p02_pattern(t: Tables) -> DataFrame:
    inside = lambda c, x: F.ilike(c, F.concat(F.lit("%"), L.like_pattern(F.lit(x)), F.lit("%")), F.lit("\\"))
    priced = F.concat("p_type", F.lit("50%_"), "p_brand")
    return t.part.select("p_partkey", inside(F.col("p_name"), "RED").alias("plain"), inside(priced, "0%_b").alias("wild"), inside(F.col("p_name"), "r%d").alias("none"))


#: References that orders make, and rows: labels of parts, some of which name a clause, others have it in their texts.
REFERENCE = (
    "concat(CASE o_orderkey % 3 WHEN 0 THEN 'Ver o Art. ' ELSE 'art ' END, cast(o_orderkey % 290 as varchar(9)), CASE o_orderkey % 5 WHEN 0 THEN '-B' ELSE '' END,"
    " CASE o_orderkey % 4 WHEN 0 THEN ', inciso XVII do CTB' WHEN 1 THEN ' iv e vi' WHEN 2 THEN '' ELSE ' do CTB' END)"
)
ROW_LABEL = "concat(CASE p_partkey % 7 WHEN 0 THEN 'CTB, art. ' ELSE 'Art. ' END, cast(p_partkey % 311 as varchar(9)), CASE p_partkey % 5 WHEN 0 THEN '-b' ELSE '' END, CASE p_size % 4 WHEN 0 THEN ' XVII' WHEN 1 THEN ' IV' ELSE '' END)"
ROW_TEXT = "CASE p_size % 3 WHEN 0 THEN concat(p_name, chr(10), 'XVII - ', p_brand) WHEN 1 THEN concat('VI – ', p_name) END"
NAMED = "regexp_extract(lower({0}), 'art\\.?\\s*(\\d+)', 1) AS n_{1}, regexp_extract(lower({0}), 'art\\.?\\s*\\d+-([a-z])', 1) AS l_{1}"


@query(
    "p03_best_reference",
    f"WITH a AS (SELECT o_orderkey AS qid, {REFERENCE} AS r FROM orders), b AS (SELECT *, {NAMED.format('r', 'a')}, CASE qid % 4 WHEN 0 THEN ['XVII'] WHEN 1 THEN ['IV', 'VI'] ELSE [] END AS cs FROM a),"
    f" p AS (SELECT p_partkey AS id, {ROW_LABEL} AS label, {ROW_TEXT} AS text, CASE WHEN p_size % 2 = 0 THEN p_size END AS place FROM part), r AS (SELECT *, {NAMED.format('label', 'p')} FROM p),"
    " h AS (SELECT qid, id, n_p::BIGINT AS n, l_p, length(label) AS size, place, coalesce(list_sum(list_transform(cs, lambda c: CASE WHEN suffix(label, ' ' || c) THEN 10"
    " WHEN starts_with(coalesce(text, ''), c || ' ') OR contains(coalesce(text, ''), chr(10) || c || ' ') THEN 5 ELSE 0 END)), 0)::INT AS points FROM b JOIN r ON n_a = n_p AND l_a = l_p)"
    " SELECT qid, id, points FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY points DESC, place NULLS LAST, n, l_p, size, id) = 1",
)
def p03(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_orderkey").alias("qid"), F.expr(REFERENCE).alias("text"))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.expr(ROW_LABEL).alias("label"), F.expr(ROW_TEXT).alias("text"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("place"))
    return L.by_reference(asked, rows)


META = {
    "source": "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END",
    "version": "CASE WHEN o_orderkey % 13 > 0 THEN 'v1' END",
    "effective": "concat('1998-0', cast(1 + o_orderkey % 9 as varchar(9)), '-', lpad(cast(o_orderkey % 33 as varchar(9)), 2, '0'))",
    "checked": "concat('1998-0', cast(1 + o_custkey % 9 as varchar(9)), '-', lpad(cast(o_custkey % 32 as varchar(9)), CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 2 END, '0'))",
    "state": "CASE o_orderstatus WHEN 'F' THEN 'vigente' WHEN 'O' THEN 'revisar' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'velho' END END",
}


@query(
    "p20_problems",
    f"WITH m AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in META.items())} FROM orders), d AS (SELECT *,"
    " CASE WHEN regexp_full_match(effective, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(effective AS DATE) END AS e, CASE WHEN regexp_full_match(checked, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(checked AS DATE) END AS c FROM m)"
    " SELECT o_orderkey, array_to_string(list_filter([CASE WHEN trim(source) = '' THEN 'source' END, CASE WHEN version IS NULL THEN 'version' END, CASE WHEN e IS NULL THEN 'effective' END,"
    " CASE WHEN c IS NULL THEN 'checked' END, CASE WHEN state = 'velho' THEN 'state' END, CASE WHEN c < e THEN 'checked early' END, CASE WHEN e IS NOT NULL AND c > DATE '1998-06-15' THEN 'checked late' END],"
    " lambda x: x IS NOT NULL), ',') AS problems FROM d",
)
def p20(t: Tables) -> DataFrame:
    m = t.orders.select("o_orderkey", *[F.expr(e).alias(n) for n, e in META.items()])
    found = L.metadata_problems(*[F.col(n) for n in META], F.lit("1998-06-15").cast("date"))
    return m.select("o_orderkey", F.array_join(found, ",").alias("problems"))


@query(
    "k03_infraction_prior",
    "WITH s AS (SELECT o_custkey AS qid, o_orderkey AS id, 'Art. ' || (o_orderkey % 300) AS label, floor(o_totalprice / 4000) AS score FROM orders),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS former FROM s), l AS (SELECT *, score * CASE WHEN id % 300 BETWEEN 161 AND 255 THEN 1.04::DOUBLE ELSE 1 END AS lifted FROM r)"
    " SELECT qid, id, round(lifted, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY lifted DESC, former) AS rank FROM l",
)
def k03(t: Tables) -> DataFrame:
    from quarry.operators.retrieval import rank_by

    s = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.concat(F.lit("Art. "), F.col("o_orderkey") % 300).alias("label"),
                        F.floor(F.col("o_totalprice") / 4000).cast("double").alias("score"))
    out = L.infraction_prior(rank_by(s, "qid", F.col("score").desc(), F.col("id")))
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "s04_inline_rows",
    "WITH l AS (SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS line, p_name AS name, CASE p_size % 3 WHEN 0 THEN ['A', 'R'] WHEN 1 THEN ['V'] ELSE [] END AS signs,"
    " CASE WHEN p_size % 5 > 0 THEN p_size END AS page, p_partkey FROM part) SELECT brand, line, name, array_to_string(signs, '+') AS signs, page,"
    " CASE WHEN p_partkey % 2 = 0 THEN name ELSE 'form ' || p_partkey END AS value, CASE WHEN p_partkey % 4 = 1 THEN 'x+y' ELSE '' END AS aliases FROM l",
)
def s04(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    bar = F.lit("|")
    line = F.concat(
        "p_name", bar, F.when(F.col("p_size") % 3 == 0, "A,,R").when(F.col("p_size") % 3 == 1, "V").otherwise(""), bar, F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string")).otherwise("?"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("|form "), k)), F.when(k % 4 == 1, "|x,y").otherwise(""),
    )
    texts = t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    columns = [("name", "text"), ("signs", "list"), ("page", "int"), ("value", "text=name"), ("aliases", "list")]
    out = L.inline_table(texts, "brand", "text", columns)
    return out.select("brand", F.col("line").cast("long").alias("line"), "name", F.array_join("signs", "+").alias("signs"), "page", "value", F.array_join("aliases", "+").alias("aliases"))
