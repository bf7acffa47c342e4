"""Queries of printed and marked-up text: every document is laid out by its sentences, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import paged
from quarry.plans.base import Tables, query

#: How sentence x of number i (from 0) is laid out, in SQL of both engines.
MARKED = (
    "CASE i % 10 WHEN 0 THEN concat('# ', x) WHEN 1 THEN concat('**', x, '** fim') WHEN 2 THEN concat('  * ', x) WHEN 3 THEN concat('> ', x, '  ', chr(13)) WHEN 4 THEN concat('| ', x, ' |  b|')"
    " WHEN 5 THEN '|---|:---:|' WHEN 6 THEN concat('[', x, '](http://a/b) ![alt](i.png)') WHEN 7 THEN concat('```py', chr(10), x) WHEN 8 THEN concat('<b>', x, '</b> `c`', chr(10), chr(10), chr(10)) ELSE concat('um *', x, '* dois') END"
)
WRAPPED = (
    "concat(x, CASE i % 7 WHEN 0 THEN concat('a-', chr(10), 'se ') WHEN 1 THEN concat(' infra-', chr(10), 'ção, ') WHEN 2 THEN concat(chr(10), 'Art. ', i, ' ') WHEN 3 THEN concat('  ', chr(10), chr(13), chr(10), chr(10))"
    " WHEN 4 THEN concat(' e-', chr(10), 'Foo ') WHEN 5 THEN concat(chr(9), chr(160), ' ') ELSE concat(' vê-', chr(13), chr(10), 'losango.') END)"
)
PRINTED = "concat(x, '  ', chr(13), chr(10), CASE WHEN i % 4 = 1 THEN concat('--- PÁGINA 0', i, ' --', chr(10)) ELSE '' END, CASE WHEN i % 7 = 3 THEN concat(chr(10), chr(10), chr(10)) ELSE '' END)"
ARTICLES = (
    "concat(CASE WHEN i % 9 = 8 THEN concat(chr(12), ' HTTPS://a.b/c', chr(10), '02/03/2024, 08:15 lei', chr(10), chr(10), chr(10)) ELSE '' END,"
    " CASE WHEN i % 5 = 2 THEN concat('Art. ', i * 7 % 300, CASE WHEN i % 2 = 0 THEN 'A' ELSE '' END, 'º ') ELSE '' END, x)"
)
#: Lines of a page, and those above and below them.
PER_PAGE = 12


def laid(body: str, sep: str) -> Column:
    return F.expr(f"array_join(transform(split(text, '[.] '), (x, i) -> {body}), {sep})")


def laid_sql(body: str, sep: str) -> str:
    return f"SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda x, j: {body.replace(' i ', ' (j - 1) ').replace(' i,', ' (j - 1),')}), {sep}) AS t FROM documents WHERE text IS NOT NULL"


def chain(expression: str, *steps: tuple[str, str]) -> str:
    """SQL that rewrites by each pattern in turn."""
    for pattern, out in steps:
        expression = f"regexp_replace({expression}, '{pattern}', {out}, 'g')"
    return expression


BLANKS = ((r"\n{3,}", "repeat(chr(10), 2)"), (r"^[\s\x{A0}]+", "''"), (r"[\s\x{A0}]+$", "''"))
BREAKS = ((r"\r\n?", "chr(10)"), (r"[ \t\x{A0}]+\n", "chr(10)"), *BLANKS)
ROWS = r"array_to_string(list_transform(string_split(b, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^[ \t]*\|.*\|[ \t]*$') THEN array_to_string(list_transform(string_split(regexp_extract(l, '^[ \t]*\|(.*)\|[ \t]*$', 1), '|'), lambda c: trim(c)), ' | ') ELSE l END), chr(10))"


@query(
    "s10_plain_markdown",
    f"WITH d AS ({laid_sql(MARKED, 'chr(10)')}), b AS (SELECT doc_id, "
    + chain(chain("t", *BREAKS), ("(?m)^```.*$", "''"), (r"!\[([^\]]*)\]\([^)]*\)", r"'\1'"), (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"), ("(?i)</?[a-z][^>]*>", "''"),
            (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", "''"))
    + f" AS b FROM d), r AS (SELECT doc_id, {ROWS} AS r FROM b) SELECT doc_id, "
    + chain("r", (r"\*\*(\S|\S[\s\S]*?\S)\*\*", r"'\1'"), (r"(?m)(^|[\s(])[*_](\S|[^*_\s][^*_\n]*?\S)[*_]([\s).,;:!?]|$)", r"'\1\2\3'"), ("`([^`]+)`", r"'\1'"),
            (r"(?m)^[ \t]*>[ \t]?", "''"), (r"(?m)^([ \t]*)[*+][ \t]+", r"'\1- '"), *BLANKS)
    + " AS plain FROM r",
)
def s10(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.plain_markdown(laid(MARKED, "chr(10)")).alias("plain"))


@query(
    "f18_page_marks",
    f"WITH d AS ({laid_sql(PRINTED, repr(''))}), m AS (SELECT doc_id, {chain(chain('t', *BREAKS), (r'(?im)^-{2,}[ ]*P[áa]gina[ ]+0*([0-9]+)[ ]*-{2,}$', chr(39) + r'[[pagina:\1]]' + chr(39)))} AS marked FROM d)"
    " SELECT doc_id, marked, " + chain("marked", (r"(?m)^\[\[pagina:[0-9]+\]\]$", "''"), *BLANKS) + " AS bare FROM m",
)
def f18(t: Tables) -> DataFrame:
    marked = t.documents.where("text is not null").select("doc_id", T.page_marks(T.line_breaks(laid(PRINTED, "''"))).alias("marked"))
    return marked.withColumn("bare", T.without_page_marks(F.col("marked")))


@query(
    "f19_printed_text",
    f"WITH d AS ({laid_sql(WRAPPED, repr(''))}) SELECT doc_id, "
    + chain("t", (r"\r\n?", "chr(10)"), (r"[ \t\x{A0}]+", "' '"), (r" *\n *", "chr(10)"), (rf"(\pL)-\n({T.CLITICS})([^\pL]|$)", r"'\1-\2\3'"), (r"(\pL)-\n(\p{Ll}+)([^\pL]|$)", r"'\1\2\3'"),
            (r"\n(Art\.?|Artigo|§|CAP[IÍ]TULO|T[IÍ]TULO|SE[CÇ][AÃ]O|Se[cç][aã]o)(\s)", r"chr(10) || chr(10) || '\1\2'"), *BLANKS)
    + " AS printed FROM d",
)
def f19(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.printed_text(laid(WRAPPED, "''")).alias("printed"))


@query(
    "s03_article_slices",
    f"WITH d AS ({laid_sql(ARTICLES, repr('. '))}), p AS (SELECT doc_id, unnest(string_split(t, chr(12))) AS raw, generate_subscripts(string_split(t, chr(12)), 1) AS page FROM d),"
    r" l AS (SELECT doc_id, page, array_to_string(list_filter(string_split(raw, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*https?://|^\s*[0-9]{2}/[0-9]{2}/[0-9]{4},\s+[0-9]{2}:[0-9]{2}')), chr(10)) AS x FROM p),"
    " c AS (SELECT doc_id, page, " + chain("x", (r"\n{3,}", "repeat(chr(10), 2)"), (r"[ \t]+", "' '"), *BLANKS[1:]) + " AS x FROM l),"
    r" s AS (SELECT doc_id, page, list_filter(string_split(regexp_replace(x, '(^|[^A-Za-z0-9_])(Art\.\s*[0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: y <> '') AS parts FROM c),"
    " u AS (SELECT doc_id, page, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS part FROM s), k AS (SELECT doc_id, page, part, " + chain("raw", *BLANKS[1:]) + " AS text FROM u)"
    r" SELECT doc_id, page::INT AS page, part::INT AS part, coalesce(last_value('Art. ' || nullif(regexp_extract(text, '^Art\.\s*([0-9]+[A-Z]?)', 1), '') IGNORE NULLS)"
    f" OVER (PARTITION BY doc_id ORDER BY page, part), '{paged.BEFORE_ARTICLES}') AS label, text FROM k WHERE length(text) >= 40",
)
def s03(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null").select("doc_id", laid(ARTICLES, "'. '").alias("text"))
    return paged.article_slices(docs, "doc_id", "text")


@query(
    "c06_running_headers",
    "WITH d AS (SELECT doc_id, coalesce(source, '-') AS s, coalesce(lang, '-') AS g, string_split(text, '. ') AS l FROM documents WHERE text IS NOT NULL),"
    f" k AS (SELECT *, ceil(len(l) / {PER_PAGE})::INT AS np, unnest(range(1, ceil(len(l) / {PER_PAGE})::INT + 1))::INT AS page FROM d),"
    f" p AS (SELECT doc_id, page, array_to_string(list_concat([upper(s), '', 'Pág. ' || page || ' de ' || np, 'Diário ' || page], l[{PER_PAGE} * page - {PER_PAGE - 1} : {PER_PAGE} * page], ['Art. 1 Repetida', '- ' || page || ' -', '  ' || g]), chr(10)) AS text FROM k),"
    " x AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),"
    r" f AS (SELECT *, regexp_matches(line, '\S') AS filled, sum(filled::INT) OVER (PARTITION BY doc_id, page ORDER BY i) AS r, sum(filled::INT) OVER (PARTITION BY doc_id, page) AS n FROM x),"
    r" e AS (SELECT *, CASE WHEN filled AND r <= 5 THEN 't' WHEN filled AND r > n - 3 THEN 'b' END AS edge, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key, regexp_replace(key, '[0-9]+', '#', 'g') AS mask,"
    r" regexp_matches(line, '(?i)p[áa]g(?:ina)?\.?\s*[0-9]|\bpage\s*[0-9]|[0-9]+\s*(?:de|/)\s*[0-9]+') AS names, regexp_matches(key, '^(?:art\.?\s*[0-9]|artigo\s|§|par[áa]grafo|[ivxl]+\s*[-–—]|infra[çc][ãa]o|penalidade|medida\s+administrativa)') AS law FROM f),"
    " t AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY doc_id), a AS (SELECT doc_id, edge, key, count(DISTINCT page) AS seen FROM e WHERE edge IS NOT NULL GROUP BY ALL),"
    " m AS (SELECT doc_id, edge, mask, count(DISTINCT page) AS seen FROM e WHERE edge IS NOT NULL AND names GROUP BY ALL),"
    r" o AS (SELECT e.doc_id, page, i, line, pages >= 3 AND e.edge IS NOT NULL AND NOT law AND (regexp_matches(e.mask, '^(?:p[áa]g(?:ina)?\.?\s*)?#(?:\s*(?:de|/)\s*#)?$|^-\s*#\s*-$')"
    " OR a.seen >= greatest(3, ceil(pages / 2)) OR names AND m.seen >= greatest(3, ceil(pages / 2))) AS gone"
    " FROM e JOIN t USING (doc_id) LEFT JOIN a ON a.doc_id = e.doc_id AND a.edge = e.edge AND a.key = e.key LEFT JOIN m ON m.doc_id = e.doc_id AND m.edge = e.edge AND m.mask = e.mask)"
    " SELECT doc_id, page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '') AS text FROM o GROUP BY doc_id, page",
)
def c06(t: Tables) -> DataFrame:
    n = f"cast(ceil(size(l) / {PER_PAGE}) as int)"
    sized = t.documents.where("text is not null").select("doc_id", F.coalesce("source", F.lit("-")).alias("s"), F.coalesce("lang", F.lit("-")).alias("g"), F.expr("split(text, '[.] ')").alias("l"))
    each = sized.withColumn("np", F.expr(n)).withColumn("page", F.explode(F.expr("sequence(1, np)")))
    lines = f"concat(array(upper(s), '', concat('Pág. ', page, ' de ', np), concat('Diário ', page)), slice(l, {PER_PAGE} * (page - 1) + 1, {PER_PAGE}), array('Art. 1 Repetida', concat('- ', page, ' -'), concat('  ', g)))"
    return paged.without_running_headers(each.select("doc_id", "page", F.expr(f"array_join({lines}, chr(10))").alias("text")), "doc_id", "page", "text")
