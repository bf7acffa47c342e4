"""Scalar text functions as Column expressions: folding, masks, references, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unmarked() -> tuple[str, str]:
    """All letters whose canonical decomposition is one character with combining marks, and those characters."""
    pairs = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        base = [x for x in unicodedata.normalize("NFD", c) if x not in MARKS]
        if len(base) == 1 and base[0] != c:
            pairs[c] = base[0].lower()
    return "".join(pairs), "".join(pairs.values())


#: Combining marks that folding leaves out.
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED, PLAIN = _unmarked()

# Patterns and word lists that results depend on.
CODE = r"(?<![\p{L}\d./-])(\d{3}\s*[-–/.]\s*\d{2}|\d{4}\s*[-–/.]\s*\d|\d{3}\s+\d{2}|\d{5})(?![\p{L}\d./-])"
CNH = r"(?i)\b(cnh|carteira de habilitação|carteira de motorista)(\s*:?\s*)\d{11}\b"
PLATE = r"(?i)\b[A-Z]{3}-?\d[A-Z0-9]\d{2}\b|\b[A-Z]{3}\d{2}[A-Z]\d{3}\b"
CNPJ = r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
CPF = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b"
PHONE = r"(?<!\d)(?:\+?55\s*)?(?:(?:\(\d{2}\)|\d{2})\s*)?9?\d{4}[-\s]?\d{4}(?!\d)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
ARTICLE = r"(?i)art\.?\s+(\d+(?:\s*[-–§]\s*\d+[a-z]?)?)"
RESOLUTION = r"(?i)(?:res\.?|resolução)\s+(\d+/\d+)"
ORDINANCE = r"(?i)(?:port\.?|portaria)\s+(\d+/\d+)"
ARTICLE_REF = r"\b(?:art(?:igo|icle)?\.?\s*|ctb\s*(?:art(?:igo)?\.?)?\s*)(?:n(?:umero)?\.?\s*)?(\d{1,3})"
PROCEDURE = r"(?i)\bp\.?\s*o\.?\s*p\.?\s*[-–:]?\s*(?:n[ºo°.]?\s*)?(\d{1,3}(?:\.\d+){0,3})(?![\d.])"
STANDALONE = r"^\s*(\d{1,3}(?:\.\d+){0,3})\s*$"
INCIDENT = r"\b(?:natureza|fato comunicado|fato constatado|ocorrencia)\b|\b(?:suicid|cadaver|morto|vias de fato)\b"
OPERATION = r"\b(?:pop|procedimento|proceder|algema|busca pessoal|abordagem|barreira policial)\b"
TRAFFIC = r"\b(?:infracao|condutor|dirigir|veiculo|moto|carro|cnh|capacete|celular|estacion|transitar|ultrapass)\w*\b"
STOP_WORDS = (
    "que com para por pela pelo nos nas dos das uma uns umas the via quando como onde esta este isso essa "
    "ser ter tem sua seu qual quais deve devo fazer procedimento procedimentos proceder pop pops policial policia militar "
    "posso pode permitido permite preciso gostaria saber consulta consultar sobre enquadramento codigo infracao "
    "situacao favor maneira forma artigo art uso usar usando utilizar"
).split(" ")


def fold(c: Column) -> Column:
    """Lower case without accents (F01): canonical decomposition without combining marks. Characters that decompose into
    several others, as Hangul syllables do, stay whole."""
    return F.translate(F.lower(c), ACCENTED + MARKS, PLAIN)


def search_form(c: Column) -> Column:
    """fold(), with ``s/`` and ``c/`` spelt out."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"\bs\s*/\s*", "sem "), r"\bc\s*/\s*", "com ")


def match_form(c: Column) -> Column:
    """Letters and digits in single spaces."""
    return F.trim(F.regexp_replace(search_form(c), "[^a-z0-9]+", " "))


def cache_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def content_key(c: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased, single-spaced text."""
    return F.sha2(cache_form(c), 256)


def tokens(c: Column) -> Column:
    """Distinct search words of three letters or more that aren't stop words."""
    words = F.split(search_form(c), "[^a-z0-9]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def mask_identifiers(c: Column) -> Column:
    """Licence, plate, company and person numbers, in that order."""
    c = F.regexp_replace(c, CNH, "$1$2***********")
    c = F.regexp_replace(c, PLATE, "****")
    c = F.regexp_replace(c, CNPJ, "****-****")
    return F.regexp_replace(c, CPF, "***-****")


def anonymise(c: Column) -> Column:
    """mask_identifiers(), then mail, phone and IPv4 marks and single spaces."""
    c = F.regexp_replace(mask_identifiers(c), EMAIL, "[EMAIL]")
    c = F.regexp_replace(c, PHONE, "[TELEFONE]")
    c = F.regexp_replace(c, IPV4, "[IP]")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def citations(c: Column) -> Column:
    """Distinct article, resolution and ordinance references, by kind and first place."""
    def kind(pattern: str, prefix: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.concat(F.lit(prefix), F.lower(x)))

    found = [kind(ARTICLE, "art. "), kind(RESOLUTION, "res. "), kind(ORDINANCE, "port. ")]
    return F.array_distinct(F.concat(*found))


def code(c: Column) -> Column:
    """Code in its printed form ``ddd-dd``, null if there is none (Q02)."""
    digits = F.regexp_replace(F.regexp_extract(c, CODE, 1), r"\D", "")
    return F.when(digits != "", F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 9)))


def article_number(c: Column) -> Column:
    """Number of the article that a question names (Q03, Q05)."""
    return F.nullif(F.regexp_extract(F.regexp_replace(fold(F.trim(c)), "[º°]", ""), ARTICLE_REF, 1), F.lit(""))


def procedure(c: Column) -> Column:
    """Procedure number, three digits unless dotted (Q04)."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (PROCEDURE, STANDALONE)])
    return F.when(F.contains(n, F.lit(".")), n).otherwise(F.lpad(n, 3, "0"))


def query_type(c: Column) -> Column:
    """code, article or situation (Q01)."""
    article = article_number(c).isNotNull() | F.trim(c).rlike(r"(?i)^(?:inciso|inc|alínea|alinea)\b|^§")
    return F.when(code(F.trim(c)).isNotNull(), "code").when(article, "article").otherwise("situation")


def intent(c: Column) -> Column:
    """struct(intent, confidence): exact identifiers first, then vocabularies (Q06)."""
    text = search_form(c)
    ladder = (
        (code(c).isNotNull(), "codigo", 1.0), (article_number(c).isNotNull(), "artigo", 1.0),
        (procedure(c).isNotNull(), "pop", 1.0), (text.rlike(INCIDENT), "natureza_pmsc", 0.88),
        (text.rlike(OPERATION), "pop", 0.84), (text.rlike(TRAFFIC), "infracao", 0.82),
    )
    out = F.struct(F.lit("consulta_geral").alias("intent"), F.lit(0.5).alias("confidence"))
    for test, name, sure in reversed(ladder):
        out = F.when(test, F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def roman(c: Column) -> Column:
    """Value of a Roman numeral."""
    value = F.create_map(*[F.lit(x) for kv in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in kv])
    digits = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: value[x])
    last = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    folded = F.aggregate(
        F.reverse(digits), last,
        lambda a, x: F.struct((a["sum"] + F.when(x < a["top"], -x).otherwise(x)).alias("sum"), F.greatest(a["top"], x).alias("top")),
        lambda a: a["sum"],
    )
    return folded


def money(cents: Column) -> Column:
    """Cents as ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(cents / 100, 2), ",.", ".,"))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# Markdown's marks and what stands for them, in the order of their rewriting; rows of tables come between.
MARKS_BEFORE_ROWS = (
    (r"(?md)^```.*$", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?i)</?[a-z][^>]*>", ""),
    (r"(?md)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", ""),
)
MARKS_AFTER_ROWS = (
    (r"(\*\*|__)(?=\S)([\s\S]*?\S)\1", "$2"),
    (r"(?md)(^|[\s(])[*_](?=\S)([^*_\n]*?\S)[*_](?=[\s).,;:!?]|$)", "$1$2"),
    (r"`([^`]+)`", "$1"),
    (r"(?md)^[ \t]*>[ \t]?", ""),
    (r"(?md)^([ \t]*)[*+][ \t]+", "$1- "),
)
TABLE_ROW = r"^[ \t]*\|(.*)\|[ \t]*$"
# Pronouns that a hyphen ties to the verb before them.
CLITICS = "se|lo|la|los|las|lhe|lhes|me|te|nos|vos|o|a|os|as|no|na|nas"
# Lines that open a paragraph of a printed law; page marks as people and as chunks read them.
OPENINGS = r"\n(?=(?:Art\.?|Artigo|§|CAP[IÍ]TULO|T[IÍ]TULO|SE[CÇ][AÃ]O|Se[cç][aã]o)\s)"
READABLE_MARK = r"(?imdu)^-{2,}\s*P[áa]gina\s+0*(\d+)\s*-{2,}$"
PAGE_MARK = r"(?md)^\[\[pagina:\d+\]\]$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def line_breaks(c: Column) -> Column:
    """Unix line ends, no zero bytes, no spaces before a line's end, one blank line in a row at most (F18). Null stays null."""
    for pattern, out in (("\r\n?", "\n"), ("\\x00", ""), ("[ \t\u00a0]+\n", "\n")):
        c = F.regexp_replace(c, pattern, out)
    return _blank_lines(c)


def page_marks(c: Column) -> Column:
    """Page lines that people read (``--- Página 3 ---``) as the marks that chunks read, ``[[pagina:3]]``."""
    return F.regexp_replace(c, READABLE_MARK, "[[pagina:$1]]")


def without_page_marks(c: Column) -> Column:
    """The text without such marks."""
    return _blank_lines(F.regexp_replace(c, PAGE_MARK, ""))


def plain_markdown(c: Column) -> Column:
    """Markdown as plain text: headings and list marks stay, links, emphasis, fences, rulers and tags go, cells of a table's
    row are set apart by bars (S10). Null stays null."""
    c = line_breaks(c)
    for pattern, out in MARKS_BEFORE_ROWS:
        c = F.regexp_replace(c, pattern, out)

    def row(line: Column) -> Column:
        cells = F.split(F.regexp_extract(line, TABLE_ROW, 1), r"\|", -1)
        return F.when(line.rlike(TABLE_ROW), F.array_join(F.transform(cells, strip), " | ")).otherwise(line)

    c = F.array_join(F.transform(F.split(c, "\n", -1), row), "\n")
    for pattern, out in MARKS_AFTER_ROWS:
        c = F.regexp_replace(c, pattern, out)
    return _blank_lines(c)


def join_hyphens(c: Column) -> Column:
    """Words that a line's end had split as one; a hyphen before a pronoun is the verb's own and stays."""
    whole = rf"(\p{{L}})(?:-\n(?!(?:{CLITICS})(?:\P{{L}}|\z))(\p{{Ll}}+)|(-)\n({CLITICS}))(?=\P{{L}}|\z)"
    return F.regexp_replace(c, whole, "$1$2$3$4")


def printed_text(c: Column) -> Column:
    """Text of a printed page for chunking: single spaces, split words joined, a blank line ahead of articles, paragraphs and
    chapters (F19). Null stays null."""
    for pattern, out in (("\r\n?", "\n"), ("[ \t\u00a0]+", " "), (" *\n *", "\n")):
        c = F.regexp_replace(c, pattern, out)
    return _blank_lines(F.regexp_replace(join_hyphens(c), OPENINGS, "\n\n"))
