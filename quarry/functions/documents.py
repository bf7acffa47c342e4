"""File names, headings, references and answers as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import roman

# The formats taken, by extension, with the content type that each travels as.
FORMATS = {
    "pdf": ("application/pdf", ("pdf",)),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("docx",)),
    "doc": ("application/msword", ("doc",)),
    "md": ("text/plain", ("md", "markdown")),
    "txt": ("text/plain", ("txt",)),
}
# What a line of a law or a manual opens with.
ARTICLE_LINE = r"(?i)^(?:art\.?|artigo)\s*(\d+)\s*[ºo°]?(?:-([A-Za-z])(?![A-Za-z]))?"
ARTICLE_STRICT = r"^(?:Art\.|Artigo)\s*\d+(?:-[A-Z])?\s*(?:[ºo°]\s*[.\-–—]?|[.\-–—])\s"
PARAGRAPH_LINE = r"(?iu)^(?:§\s*(\d+)\s*[ºo°]?|(par[áa]grafo\s+[úu]nico))"
CLAUSE_LINE = r"^(L?X{0,3}(?:IX|IV|V?I{0,3}))\s*[-–—]\s*\S"
POINT_LINE = r"^[a-z]\)\s*\S"
ITEM_LINE = r"^(?:[-–•●▪◦*·]\s+\S|\d{1,3}\s*[.)]\s+\S|\d{1,3}\s+[-–]\s+\S)"
PENALTY_LINE = r"(?iu)^(?:infra[çc][ãa]o|penalidade|medida\s+administrativa)\s*[-–—:]"
TITLE_LINE = r"(?iu)^(?:t[íi]tulo|cap[íi]tulo|se[çc][ãa]o|subse[çc][ãa]o|livro|parte|anexo)(?:\s+(?:[ivxlcdm]+|\d+|[úu]nic[oa])\b|\s*$)"
MARKDOWN_TITLE = r"^(#{1,6})\s+\S"
NUMBERED_TITLE = r"^\d+(?:\.\d+)+\.?\s+[A-ZÀ-Ý]"
REVOKED = r"(?i)^\(?\s*(?:vetad[oa]|revogad[oa])"
LEVELS = (
    (r"(?iu)^(?:livro|parte)\b", 0), (r"(?iu)^(?:t[íi]tulo|anexo)\b", 1), (r"(?iu)^cap[íi]tulo\b", 2), (r"(?iu)^se[çc][ãa]o\b", 3),
    (r"(?iu)^subse[çc][ãa]o\b", 4), (r"(?i)^(?:pop\b|procedimento operacional)", 5),
)
GLOSSARY_TERM = r"(?:^|\n)([A-ZÀ-Ý][A-ZÀ-Ý0-9 ]{1,40}?)\s+[-–]\s"
REFERENCE = r"(?i)\b(?:art\.?|artigo)\s+(\d{1,3}(?:-[a-z])?)\s*(?:§\s*(\d+))?\s*(?:,?\s*(?:inciso|inc|i)?\s*([ivxlcdm]+|\d+))?"
PROCEDURE_MENTION = r"(?iu)\bPOP(?:\s+(?:n(?:[º°o]\.?|\.)|número))?\s*[:\-]?\s*(\d{3}(?:\.\d+)*)\b"
SUPPORT = r"(?i)^\s*(Art\.\s*\d+(?:-[A-Z])?(?:\s*,\s*(?:§\s*\d+º?|[IVXLC]+|inciso\s+[IVXLC]+))*(?:\s*,\s*al[íi]nea\s+[\"“]?[a-z][\"”]?)?)\.?"
SHEET_LABELS = {
    "typification": r"Tipifica[çc][ãa]o do Enquadramento\s*:?",
    "severity": r"Gravidade\s*:",
    "penalty": r"Penalidade\s*:",
    "measure": r"Medida Administrativa\s*:",
    "crime": r"Pode Configurar (?:Crime de Tr[âa]nsito|Infra[çc][ãa]o Penal)\s*:?",
    "offender": r"Infrator\s*:",
    "competence": r"Compet[êe]ncia\s*:",
    "points": r"Pontua[çc][ãa]o\s*:",
    "finding": r"Constata[çc][ãa]o da Infra[çc][ãa]o\s*:",
    "not_to_fine": r"Quando\s+N[ÃA]O\s+Autuar\s*:?",
    "to_fine": r"Quando\s+Autuar\s*:?",
    "definitions": r"Defini[çc][õo]es e Procedimentos\s*:?",
    "examples": r"Exemplos do Campo de Observa[çc][õo]es do AIT\s*:?",
}
NO_TITLE = "Documento"


def extension(name: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none or nothing before it."""
    return F.regexp_extract(F.lower(F.trim(name)), r"(?s)^.+\.([^.]*)$", 1)


def file_format(name: Column) -> Column:
    """Format by extension, null if it isn't taken."""
    ext = extension(name)
    return F.coalesce(*[F.when(ext.isin(*known), kind) for kind, (_, known) in FORMATS.items()])


def content_type(name: Column) -> Column:
    """Content type that a file travels as, null if its format isn't taken."""
    kind = file_format(name)
    return F.coalesce(*[F.when(kind == k, mime) for k, (mime, _) in FORMATS.items()])


def title_of_file(name: Column) -> Column:
    """Title of at most 200 letters from a file name."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(name, r"\.[^.]+$", ""), "_", " "), r"\s+", " ")
    return F.left(F.coalesce(F.nullif(F.trim(plain), F.lit("")), F.lit(NO_TITLE)), F.lit(200))


def fallback_label(section: Column, text: Column, norm: Column, order: Column) -> Column:
    """Innermost heading, else the norm, and the first glossary term, else the place."""
    inner = F.split_part(F.element_at(F.split(section, " › "), -1), F.lit(" — "), F.lit(1))
    term = F.nullif(F.regexp_extract(text, GLOSSARY_TERM, 1), F.lit(""))
    return F.concat(F.coalesce(inner, norm), F.lit(" · "), F.coalesce(term, F.concat(F.lit("trecho "), (order + 1).cast("string"))))


def caps_heading(line: Column) -> Column:
    """A line of at most 100 letters and 14 words, mostly capitals, that is no clause and no veto."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-zÀ-ÿ]", ""))
    upper = F.length(F.regexp_replace(line, "[^A-ZÀ-Ý]", ""))
    short = (F.length(line) <= 100) & (F.size(F.split(line, r"\s+")) <= 14)
    other = line.rlike("[,;]$") | line.rlike(REVOKED) | line.rlike(CLAUSE_LINE)
    return short & ~other & (letters >= 4) & (upper >= 0.85 * letters)


def line_kind(line: Column, opens: Column, legal: Column) -> Column:
    """article, title, paragraph, clause, item or text: what a line is.

    opens: it opens a paragraph of text. legal: the text is cut by articles rather than by sections.
    """
    caps = caps_heading(line)
    article = line.rlike(ARTICLE_LINE) & (opens | line.rlike(ARTICLE_STRICT))
    numbered = line.rlike(NUMBERED_TITLE) & (F.length(line) <= 90) & ~line.rlike("[.;:,]$")
    return (
        F.when(article, F.when(legal, "article").otherwise("item"))
        .when((line.rlike(TITLE_LINE) & (F.length(line) <= 120)) | line.rlike(MARKDOWN_TITLE), "title")
        .when(line.rlike(PARAGRAPH_LINE), "paragraph")
        .when(line.rlike(CLAUSE_LINE) & ~line.rlike(r"^\s*[-–—]"), "clause")
        .when(line.rlike(POINT_LINE), "item")
        .when(~legal & (caps | numbered), "title")
        .when(legal & opens & caps & (F.size(F.split(line, r"\s+")) <= 8), "title")
        .when(line.rlike(ITEM_LINE) | line.rlike(PENALTY_LINE), "item")
        .otherwise("text")
    )


def heading_level(line: Column) -> Column:
    """Depth of a heading: keywords 0 to 5, else 6 and one more per number part, marks 10 and more."""
    marks = F.length(F.regexp_extract(line, MARKDOWN_TITLE, 1))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    named = [F.when(line.rlike(p), n) for p, n in LEVELS]
    parts = F.when(number != "", F.size(F.split(number, r"\."))).otherwise(0)
    return F.coalesce(F.when(marks > 0, 10 + marks), *named, 6 + parts)


def opening_label(line: Column) -> Column:
    """Label of the article, paragraph or clause that a line opens, else null."""
    n = F.regexp_extract(line, ARTICLE_LINE, 1)
    letter = F.upper(F.regexp_extract(line, ARTICLE_LINE, 2))
    rest = F.regexp_replace(line, ARTICLE_LINE, "")
    after = F.regexp_extract(rest, r"^\s*,?\s*§\s*(\d+)", 1)
    article = F.concat(
        F.lit("art. "), n, F.when(letter != "", F.concat(F.lit("-"), letter)).otherwise(""),
        F.when(after != "", F.concat(F.lit(" § "), after, F.lit("º"))).otherwise(""),
    )
    p = F.regexp_extract(line, PARAGRAPH_LINE, 1)
    return (
        F.when(n != "", article)
        .when(line.rlike(PARAGRAPH_LINE), F.when(p != "", F.concat(F.lit("§ "), p, F.lit("º"))).otherwise("parágrafo único"))
        .when(line.rlike(CLAUSE_LINE), F.concat(F.lit("inc. "), F.regexp_extract(line, CLAUSE_LINE, 1)))
    )


def references(c: Column) -> Column:
    """array<struct<found, number, paragraph, clause>>: every article reference of a text, Roman clauses as numbers."""
    groups = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(REFERENCE), i).alias(f"g{i}") for i in range(4)])

    def clause(x: Column) -> Column:
        return F.when(x == "", None).when(x.rlike(r"^\d+$"), x).otherwise(roman(x).cast("string"))

    return F.transform(
        groups,
        lambda g: F.struct(
            F.trim(g["g0"]).alias("found"), F.lower(g["g1"]).alias("number"), F.nullif(g["g2"], F.lit("")).alias("paragraph"),
            clause(g["g3"]).alias("clause"),
        ),
    )


_PIECE = re.compile(r"\*\*([^*]+)\*\*|\[(\d{1,2})\]|((?:(?!\*\*[^*]+\*\*|\[\d{1,2}\]).)+)", re.S)
_ITEM = re.compile(r"\s*(?:(?P<list>[-•*])|\d{1,2}[.)])\s+(?P<body>.*)$", re.S)


def pieces_of(line: str) -> list[dict]:
    """Plain text, bold text and citations of a line, in order."""
    return [
        {"kind": ("bold", "citation", "text")[m.lastindex - 1], "value": str(int(m[2])) if m[2] else m[m.lastindex]}
        for m in _PIECE.finditer(line)
    ]


def blocks_of(answer: str | None) -> list[dict]:
    """Paragraphs, lists and numbered lists of an answer; blank lines end paragraphs only."""
    out: list[dict] = []
    open_lines: list[str] = []

    def close() -> None:
        if open_lines:
            out.append({"kind": "paragraph", "items": [pieces_of(" ".join(open_lines))]})
            open_lines.clear()

    for line in re.split(r"\r\n?|\n", answer or ""):
        item = _ITEM.match(line)
        if not item:
            open_lines.append(line.strip()) if line.strip() else close()
            continue
        close()
        kind = "list" if item["list"] else "numbered"
        if not out or out[-1]["kind"] != kind:
            out.append({"kind": kind, "items": []})
        out[-1]["items"].append(pieces_of(item["body"].strip()))
    close()
    return out


def answer_blocks(c: Column) -> Column:
    """array<struct<kind, items>> of an answer, each item an array of struct<kind, value> (F12). Null counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(blocks_of)

    return F.pandas_udf(run, "array<struct<kind:string,items:array<array<struct<kind:string,value:string>>>>>")(c)


_LABEL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHEET_LABELS.items()), re.I)
_SUPPORT = re.compile(SUPPORT)
SINGLE = ("typification", "offender", "competence", "finding", "severity", "points", "penalty", "measure", "crime")
SHEET = "support string, " + ", ".join(f"{k} string" for k in SINGLE) + (
    ", to_fine string, not_to_fine string, definitions string, examples array<string>, filled int"
)


def _flat(value: str | None) -> str | None:
    return " ".join(value.split()) if value and value.strip() else None


def _numbered(value: str) -> list[str]:
    parts = [x.strip() for x in re.split(r"(?=(?:^|\s)\d+\.\s)", value)]
    return [x for x in parts if re.match(r"\d+\.\s", x)]


def sheet_of(text: str | None) -> dict:
    """Fields of a sheet's text by label; the first filled place of a label counts.

    Where the column headings stand stacked and empty, the numbered lists after the last one are the columns in order,
    and a new list starts where the numbers start again at 1.
    """
    marks = list(_LABEL.finditer(text or ""))
    ends = [m.start() for m in marks[1:]] + [len(text or "")]
    found: dict[str, str] = {}
    for m, end in zip(marks, ends):
        value = text[m.end() : end].strip()
        if value:
            found.setdefault(m.lastgroup, value)
    head = _SUPPORT.match(text or "")
    out: dict = {k: _flat(found.get(k)) for k in SINGLE}
    out["support"] = _flat(head[1]) if head else None
    told = found.get("definitions", "")
    out["definitions"] = None if re.match(r"\d+\.\s", told) else _flat(told)
    out["to_fine"], out["not_to_fine"] = _flat(found.get("to_fine")), _flat(found.get("not_to_fine"))
    examples = _numbered(found.get("examples", ""))
    if not (out["to_fine"] or out["not_to_fine"]):
        columns: list[list[str]] = []
        for x in examples:
            if not columns or x.startswith("1. "):
                columns.append([])
            columns[-1].append(x)
        if len(columns) > 1 and any(m.lastgroup == "to_fine" for m in marks):
            out["to_fine"], out["not_to_fine"] = "\n".join(columns[0]), "\n".join(columns[1])
            examples = [x for col in columns[2:] for x in col]
    out["examples"] = examples
    out["filled"] = sum(bool(v) for v in out.values())
    return out


def sheet_fields(c: Column) -> Column:
    """struct of the labelled fields of a sheet's text, with the number of filled ones."""

    def run(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in SHEET.split(", ")]
        return pd.DataFrame([sheet_of(t) for t in texts], columns=names)

    return F.pandas_udf(run, SHEET)(c)
