"""Printed and marked-up text: hand-made cases, and running headers against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import paged


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.line_breaks, " a\r\nb \t\rc\x00d\n\n\n\ne ", "a\nb\ncd\n\ne"),
        (T.page_marks, "x\n--- Página 03 ---\n-- PÁGINA 12 --\n--- Página x ---", "x\n[[pagina:3]]\n[[pagina:12]]\n--- Página x ---"),
        (T.without_page_marks, "[[pagina:1]]\na\n[[pagina:2]]\n[[pagina:3]]\nb [[pagina:4]]", "a\n\nb [[pagina:4]]"),
        (T.join_hyphens, "infra-\nção conduzi-\nlo, apli-\nca-se", "infração conduzi-lo, aplica-se"),
        (T.join_hyphens, "a-\nlosango b-\nFoo c-\nvos", "alosango b-\nFoo c-vos"),
        (T.printed_text, "a  b \r\n c\nArt. 5 d\n§ 2 e\nSeção I\nartigo", "a b\nc\n\nArt. 5 d\n\n§ 2 e\n\nSeção I\nartigo"),
        (T.plain_markdown, "# T\n```py\nx\n```\n![a](b) [c](d) <b>e</b>", "# T\n\nx\n\na c e"),
        (T.plain_markdown, "|a | b|\n|---|:---:|\n| 1|2 |\n* i\n  + j\n> q", "a | b\n\n1 | 2\n- i\n  - j\nq"),
        (T.plain_markdown, "**x y** __z__ *u* _v_, a_b_c 2 * 3 * 4 `k`", "x y z u v, a_b_c 2 * 3 * 4 k"),
        (T.plain_markdown, "", ""),
        (T.plain_markdown, None, None),
        (T.printed_text, None, None),
    ],
)
def test_rewriting(spark, f, given, want):
    assert one(spark, f, given) == want


def plainly(pages: dict[int, str]) -> dict[int, str]:
    """Running headers by loops over one document's pages."""
    need, seen, spots = max(3, -(-len(pages) // 2)), Counter(), []
    for p, text in pages.items():
        filled, told = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()], set()
        for r, (i, x) in enumerate(filled):
            if r < 5 or r >= len(filled) - 3:
                key = " ".join(x.lower().split())
                tells = [("top" if r < 5 else "bottom", key)]
                if re.search(r"p[áa]g(?:ina)?\.?\s*\d|\bpage\s*\d|\d+\s*(?:de|/)\s*\d+", x, re.I):
                    tells.append((tells[0][0], "#", re.sub(r"\d+", "#", key)))
                told.update(tells)
                spots.append((p, i, x.strip(), re.sub(r"\d+", "#", key), tells))
        seen.update(told)
    gone = set()
    for p, i, x, mask, tells in spots:
        number = re.fullmatch(r"(p[áa]g(ina)?\.?\s*)?#(\s*(de|/)\s*#)?|-\s*#\s*-", mask)
        law = re.match(r"art\.?\s*\d|artigo\s|§|[ivxl]+\s*[-–—]|penalidade", x, re.I) or x.startswith("--- Página")
        if not law and (number or any(seen[t] >= need for t in tells)):
            gone.add((p, i))
    return {p: "\n".join(x for i, x in enumerate(text.split("\n")) if len(pages) < 3 or (p, i) not in gone) for p, text in pages.items()}


def test_running_headers(spark):
    pick = random.Random(3)
    lines = ["POLÍCIA  MILITAR", "polícia militar", "Pág. {p} de 9", "{p}/9", "- {p} -", "Art. 3 x", "II - y", "", "  ", "--- Página {p} ---", "Diário {p}", "page {p} a", "corpo {r}", "x"]
    rows = []
    for d in range(60):
        for p in range(pick.choice([1, 2, 3, 5, 8])):
            rows.append((d, p, "\n".join(pick.choice(lines).format(p=p, r=pick.randrange(4)) for _ in range(pick.randrange(14))), 1))
    rows.append((99, 0, None, 1))
    rows += [(98, p, t, 1) for p in range(4) for t in ("só", "topo") if p < 3 or t == "só"]  # rows that share document and page
    df = spark.createDataFrame(rows, "doc int, page int, text string, _gone int").repartition(5)
    got = paged.without_running_headers(df, "doc", "page", "text")
    assert got.columns == ["doc", "page", "text"]
    have = {(r.doc, r.page): r.text for r in got.collect() if r.doc not in (98, 99)}
    want = {}
    for d in range(60):
        want |= {(d, p): t for p, t in plainly({p: t for k, p, t, _ in rows if k == d}).items()}
    assert have == want
    assert sorted(r.text for r in got.where("doc = 98").collect()) == [""] * 7 and got.where("doc = 99").first().text == ""
    kept = spark.createDataFrame([(None, 1, "a"), (1, None, "1")], df.select("doc", "page", "text").schema)
    assert sorted(r.text for r in paged.without_running_headers(kept, "doc", "page", "text").collect()) == ["1", "a"]
    assert paged.without_running_headers(df.limit(0), "doc", "page", "text").count() == 0


def test_article_slices(spark):
    long = "palavra " * 6
    text = f"https://a.b/c\n01/02/2024, 10:00 x\nEmenta {long}\n\n\n\nArt. 1º {long}Art. 2º curto. Art.  12A {long}\f{long}xArt. 7 {long}\f\fArt. 9. {long}"
    rows = spark.createDataFrame([(1, text, "z"), (2, None, "z"), (3, "", "z"), (4, "curto", "z")], "id int, text string, label string")
    got = [(r.page, r.part, r.label, r.text[:12]) for r in paged.article_slices(rows, "id", "text").orderBy("page", "part").collect()]
    assert got == [
        (1, 0, paged.BEFORE_ARTICLES, "Ementa palav"), (1, 1, "Art. 1", "Art. 1º pala"), (1, 3, "Art. 12A", "Art. 12A pal"),
        (2, 0, "Art. 12A", "palavra pala"), (4, 0, "Art. 9", "Art. 9. pala"),
    ]
    assert paged.article_slices(rows.limit(0), "id", "text").count() == 0
