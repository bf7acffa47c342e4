"""Printed pages: running headers and footers out, articles cut from pages.

Pages keep to themselves but for what a document's pages share: the counts of lines at their edges, and the article that a
page begins in. Only those short lines are shuffled by document, and texts meet what is to go in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import READABLE_MARK, strip

#: Lines at a page's top and bottom that may be headers and footers, and the least pages that repeat one.
TOP, BOTTOM, PAGES = 5, 3, 3
# Lines of laws, page numbers with digits masked, lines that mention a page, noise of printed web pages.
LEGAL_LINE = r"(?iu)^(?:art\.?\s*\d|artigo\s|§|par[áa]grafo|[ivxl]+\s*[-–—]|infra[çc][ãa]o|penalidade|medida\s+administrativa)"
PAGE_NUMBER = r"^(?:p[áa]g(?:ina)?\.?\s*)?#(?:\s*(?:de|/)\s*#)?$|^-\s*#\s*-$"
MENTIONS_PAGE = r"(?iu)p[áa]g(?:ina)?\.?\s*\d|\bpage\s*\d|\d+\s*(?:de|/)\s*\d+"
NOISE_LINE = r"(?i)^\s*https?://|^\s*\d{2}/\d{2}/\d{4},\s+\d{2}:\d{2}"
ARTICLE = r"Art\.[\s\u00a0]*(\d+[A-Z]?)"
BEFORE_ARTICLES = "Ementa e disposições iniciais"


def _edges(lines: Column) -> Column:
    """array<struct(i, edge, line)>: the lines with words among the first TOP and the last BOTTOM of them."""
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].rlike(r"(?U)\S"))

    def named(part: Column, edge: str) -> Column:
        return F.transform(part, lambda x: F.struct(x["i"].alias("i"), F.lit(edge).alias("edge"), strip(x["line"]).alias("line")))

    def both(f: Column) -> Column:
        bottom = F.slice(f, F.greatest(F.lit(TOP + 1), F.size(f) - (BOTTOM - 1)), BOTTOM)
        return F.concat(named(F.slice(f, 1, TOP), "top"), named(bottom, "bottom"))

    return F.transform(F.array(filled), both)[0]  # a lambda evaluates the lines once


def without_running_headers(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """pages(doc, page, text) less running headers and footers.

    A line at an edge goes if it is a page number, or if it stands at that edge on half of the document's pages, PAGES at
    least; where it mentions a page, its digits don't matter. Lines of laws and page marks stay, and so do documents of
    fewer than PAGES pages. A null text counts as empty; rows of one document and page count as one page, each judged by its
    own lines; rows with a null document or page are left as they are. Other columns are not kept.
    """
    pages = pages.select(doc, page, F.coalesce(text, F.lit("")).alias(text))
    h = F.xxhash64(text).alias("_h")
    d, p = F.col(doc).alias("_d"), F.col(page).alias("_p")
    of = F.split(text, "\n", -1)
    known = pages.where(F.col(doc).isNotNull() & F.col(page).isNotNull())
    total = known.groupBy(d).agg(F.countDistinct(page).alias("_n")).where(F.col("_n") >= PAGES)
    key = F.lower(F.regexp_replace("line", r"(?U)\s+", " "))
    edges = (
        known.select(d, p, h, F.explode(_edges(of)).alias("e")).select("_d", "_p", "_h", "e.*").withColumn("key", key)
        .withColumn("mask", F.regexp_replace("key", r"\d+", "#")).withColumn("names_page", F.col("line").rlike(MENTIONS_PAGE))
        .where(~F.col("line").rlike(LEGAL_LINE) & ~F.col("line").rlike(READABLE_MARK))
    )
    # a line is told by its words, and by its masked words too where it mentions a page
    forms = F.array_compact(F.array(F.struct(F.lit(False).alias("masked"), F.col("key").alias("form")),
                                    F.when(F.col("names_page"), F.struct(F.lit(True).alias("masked"), F.col("mask").alias("form")))))
    at, told = ["_d", "_p", "_h", "i"], ["_d", "edge", "masked", "form"]
    number = F.col("mask").rlike(PAGE_NUMBER).alias("number")
    each = edges.select(*at, "edge", number, F.explode(forms).alias("f")).select(*at, "edge", "number", "f.*")
    seen = each.groupBy(*told).agg(F.countDistinct("_p").alias("seen")).join(total, "_d")
    often = seen.select(*told, (F.col("seen") >= F.greatest(F.lit(PAGES), F.ceil(F.col("_n") / 2))).alias("often"))
    gone = each.join(often, told).where("often or number").groupBy(*at[:3]).agg(F.collect_set("i").alias("_gone"))  # eight at most
    joined = pages.join(gone, (F.col(doc) == F.col("_d")) & (F.col(page) == F.col("_p")) & (F.xxhash64(text) == F.col("_h")), "left")
    rest = F.array_join(F.filter(of, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(doc, page, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest).alias(text))


def clean_page(text: Column) -> Column:
    """A printed web page without its address and date lines."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(NOISE_LINE))
    return strip(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "[ \t]+", " "))


def article_slices(docs: DataFrame, doc: str, text: str, least: int = 40, before: str = BEFORE_ARTICLES) -> DataFrame:
    """(doc, page, part, label, text) of documents whose pages are set apart by form feeds.

    Pages are cut ahead of each ``Art. n``; parts of fewer than ``least`` characters go. A part that doesn't open an article
    belongs to the last one that did, on this page or an earlier one, or to ``before``. Pages count from 1, a page's parts
    from 0. A null text has no parts. Rows that share an id are one document, in no defined order.
    """
    pages = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\f", -1)).alias("p", "raw"))
    cut = F.split(clean_page(F.col("raw")), rf"(?<![A-Za-z0-9_])(?={ARTICLE})", -1)
    parts = pages.select("doc", (F.col("p") + 1).alias("page"), F.posexplode(cut).alias("part", "raw")).select("doc", "page", "part", strip(F.col("raw")).alias("text"))
    number = F.nullif(F.regexp_extract("text", "^" + ARTICLE, 1), F.lit(""))
    opened = parts.where(F.length("text") >= least).withColumn("own", F.concat(F.lit("Art. "), number))
    order = Window.partitionBy("doc").orderBy("page", "part", "text").rowsBetween(Window.unboundedPreceding, 0)  # one document's parts
    label = F.coalesce(F.last("own", ignorenulls=True).over(order), F.lit(before))
    return opened.select(F.col("doc").alias(doc), "page", "part", label.alias("label"), "text")
