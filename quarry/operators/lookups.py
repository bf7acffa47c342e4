"""Lookups by label and reference, metadata checks, the infraction prior and inline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.questions import article_key
from quarry.operators.retrieval import rank_by

# An article in a folded label, clauses in a reference, a date, and the states of a document.
ARTICLE = r"art\.?\s*(\d+)(?:-([a-z])(?![a-z]))?"
CLAUSES = r"\b(?:inciso\s+)?([ivxl]+)\b"
LAST_CLAUSE, OPENING_CLAUSES = r"\s([IVXL]+)\z", r"(?:^|\n)([IVXL]+)\s*[-–—]"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
STATES = ("vigente", "revisar", "substituido")
#: Articles of infractions, and what their scores are multiplied with.
INFRACTIONS, PRIOR = (161, 255), 1.04


def like_pattern(text: Column) -> Column:
    """A pattern for LIKE that stands for the text itself: its wildcards and escapes are escaped."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def article_of(label: Column) -> Column:
    """``art. 165-b`` of a label or reference, null if it names no article."""
    low = F.lower(label)
    n, letter = F.regexp_extract(low, ARTICLE, 1), F.regexp_extract(low, ARTICLE, 2)
    return F.when(n != "", F.concat(F.lit("art. "), n, F.when(letter != "", F.concat(F.lit("-"), letter)).otherwise("")))


def reading_order(label: Column, place: Column, key: Column) -> list[Column]:
    """Sort columns for legal order: the stored place, else the article's number and letter (O02), then the key."""
    return [place.asc_nulls_last(), article_key(label), key]


def by_label(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, id): the first row in reading order whose label is what was typed, without case.

    questions(qid, text), rows(id, label, place). An equi join; wildcards in what was typed stand for themselves.
    """
    asked = questions.select("qid", F.lower(F.trim("text")).alias("k"))
    hits = asked.join(rows.withColumn("k", F.lower("label")), "k")
    return rank_by(hits, "qid", *reading_order(F.col("label"), F.col("place"), F.col("id")), k=1).select("qid", "id")


def by_reference(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, id, points): the row that a legal reference means most specifically.

    questions(qid, text), rows(id, label, text, place). Rows must name the very article, ``art. 16`` isn't ``art. 165``. A clause
    of the reference is worth 10 points in a label that ends with it, 5 in a text with a line that it opens; ties go by reading
    order. References without an article find nothing. Rows meet each article with its clauses once, however many questions
    ask for it.
    """
    low = F.regexp_replace(F.lower("text"), r"\bdo ctb\b", "")
    asked = questions.select("qid", article_of(F.col("text")).alias("article"), F.transform(F.regexp_extract_all(low, F.lit(CLAUSES), F.lit(1)), F.upper).alias("clauses"))
    asked = asked.where("article IS NOT NULL")
    ends, opens = F.regexp_extract("label", LAST_CLAUSE, 1), F.regexp_extract_all("text", F.lit(OPENING_CLAUSES), F.lit(1))
    named = rows.withColumns({"article": article_of(F.col("label")), "ends": ends, "opens": opens}).where(F.contains(F.lower("label"), F.col("article")))
    hits = asked.select("article", "clauses").distinct().join(named, "article")

    def worth(clause: Column) -> Column:
        return F.when(F.col("ends") == clause, 10).when(F.array_contains("opens", clause), 5).otherwise(0)

    points = F.aggregate(F.transform("clauses", worth), F.lit(0), lambda a, x: a + x)
    place = F.struct(F.col("place").isNull().alias("none"), "place", article_key(F.col("label")).alias("key"))  # as reading_order()
    best = hits.groupBy("article", "clauses").agg(F.min(F.struct((-points).alias("less"), place.alias("place"), "id")).alias("best"))
    found = asked.join(best, ["article", "clauses"]).groupBy("qid").agg(F.min("best").alias("best"))
    return found.select("qid", "best.id", (-F.col("best.less")).alias("points"))


def iso_date(text: Column) -> Column:
    """The date that a text of the form YYYY-MM-DD is, null if there is none such."""
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text))


def metadata_problems(source: Column, version: Column, effective: Column, checked: Column, state: Column, today: Column) -> Column:
    """What is wrong with a document's metadata, in a fixed order (P20): source, version (blank), effective, checked (no real
    date), state (unknown; null counts as in force), checked early (before it is effective), checked late (after today)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    since, seen = iso_date(effective), iso_date(checked)
    real = since.isNotNull() & seen.isNotNull()
    faults = {
        "source": blank(source),
        "version": blank(version),
        "effective": since.isNull(),
        "checked": seen.isNull(),
        "state": ~F.coalesce(state, F.lit(STATES[0])).isin(*STATES),
        "checked early": real & (seen < since),
        "checked late": real & (seen > today),
    }
    return F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in faults.items()]))


def infraction_prior(ranked: DataFrame, weight: float = PRIOR) -> DataFrame:
    """(qid, id, score, rank) of ranked(qid, id, label, score, rank): scores of infractions count ``weight`` times, ties keep
    their former order (K03)."""
    n = F.regexp_extract(F.lower("label"), ARTICLE, 1).try_cast("bigint")
    lifted = F.col("score") * F.when(n.between(*INFRACTIONS), F.lit(weight)).otherwise(F.lit(1.0))
    out = ranked.select("qid", "id", lifted.alias("score"), F.col("rank").alias("_former"))
    return rank_by(out, "qid", F.col("score").desc(), F.col("_former"), F.col("id")).drop("_former")


def inline_table(rows: DataFrame, key: str, text: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(key, line, columns...) of tables kept as text, a row per line and cells between bars.

    columns: names and kinds: ``text``, ``list`` (between commas, blanks dropped), ``int`` (null if it is none), or ``text=NAME``,
    which takes the value of another column where it is blank. Cells that a line lacks are blank; blank lines are no rows.
    """
    lines = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line", "_l")).where(F.trim("_l") != "")
    cells = lines.select(key, "line", F.split("_l", r"\|", -1).alias("_c"))
    cell = {n: F.coalesce(F.get("_c", F.lit(k)), F.lit("")) for k, (n, _) in enumerate(columns)}

    def made(name: str, kind: str) -> Column:
        c = cell[name]
        if kind == "list":
            return F.filter(F.split(c, ","), lambda x: x != "")
        if kind == "int":
            return F.trim(c).try_cast("int")
        return F.when(c == "", cell[kind.partition("=")[2]]).otherwise(c) if "=" in kind else c

    return cells.select(key, "line", *[made(n, k).alias(n) for n, k in columns])
