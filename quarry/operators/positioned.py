"""Positioned text: fragments of a page with coordinates become lines and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the letter height: a step down that ends a line, one that ends a paragraph, and a gap that is a space.
LINE_STEP, PARAGRAPH_STEP, GAP = 0.5, 1.9, 0.15


def page_text(items: DataFrame) -> DataFrame:
    """(doc, page, text) of items(doc, page, pos, text, x, y, width, height): reading order with line breaks.

    Items without y stay on their line, null texts are skipped, a height of null or zero is that of the text before (10 if
    there is none). Pages are windows of their own, so their size is that of a page.
    """
    w = Window.partitionBy("doc", "page").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def previous(c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(before)

    inked = F.trim("text") != ""
    rows = items.where("text is not null").withColumn("own", F.nullif(F.abs("height"), F.lit(0.0)))
    rows = rows.withColumn("h", F.coalesce("own", previous(F.when(inked, F.col("own"))), F.lit(10.0)))
    rows = rows.withColumns(
        {
            "last_y": previous(F.col("y")),
            "last_end": previous(F.when(F.col("y").isNotNull(), F.col("x") + F.coalesce("width", F.lit(0.0)))),
            "last_h": F.coalesce(previous(F.when(inked, F.col("h"))), F.lit(0.0)),
            "tail": previous(F.when(F.col("text") != "", F.col("text"))),
        }
    )
    step, tall = F.abs(F.col("y") - F.col("last_y")), F.greatest("h", "last_h")
    open_ends = ~F.col("tail").rlike(r"\s$") & ~F.col("text").rlike(r"^\s")
    mark = (
        F.when(step > tall * PARAGRAPH_STEP, "\n\n")
        .when(step > tall * LINE_STEP, "\n")
        .when(step.isNotNull() & (F.col("x") - F.col("last_end") > F.col("h") * GAP) & open_ends, " ")
        .otherwise("")
    )
    parts = rows.withColumn("part", F.concat(mark, "text")).groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return parts.select("doc", "page", F.regexp_replace(F.array_join(F.col("p.part"), ""), "[ \t]+\n", "\n").alias("text"))


def joined(fragments: Column) -> Column:
    """One text of an array of struct(line, x, end, text): lines from the top, fragments from the left.

    Fragments that touch (1.5 units at most between them) are one word.
    """
    ordered = F.array_sort(
        fragments,
        lambda a, b: F.when(a["line"] > b["line"], -1).when(a["line"] < b["line"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0),
    )
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("bigint").alias("line"))

    def add(acc: Column, f: Column) -> Column:
        glued = F.coalesce((acc["line"] == f["line"]) & (f["x"] <= acc["end"] + 1.5), F.lit(False))
        sep = F.when((acc["t"] == "") | glued, "").otherwise(" ")
        return F.struct(F.concat(acc["t"], sep, f["text"]).alias("t"), f["end"].alias("end"), f["line"].alias("line"))

    return F.trim(F.regexp_replace(F.aggregate(ordered, start, add, lambda a: a["t"]), r"\s+", " "))


def fact_rows(fragments: DataFrame, labels: str, right: float = 500, left: float = 120, top: float = 725, bottom: float = 55,
              merge: float = 14, within: float = 18) -> DataFrame:
    """(doc, page, y, group, nature, label) of a three-column table.

    fragments(doc, page, x, y, width, text). Lines of the right column that match ``labels`` are anchors, those at most
    ``merge`` below the anchor's mean line are part of it; every other fragment goes to its page's nearest anchor, the
    upper of equally near ones, if that is ``within``. Rows lacking a cell are left out.
    """
    end = F.when(F.col("width").isNotNull(), F.col("x") + F.col("width"))
    f = fragments.select("doc", "page", "y", "x", F.round("y").cast("bigint").alias("line"), F.struct(
        F.round("y").cast("bigint").alias("line"), F.col("x").cast("double").alias("x"), end.cast("double").alias("end"), "text").alias("f"))
    lines = f.where(F.col("x") >= right).groupBy("doc", "page", "line").agg(F.collect_list("f").alias("fs"))
    lines = lines.where(joined(F.col("fs")).rlike(labels))
    page = lines.groupBy("doc", "page").agg(F.reverse(F.array_sort(F.collect_list(F.struct("line", "fs")))).alias("ls"))
    one = "struct<y:double,n:int,fs:array<struct<line:bigint,x:double,end:double,text:string>>>"

    def fold_line(acc: Column, ln: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(last["y"] - ln["line"]) <= merge)
        grown = F.struct(((last["y"] * last["n"] + ln["line"]) / (last["n"] + 1)).alias("y"), (last["n"] + 1).alias("n"), F.concat(last["fs"], ln["fs"]).alias("fs"))
        fresh = F.struct(ln["line"].cast("double").alias("y"), F.lit(1).alias("n"), ln["fs"].alias("fs"))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown.cast(one)))).otherwise(
            F.concat(acc, F.array(fresh.cast(one)))
        )

    anchors = page.select("doc", "page", F.aggregate("ls", F.array().cast(f"array<{one}>"), fold_line).alias("anchors"))
    body = f.where((F.col("x") < right) & F.col("y").between(bottom, top)).join(anchors, ["doc", "page"])
    near = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a["y"] - F.col("y")).alias("d"), i.alias("i"))))
    cells = body.select("doc", "page", "x", "f", near.alias("near"), "anchors").where(F.col("near.d") <= within)
    rows = cells.groupBy("doc", "page", F.col("near.i").alias("i")).agg(
        F.first(F.element_at("anchors", F.col("near.i") + 1)).alias("a"),
        joined(F.collect_list(F.when(F.col("x") < left, F.col("f")))).alias("group"),
        joined(F.collect_list(F.when(F.col("x") >= left, F.col("f")))).alias("nature"),
    )
    out = rows.select("doc", "page", F.col("a.y").alias("y"), "group", "nature", joined(F.col("a.fs")).alias("label"))
    return out.where("group != '' and nature != '' and label != ''")
