"""Lookups, metadata, the prior and inline tables on cases of their own."""

from pyspark.sql import functions as F

from quarry.operators import lookups as L

ROWS = [
    (1, "Art. 165", "texto", None), (2, "art. 165-A", "x\nXVII - em local", 2), (3, "Art. 16", None, None), (4, "Art. 181 XVII", "y", 9), (5, "Art. 181", "z\nXVII – aqui\nII - lá", 1),
    (6, "Art. 181 XXVII", "w", 3), (7, "100%_", None, None), (8, "ART. 165", "cópia", None), (9, None, None, None), (10, "Artigo 16", None, 0),
]


def rows(spark):
    return spark.createDataFrame(ROWS, "id int, label string, text string, place int")


def test_labels_are_literal(spark):
    asked = spark.createDataFrame([(1, " art. 165 "), (2, "1%_"), (3, "100%_"), (4, "ART. 165-a"), (5, None), (6, "")], "qid int, text string")
    assert {(r.qid, r.id) for r in L.by_label(asked, rows(spark)).collect()} == {(1, 1), (3, 7), (4, 2)}
    like = spark.createDataFrame([("a%b_c\\d",), ("aXbYc\\d",), ("a%b_c",)], "v string")
    got = like.select(F.ilike("v", L.like_pattern(F.lit("A%b_C\\d")), F.lit("\\")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False]


def test_references(spark):
    asked = [(1, "art. 181, inciso XVII do CTB"), (2, "Art 181"), (3, "art. 16"), (4, "ver ART. 165-a, ii"), (5, "sem artigo"), (6, None), (7, "art. 181 II")]
    got = {r.qid: (r.id, r.points) for r in L.by_reference(spark.createDataFrame(asked, "qid int, text string"), rows(spark)).collect()}
    assert got == {1: (4, 10), 2: (5, 0), 3: (3, 0), 4: (2, 0), 7: (5, 5)}


def test_metadata(spark):
    cases = [
        (("DOU", "1", "2024-02-29", "2024-03-01", None), []),
        ((" ", None, "2023-02-29", "2024-3-1", "velho"), ["source", "version", "effective", "checked", "state"]),
        (("a", "b", "2024-05-02", "2024-05-01", "revisar"), ["checked early"]),
        (("a", "b", "2024-05-02", "2024-07-01", "substituido"), ["checked late"]),
        (("a", "b", "x2024-05-02", None, "vigente"), ["effective", "checked"]),
    ]
    df = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], "k int, a string, b string, c string, d string, e string")
    got = df.select("k", L.metadata_problems(*map(F.col, "abcde"), F.lit("2024-06-01").cast("date")).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == [c[1] for c in cases]


def test_prior_lifts_near_equals_only(spark):
    ranked = [(1, 306, "art. 306", 1 / 61, 1), (1, 165, "art. 165", 1 / 62, 2), (2, 281, "art. 281", 1 / 61, 1), (2, 230, "art. 230", 1 / 66, 2), (3, 1, None, 2.0, 1), (3, 2, "x", 2.0, 2)]
    out = L.infraction_prior(spark.createDataFrame(ranked, "qid int, id int, label string, score double, rank int")).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in out] == [(1, 165), (1, 306), (2, 281), (2, 230), (3, 1), (3, 2)]


def test_inline_table(spark):
    text = "Venezuela|R|7\nVietnam|V,A|7||vietna,vietnã\r\n\n  \nZimbábue||x|Outro|,\nsó"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    columns = [("name", "text"), ("signs", "list"), ("page", "int"), ("value", "text=name"), ("aliases", "list")]
    got = [tuple(r)[2:] for r in L.inline_table(df, "k", "t", columns).orderBy("line").collect()]
    assert got == [
        ("Venezuela", ["R"], 7, "Venezuela", []), ("Vietnam", ["V", "A"], 7, "Vietnam", ["vietna", "vietnã"]), ("Zimbábue", [], None, "Outro", []), ("só", [], None, "só", []),
    ]
