"""How work grows: rows that joins make and rows that exchanges carry, as Spark counts them."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import lookups as L
from quarry.operators import retrieval as R
from quarry.plans import search, structure

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def counted(spark):
    """counted(df, run): what run(df) gives, the most rows that a join made, and the rows that exchanges wrote."""
    store = spark._jsparkSession.sharedState().statusStore()

    def all_of(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def one(df, run=lambda df: df.collect()):
        before = store.executionsCount()
        out = run(df)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        joined = [0]
        written = 0
        for e in all_of(store.executionsList())[before:]:
            values = store.executionMetrics(e.executionId())
            for n in all_of(store.planGraph(e.executionId()).allNodes()):
                for m in all_of(n.metrics()):
                    v = values.get(m.accumulatorId())
                    v = int(v.get().replace(",", "")) if v.isDefined() and v.get().replace(",", "").isdigit() else 0
                    if "Join" in n.name() and m.name() == "number of output rows":
                        joined.append(v)
                    if m.name() == "shuffle records written":
                        written += v
        return out, max(joined), written

    return one


def test_reference_meets_rows_once(spark, counted):
    asked = spark.range(400).selectExpr("id AS qid", "concat('art. 165, inciso ', element_at(array('IV', 'X'), cast(id % 2 + 1 AS int))) AS text")
    rows = spark.range(300).selectExpr("id", "concat('Art. 165', CASE WHEN id = 70 THEN ' IV' ELSE '' END) AS label", "CASE WHEN id > 200 THEN 'X - a' END AS text", "cast(NULL AS int) AS place")
    got, joined, _ = counted(L.by_reference(asked, rows))
    assert {(r.qid % 2, r.id, r.points) for r in got} == {(0, 70, 10), (1, 201, 5)} and len(got) == 400
    assert joined <= 600  # two references by 300 rows, then a row a question; 120,000 if every question met every row


def test_rolling_stream_stays_out_of_the_driver(spark):
    assert registry.QUERIES["t01_stream_rolling"](spark, SF).inputFiles()  # files that tasks wrote; a memory table has none


@pytest.fixture(scope="module")
def tables(spark):
    """3,000 documents of a few common words in 4 tasks, asked for by 20 questions of five words."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("carro", "moto", "placa", "multa") for b in ("", "s", "zinho", "nova", "velha")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 30)) if k % 7 else "carro multa placa", "en") for k in range(3000)]
    made = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4).persist()
    made.count()
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(60)], "vec_id long, embedding array<double>")
    return SimpleNamespace(spark=spark, documents=made, embeddings=vectors, benchmark=spark.createDataFrame([(k, text(5)) for k in range(20)], "item_id long, text string"))


#: What exchanges may carry there: the best ten of 20 questions from 4 tasks, and what is asked. Questions by documents are 60,000.
LEAST = 4000


def test_search_exchanges_the_best_only(counted, tables):
    got, joined, written = counted(search.r06(tables))
    assert len(got) == 200 and joined <= LEAST and written <= LEAST
    asked = search.questions(tables)
    want = R.lexical_topk(asked, R.positions(tables.documents, "doc_id", "text")).collect()
    assert {(r.qid, r["rank"], r.id, r.coverage) for r in got} == {(r.qid, r["rank"], r.id, r.coverage) for r in want}


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "placa nova"), (1, "carro multa carro"), (2, "carro multa placa"), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(5, w) for w in ("placa", "carro", "multa")], "qid int, term string")
    a = R.lexical_search(asked, docs, "id", "text").collect()
    b = R.lexical_topk(asked, R.positions(docs, "id", "text")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and {(r.id, r.coverage) for r in a} == {(1, 3), (2, 3)}


@pytest.mark.parametrize("run", [search.k04, search.k06, search.a09, structure.a10, search.k02])
def test_queries_on_the_lists_exchange_the_best_only(counted, tables, run):
    _, joined, written = counted(run(tables))
    assert joined <= 2 * LEAST and written <= 3 * LEAST  # the 3,000 documents are read for signals and passages


def test_fuzzy_search_exchanges_the_best_only(counted, tables):
    got, joined, written = counted(search.k10(tables))
    assert {r.qid for r in got} == set(range(20)) and joined <= LEAST and written <= LEAST


def test_titles_meet_questions_in_the_rarest_word(spark, counted):
    titles = spark.range(2000).selectExpr("id", "concat('lei federal ', CASE WHEN id % 100 = 0 THEN 'rara' ELSE 'comum' END, ' ', id) AS title")
    asked = spark.range(20).selectExpr("id AS qid", "CASE WHEN id % 2 = 0 THEN 'rara federal lei' ELSE 'LEI FEDERAL RARA 500' END AS text")
    none = spark.createDataFrame([], "qid bigint, id bigint, score double")
    got, joined, _ = counted(R.catalogue_topk(asked, titles, none))
    assert {(r.id, r.score) for r in got if r.qid == 1} == {(500, 300.0)} and len([r for r in got if r.qid == 0]) == 20
    assert joined <= 2000  # 40,000 where every title with a word of a question meets it
