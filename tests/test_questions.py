"""Golden cases of question understanding, matching and positioned text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from test_units import naive_osa

from quarry.functions import questions as Q
from quarry.operators import matching as M
from quarry.operators import positioned, rules


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "q string").select(column(F.col("q")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,pages,canonical,problem",
    [
        ("3, 10-12", [3, 10, 11, 12], "3, 10–12", None), ("2,1,2", [1, 2], "1–2", None), ("", [], "", "empty"), ("1,,2", [], "", "syntax"),
        ("0", [], "", "below one"), ("5-3", [], "", "reversed"), ("1-11", [], "", "too many"), ("1-99999999999", [], "", "too many"), ("x", [], "", "syntax"),
    ],
)
def test_page_selection(spark, text, pages, canonical, problem):
    got = one(spark, Q.page_selection, text)
    assert (list(got.pages), got.canonical, got.problem) == (pages, canonical, problem)


def test_concepts_prefer_the_longer_phrase(spark):
    got = one(spark, Q.concepts, "Batida de carro")
    assert got.rest.strip() == "" and got.alternatives == [["batida de carro", "acidente de trânsito"]]


def test_citations(spark):
    got = one(spark, lambda c: Q.cited(c, 2), "Sim [1] [9] . Não [02][3].")
    assert (got.text, got.cited) == ("Sim [1]. Não [02].", [1, 2])
    drop = one(spark, lambda c: Q.drop_references(c, F.array(F.lit("art. 9"))), "ver art. 9, art. 99 e Art. 9")
    assert drop == "ver art. 99 e "


def test_masks_for_training(spark):
    got = one(spark, Q.anonymise_training, "João da Silva mora na rua das Flores, 12, mail a@b.com")
    assert "Silva" not in got and "Flores" not in got and "a@b.com" not in got


def test_label_matcher(spark):
    asked = spark.createDataFrame([(1, "perturbasao do sossego"), (2, "uso de algemas"), (3, "xx")], "qid bigint, text string")
    items = spark.createDataFrame([("a", "Perturbação do sossego"), ("b", "Algemas")], "id string, label string")
    aliases = spark.createDataFrame([("algemas", "b"), ("nada", "z")], "term string, id string")
    got = {(r.qid, r.id, r.method) for r in M.match_labels(asked, items, aliases).collect()}
    assert got == {(1, "a", "label"), (2, "b", "exact alias")}


def test_cascade_and_order(spark):
    def rows(*r):
        return spark.createDataFrame(r, "qid bigint, id string, score double")

    got = M.cascade(rows((1, "a", 100.0)), rows((1, "b", 90.0), (2, "b", 90.0)), rows((2, "b", 95.0), (2, "c", 80.0)))
    assert [(r.qid, r.id, r.score) for r in got.orderBy("qid", "rank").collect()] == [(1, "a", 100.0), (2, "b", 90.0), (2, "c", 80.0)]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (2, "b", 2)], "qid bigint, id string, rank int")
    order = spark.createDataFrame([(1, ["c", "a"]), (2, ["b", "zz"])], "qid bigint, ids array<string>")
    assert [r.id for r in M.apply_order(ranked, order).orderBy("qid", "rank").collect()] == ["c", "a", "b", "a", "b"]


def test_passages(spark):
    q = spark.createDataFrame([(1, "art. 9 habilitação estrangeira")], "qid bigint, text string")
    p = spark.createDataFrame([("x", "Art. 9", "outra coisa"), ("y", "Art. 90", "Habilitação estrangeira")], "id string, label string, text string")
    assert [(r.id, r.score) for r in M.score_passages(q, p).orderBy("rank").collect()] == [("x", 110), ("y", 30)]


def test_page_text(spark):
    items = [(0, "Art. 1", 0.0, 100.0, 30.0, 10.0), (1, "fim", 35.0, 100.0, 15.0, 10.0), (2, "linha", 0.0, 88.0, 20.0, 10.0), (3, "novo", 0.0, 50.0, 20.0, 10.0)]
    df = spark.createDataFrame([("d", 1, *i) for i in items], "doc string, page int, pos int, text string, x double, y double, width double, height double")
    assert positioned.page_text(df).first().text == "Art. 1 fim\nlinha\n\nnovo"


def test_fact_rows(spark):
    f = [(10, 700, "Grupo A"), (130, 702, "Vias de"), (160, 702, "fato"), (510, 700, "Menor"), (10, 650, "Grupo B"), (130, 648, "Furto"), (510, 650, "Maior"), (130, 600, "solto")]
    df = spark.createDataFrame([("d", 1, float(x), float(y), None, t) for x, y, t in f], "doc string, page int, x double, y double, width double, text string")
    got = positioned.fact_rows(df, "(?i)^(?:maior|menor)$").orderBy(F.col("y").desc()).collect()
    assert [(r.group, r.nature, r.label) for r in got] == [("Grupo A", "Vias de fato", "Menor"), ("Grupo B", "Furto", "Maior")]


def test_inspection_with_axles(spark):
    ax = F.array(F.struct(F.lit(13000.0).alias("kg"), F.lit(10000.0).alias("legal"), F.lit(None).cast("double").alias("technical")))
    none = F.lit(None).cast("double")
    got = spark.range(1).select(rules.inspection(F.lit(20000.0), F.lit("balanca"), none, none, none, F.lit(22000.0), none, ax, F.lit(1)).alias("o")).first().o
    assert (got.status, got.codes, got.excess, got.axle_excess, got.responsible) == ("autuavel", ["683-13"], 1000.0, 1750.0, "Transportador")
    assert got.cents == 13016 + 5 * 2128 + 9 * 3192


def test_smaller_ones(spark):
    assert one(spark, Q.anonymise_evaluation, "Ana Souza CPF 123.456.789-00 placa ABC1D23") == "[PESSOA] CPF [CPF] placa [PLACA]"
    assert one(spark, Q.focus, "Posso fazer Busca Pessoal?") == "busca pessoal" and one(spark, Q.focus, "bom dia") == "bom dia"
    assert [one(spark, Q.enough_said, q) for q in ("516-91", "sem cinto", "bom dia")] == [True, True, False]
    got = spark.range(1).select(rules.axle_gaps(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("g")).first().g
    assert (got.missing, got.unknown) == (["a"], ["c"])


def naive_match(questions, items, aliases, least=78):
    """All pairs, one by one, by K15's definition."""
    def words(form):
        return [w for w in form.split(" ") if len(w) >= 3 and w not in M.LINK_WORDS]

    def similar(x, y):
        n, m = min(len(x), len(y)), max(len(x), len(y))
        if x == y:
            return 1.0
        if n < 4 or re.search(r"\d", x + y):
            return 0.0
        return 0.88 if x.startswith(y) or y.startswith(x) else 1 - naive_osa(x, y) / m

    best = {}
    entries = [(i, form, "label") for i, form in items] + [(i, form, "alias") for form, i in aliases]
    for qid, q in questions:
        mine = words(q)
        for i, form, kind in entries:
            if kind == "alias" and f" {form} " in f" {q} ":
                s = 98
            elif len(mine) < 2 and (not mine or len(mine[0]) < 4):
                continue
            elif q == form:
                s = 100
            else:
                theirs = words(form)
                base, other = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
                top = [max(similar(x, y) for y in other) for x in base]
                s = min(94, int(sum(top) / len(top) * 100 + 0.5)) if top and sum(x >= 0.72 for x in top) >= 0.7 * len(top) else 0
                s = min(97, s + 2) if kind == "alias" and s else s
            if s >= least:
                best[qid, i] = max(best.get((qid, i), 0), s)
    return best


def test_match_labels_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice(("ca", "de", "mo", "tor", "pla", "cas", "sem", "vei")) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["de", "ao", "123", "a12b"]
    spoil = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k : k + 2][::-1]]) + w[k + rng.randrange(3) :]
    phrase = lambda n: [rng.choice(pool) for _ in range(n)]
    labels = [(str(i), " ".join(phrase(rng.randrange(1, 6)))) for i in range(40)]
    terms = [(" ".join(phrase(rng.randrange(1, 4))), str(rng.randrange(45))) for _ in range(40)]
    asked = [(k, " ".join(spoil(w) if rng.random() < 0.4 else w for w in rng.choice(labels + [(b, a) for a, b in terms])[1].split(" "))) for k in range(120)]
    asked = [(k, " ".join(q.split())) for k, q in asked if q.split()] + [(900, "de"), (901, "mo"), (902, labels[3][1]), (903, "x " + terms[5][0] + " y")]
    args = [spark.createDataFrame(rows, f"{names}") for rows, names in ((asked, "qid long, text string"), (labels, "id string, label string"), (terms, "term string, id string"))]
    got = {(r.qid, r.id): r.score for r in M.match_labels(*args, k=100).collect()}
    want = naive_match(asked, labels, [(t, i) for t, i in terms if int(i) < 40])
    assert got == want and len(want) > 50
    assert M.match_labels(args[0].limit(0), *args[1:]).count() == 0


def test_field_terms_have_their_fields_weight(spark):
    from quarry.operators import catalogues as C

    rows = spark.createDataFrame([(1, "capacete viseira moto", "moto farol aceso")], "id long, title string, body string")
    got = {r.term: r.w for r in C.field_terms(rows, "id", {"title": 5, "body": 2}).collect()}
    assert got == {"capacete": 5, "viseira": 5, "moto": 5, "farol": 2, "aceso": 2}


def test_longest_key_of_several_words(spark):
    q = spark.createDataFrame([(1, "motorista de reino unido aqui"), (2, "reino")], "qid long, text string")
    keys = spark.createDataFrame([(7, "Reino Unido"), (8, "unido"), (9, "reino")], "id long, key string")
    assert {r.qid: r.id for r in M.longest_key(q, keys).collect()} == {1: 7, 2: 9}


def test_concepts_leave_each_other_room(spark):
    """Spans against a plain version that marks letters one by one."""
    import random

    def naive(form):
        found = [(m.start(), m.end(), k) for k, (p, _) in enumerate(Q._RULES) for m in p.finditer(form)]
        found.sort(key=lambda f: (f[0] - f[1], f[2], f[0]))
        rest, alternatives = list(form), []
        for a, b, k in found:
            if "\0" not in rest[a:b]:
                alternatives.append([form[a:b], *Q._RULES[k][1]])
                rest[a:b] = "\0" * (b - a)
        return {"rest": "".join(rest).replace("\0", " "), "alternatives": alternatives}

    rng = random.Random(3)
    words = "batida de carro moto celular zap documento do veiculo peso bruto total e sem capacete placa preferencial x".split()
    for _ in range(300):
        form = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        assert Q.concepts_of(form) == naive(form)
