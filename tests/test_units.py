"""Golden cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunk, retrieval, rules
from quarry.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "q string").select(column(F.col("q")).alias("x")).first().x


@pytest.mark.parametrize("q", ["51691", "5169-1", "516-91", "516 91", "516/91", "516.91", "multa 516-91 hoje"])
def test_code_spellings(spark, q):
    assert one(spark, T.code, q) == "516-91"


@pytest.mark.parametrize("q", ["516", "123456", "art. 165", "2024-516911", "ABC51691", ""])
def test_no_code(spark, q):
    assert one(spark, T.code, q) is None


@pytest.mark.parametrize("q,n", [("xvii", 17), ("IV", 4), ("mcmxc", 1990), ("i", 1)])
def test_roman(spark, q, n):
    assert one(spark, T.roman, q) == n


def test_masks(spark):
    q = "CNH: 12345678901, placa ABC1D23 e ABC-1234, CNPJ 12.345.678/0001-90, CPF 123.456.789-09, art. 165"
    masked = one(spark, T.mask_identifiers, q)
    assert masked == "CNH: ***********, placa **** e ****, CNPJ ****-****, CPF ***-****, art. 165"
    assert one(spark, T.mask_identifiers, masked) == masked


def test_rrf(spark):
    rows = [(0, i, r + 1) for ids in ([165, 167, 244], [244, 165, 306]) for r, i in enumerate(ids)]
    got = retrieval.rrf(spark.createDataFrame(rows, "qid long, id long, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == [165, 244, 167, 306]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)


def naive_osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(400)] + ["capacete", "capcaete"]
    other = words[::-1]
    assert retrieval.osa(words, other).tolist() == [naive_osa(a, b) for a, b in zip(words, other)]
    assert retrieval.osa(["capacete", "abcdef"], ["capcaete", "abc"]).tolist() == [1, 3] and not len(retrieval.osa([], []))


def test_lexical_topk(spark):
    docs = [(1, "estacionar estacionar na calcada proibido", "a"), (2, "calcada larga proibido muro", "b"), (3, "estacionamento proibido calcada", "a"), (4, "nada", "a")]
    d = spark.createDataFrame(docs, "id long, text string, c string")
    asked = spark.createDataFrame([(7, w, "a") for w in ("estacion", "calcada", "proibido")], "qid long, term string, c string")
    got = [(r.id, r.coverage) for r in retrieval.lexical_topk(asked, retrieval.positions(d, "id", "text")).orderBy("rank").collect()]
    assert got == [(3, 2), (1, 2), (2, 2)] or got == [(1, 2), (3, 2), (2, 2)]  # prefixes make 1 and 3 denser
    mine = retrieval.lexical_topk(asked, retrieval.positions(d, "id", "text", "c"), by="c").orderBy("rank").collect()
    assert {r.id for r in mine} == {1, 3}


def test_vector_topk_in_collection(spark):
    v = [(i, [float(i), 1.0], "ab"[i % 2]) for i in range(1, 9)]
    d = spark.createDataFrame(v, "id long, v array<double>, c string")
    q = spark.createDataFrame([(1, [8.0, 1.0], "a"), (2, [8.0, 1.0], "b"), (3, [8.0, 1.0], "z")], "qid long, v array<double>, c string")
    got = {r.qid: r.id for r in retrieval.vector_topk(q, d, k=1, by="c").collect()}
    assert got == {1: 8, 2: 7}


def test_rerank_signals(spark):
    lex = spark.createDataFrame([(1, 10, 2, 4, 1), (1, 11, 4, 4, 2)], "qid long, id long, coverage long, n_words long, rank int")
    vec = spark.createDataFrame([(1, 12, 1)], "qid long, id long, rank int")
    signs = spark.createDataFrame([(1, 12, True, False), (1, 10, False, True)], "qid long, id long, exact boolean, typed boolean")
    got = {r.id: round(r.score, 6) for r in retrieval.rerank(lex, vec, signs, 0.25).collect()}
    assert got == {10: 2 * 0.5 + 0.8 + 0.25 + 1.2, 11: 2 + 0.4 + 0.25, 12: 100 + 0.5 + 0.25}


def test_catalogue_topk(spark):
    titles = spark.createDataFrame([(1, "Manual de Trânsito"), (2, "Manual de Trânsito Urbano"), (3, "O trânsito e seu manual"), (4, "Outro"), (5, "Man")], "id long, title string")
    asked = spark.createDataFrame([(1, "manual de transito"), (2, "man"), (3, " ")], "qid long, text string")
    none = spark.createDataFrame([(1, 4, 2.5)], "qid long, id long, score double")
    got = {(r.qid, r.id): r.score for r in retrieval.catalogue_topk(asked, titles, none).collect()}
    assert got == {(1, 1): 300, (1, 2): 200, (1, 3): 100, (1, 4): 2.5, (2, 5): 300, (2, 1): 200, (2, 2): 200}


def test_fuzzy_terms(spark):
    vocab = spark.createDataFrame([(w,) for w in ("capacete", "transitar", "estacionar", "estacionamento", "abc12")], "term string")
    terms = spark.createDataFrame([(w,) for w in ("capcaete", "estacion", "abc13", "transitar", "estacoinar")], "term string")
    got = {(r.term, r.word): r.quality for r in retrieval.fuzzy_terms(terms, vocab).collect()}
    assert got == {
        ("capcaete", "capacete"): 0.72, ("estacion", "estacionar"): 0.88, ("estacion", "estacionamento"): 0.88,
        ("transitar", "transitar"): 1.0, ("estacoinar", "estacionar"): 0.72,
    }


def test_fines(spark):
    got = spark.range(1).select(*[rules.excess_fine(F.lit(x)).alias(str(x)) for x in (0, 1, 600, 601, 5001)]).first()
    assert [*got] == [0, 532, 1596, 4256, 26 * 5320]


def cut(spark, text, **how):
    rows = chunk.chunks(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", **how).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [r.asDict() for r in rows]


def test_chunks(spark):
    text = "CAPÍTULO I\nArt. 164. " + "um texto longo. " * 3 + "\nArt. 165. velha redação do artigo aqui\nArt. 165. nova redação do artigo aqui\n[[pagina:2]]\nArt. 165-A. outra regra que vale."
    got = cut(spark, text)
    assert [c["label"] for c in got] == ["art. 164", "art. 165", "art. 165-A"]
    assert "nova" in got[1]["text"] and got[2]["page"] == 2
    assert all(len(c["text"]) <= 100 for c in cut(spark, "palavra " * 500, cap=100))
    assert cut(spark, None) == [] and chunk.pack([5, 5, 5], 10) == [0, 0, 1]


def test_chunks_keep_other_articles(spark):
    """Annexes that number anew and a wrapped reference take nothing from the body."""
    text = "Art. 1º Regra do corpo da norma.\n\nArt. 2º Outra regra, nos termos do\nart. 1º desta norma aqui.\n\nANEXO I\n\nArt. 1º Regra do primeiro anexo.\n\nANEXO II\n\nArt. 1º Regra do segundo anexo."
    got = [(c["label"], c["section"], c["text"]) for c in cut(spark, text)]
    assert got == [
        ("art. 1", None, "Art. 1º Regra do corpo da norma."),
        ("art. 2", None, "Art. 2º Outra regra, nos termos do art. 1º desta norma aqui."),
        ("art. 1", "ANEXO I", "Art. 1º Regra do primeiro anexo."),
        ("art. 1", "ANEXO II", "Art. 1º Regra do segundo anexo."),
    ]


def test_old_wordings():
    """Against a brute-force version: as long as two openings of a level in a row are the same, the first block goes."""
    import random

    depth = {"article": 0, "paragraph": 1, "clause": 2}

    def naive(units):
        for j, u in enumerate(units):
            d = depth.get(u["kind"])
            if d is None:
                continue
            for i in range(j - 1, -1, -1):
                e = -1 if units[i]["kind"] == "title" else depth.get(units[i]["kind"], 9)
                if e < d:
                    break
                if e == d:
                    inside = d == 0 or "article" in [x["kind"] for x in units[max([k for k in range(i) if units[k]["kind"] == "title"], default=0) : i]]
                    if inside and units[i]["text"] == u["text"]:
                        return naive(units[:i] + units[j:])
                    break
        return units

    rng = random.Random(5)
    lines = [("title", "ANEXO I")] + [("article", f"Art. {k}.") for k in (1, 2)] + [("paragraph", f"§ {k}º") for k in (1, 2)] + [("clause", f"{k} - x") for k in ("I", "II")] + [("text", "y")]
    for _ in range(300):
        units = [{"kind": k, "text": t, "n": n} for n, (k, t) in enumerate(rng.choice(lines) for _ in range(rng.randrange(30)))]
        kept = chunk.without_old_wordings([u["kind"] for u in units], [u["text"] for u in units])
        assert [units[k] for k in kept] == naive(units)


def test_chunk_levels_and_sections(spark):
    text = "\n\n".join(["Art. 162. Dirigir veículo:", "V - com validade vencida;", "V - com carteira cassada;", "§ 1º Texto antigo.", "I - inciso antigo;", "§ 1º Texto atual."])
    assert cut(spark, text)[0]["text"].split("\n") == ["Art. 162. Dirigir veículo:", "V - com carteira cassada;", "§ 1º Texto atual."]
    long = "Art. 181. Estacionar o veículo:\n" + "\n".join(f"{k} - em local e horário proibidos pela sinalização;" for k in ("I", "II", "III"))
    assert [c["label"] for c in cut(spark, long, cap=90)] == ["art. 181", "art. 181 II", "art. 181 III"]
    pop = "[[pagina:1]]\nPOP 1.01 - ABORDAGEM\n\n1. FINALIDADE\nPadronizar a abordagem em via pública.\n\n[[pagina:2]]\n3. SEQUÊNCIA DAS AÇÕES\n1. Informar à central o local.\n\n3.1 Da busca pessoal\nO segurança mantém a cobertura."
    assert [(c["section"], c["page"]) for c in cut(spark, pop, mode="secoes")] == [
        ("POP 1.01 - ABORDAGEM › 1. FINALIDADE", 1),
        ("POP 1.01 - ABORDAGEM › 3. SEQUÊNCIA DAS AÇÕES", 2),
        ("3. SEQUÊNCIA DAS AÇÕES › 3.1 Da busca pessoal", 2),
    ]


def test_long_units_are_cut_once(spark):
    """Whatever is cut: no letter is lost, pieces fit, and sentences are packed as full as they go."""
    import re

    rng = random.Random(7)
    for _ in range(200):
        words = [f"w{k}" + "x" * rng.choice((0, 3, 9, 40)) + rng.choice(("", "", ".", "!", ";")) for k in range(rng.randrange(1, 60))]
        text, cap = " ".join(words), rng.randrange(50, 90)
        pieces = chunk.fitted(text, cap)
        assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text) and all(0 < len(p) <= cap for p in pieces)
        whole = chunk.sentences(text)
        for one, two in zip(pieces, pieces[1:]):
            if set(chunk.sentences(one) + chunk.sentences(two)) <= set(whole):
                assert len(one) + 1 + len(chunk.sentences(two)[0]) > cap
    assert chunk.sentences("Ver art. 5 da lei. O Sr. A. foi! Fim") == ["Ver art. 5 da lei.", "O Sr. A. foi!", "Fim"]
    assert chunk.reflowed(["subme-", "tido", "chama-", "se Já-", "Fim"]) == "submetido chama-se Já- Fim"
    assert chunk.reflowed(["CAPÍTULO I", "DAS PENAS", "e multas", "(Vide)"], True) == "CAPÍTULO I — DAS PENAS e multas — (Vide)"


def test_sections_are_the_two_last_levels():
    """Against a stack from which each heading takes those as deep as itself or deeper."""
    rng = random.Random(8)
    for _ in range(200):
        levels = [rng.randrange(5) for _ in range(rng.randrange(12))]
        stack, want = [], []
        for k, d in enumerate(levels):
            stack = [x for x in stack if levels[x] < d] + [k]
            want.append(" › ".join(str(x) for x in stack[-2:]))
        assert chunk.sections_of(levels, [str(k) for k in range(len(levels))]) == want


def test_fuzzy_search_asks_every_word(spark):
    from types import SimpleNamespace

    from quarry.plans import search

    docs = spark.createDataFrame([(7, "placo\nresto do texto"), (8, "outra coisa\ncom sol")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "placa"), (2, "sol")], "item_id long, text string")
    got = search.k10(SimpleNamespace(documents=docs, benchmark=asked)).collect()
    assert {(r.qid, r.id, r.rank) for r in got} == {(1, 7, 1), (2, 8, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes("ação".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes("ação".encode())
    (tmp_path / "d.txt").write_bytes(b"")
    got = {r.path[-5:]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.bin"].kind == "pdf" and "d.txt" not in got
    assert got["b.txt"].text == got["c.txt"].text == "ação"


def test_search_by_concepts(spark):
    """A phrase is one group; an alternative of two words needs both; verb forms and typos count less than the word."""
    rows = [(1, "multa", 3.0), (1, "motocicleta", 1.0), (2, "multa", 1.0), (2, "telefone", 1.0), (3, "telefone", 1.0), (3, "celular", 1.0), (3, "multas", 1.0), (4, "transitando", 1.0)]
    fields = spark.createDataFrame(rows, "id int, term string, w double")
    asked = spark.createDataFrame([(1, "multa moto"), (2, "multa zap"), (3, "não 12"), (4, "transitar"), (5, ""), (6, None)], "qid int, text string")
    groups = {(r.qid, r.grp, r.alt, r.term, r.words) for r in retrieval.question_groups(asked).collect()}
    assert groups == {
        (1, 0, 0, "multa", 1), (1, 1, 0, "moto", 1), (1, 1, 1, "motocicleta", 1), (1, 1, 2, "motoneta", 1), (1, 1, 3, "ciclomotor", 1),
        (2, 0, 0, "multa", 1), (2, 1, 0, "zap", 1), (2, 1, 1, "telefone", 2), (2, 1, 1, "celular", 2), (4, 0, 0, "transitar", 1),
    }
    got = {(r.qid, r.id, r.coverage): r.score for r in retrieval.concept_search(asked, fields, 4).collect()}
    idf = lambda df: 1 + math.log(1 + 4 / (1 + df))
    assert got.keys() == {(1, 1, 2), (2, 3, 2), (4, 4, 1)}
    assert math.isclose(got[1, 1, 2], 3 * idf(2) + idf(1))
    assert math.isclose(got[2, 3, 2], 0.88 * idf(1) + (idf(2) + idf(1)) / 2)
    assert math.isclose(got[4, 4, 1], 0.86 * idf(1))
