"""Stems against the published sample, folding against canonical decomposition, and search by stems."""

import unicodedata

from pyspark.sql import functions as F

from quarry.functions import stemming as S
from quarry.functions import text as T
from quarry.operators import retrieval as R

# Words and stems of the published sample vocabulary.
SAMPLE = """boa boa boainain boainain boas boas bôas bôas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob
bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc
bocadas boc bocadinho bocadinh bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body
boeing boeing boemia boem boêmio boêmi bogotá bogot boi boi bóia bói boiando boi quiabo quiab quicaram quic quickly quickly quieto quiet
quietos quiet quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas quilométr quilométricos quilométr
quilômetro quilômetr quilômetros quilômetr quilos quil quimioterapia quimioterap quimioterápicos quimioteráp quimono quimon quincas quinc
quinhão quinhã quinhentos quinhent quinn quinn quino quin quinta quint quintal quintal quintana quintan quintanilha quintanilh
quintão quintã quintessência quintessent quintino quintin quinto quint quintos quint quintuplicou quintuplic quinze quinz quinzena quinzen
quiosque quiosqu""".split()


def test_sample(spark):
    want = dict(zip(SAMPLE[::2], SAMPLE[1::2]))
    rows = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r.w: r.s for r in S.with_stems(rows, "w", "s").collect()} == want


def test_each_rule(spark):
    """One word or more per class of suffix, with what the regions allow."""
    want = {
        "certeza": "certez", "beleza": "belez", "metodologia": "metodolog", "reprodução": "reprodu", "constituição": "constituiçã", "frequência": "frequênc", "paciência": "paciênc",
        "rapidamente": "rapid", "relativamente": "relat", "negativamente": "negat", "habilidade": "habil", "responsabilidade": "respons",
        "negativa": "negat", "primeira": "primeir", "dirigindo": "dirig", "parássemos": "par", "sangue": "sang", "braço": "brac", "laç": "lac", "": "", "é": "é",
    }
    rows = spark.createDataFrame([(w,) for w in want], "w string")
    got = {r.w: r.s for r in S.with_stems(rows, "w", "s").collect()}
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_both_forms_and_stop_words(spark):
    words = "habilitação habilitações dirigir dirigindo não nao para houvéssemos fôramos seremos 123".split()
    got = {r.word: r.stems for r in S.analysed(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got["habilitação"][0] == got["habilitações"][0] == "habilit" and len(got["habilitação"]) == 2
    assert got["dirigir"] == got["dirigindo"] == ["dirig"] and got["123"] == ["123"]
    assert got["para"] == [] and got["não"] == ["nao"] and len(got["houvéssemos"]) == len(got["fôramos"]) == 1 and got["seremos"] == []
    assert len(S.stop_words()) == len(set(S.stop_words())) == 203


def test_fold_is_canonical_decomposition(spark):
    every = [c for c in map(chr, range(0x20, 0x3000)) if unicodedata.category(c) != "Cn"]
    marks = set(T.MARKS)
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([*every, "é", "ÀÉÎÕŪ", "ǖ", "Ệ"])], "k int, c string")
    got = {r.c: r.f for r in rows.select("c", T.fold(F.col("c")).alias("f")).collect()}
    odd = [c for c, f in got.items() if f != "".join(x for x in unicodedata.normalize("NFD", c) if x not in marks).lower()]
    assert got["é"] == "e" and got["ÀÉÎÕŪ"] == "aeiou" and got["ǖ"] == "u" and got["Ệ"] == "e"
    # what decomposes into several characters stays whole
    assert all(len(unicodedata.normalize("NFD", c)) > 1 for c in odd)


def test_search_by_stems(spark):
    docs = [(1, "Dirigindo sem habilitação"), (2, "O condutor dirige um veículo; habilitações vencidas"), (3, "dirigível"), (4, "de para com"), (5, None)]
    places = R.written_places(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    asked = [(1, "dirigir"), (1, "dirigindo"), (1, "habilitado"), (2, "para"), (2, "de"), (3, "veiculos"), (4, "zzz")]
    got = R.stemmed_topk(spark.createDataFrame(asked, "qid int, word string"), places).collect()
    by = {q: [(r.id, r.coverage, r.n_words) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] for q in (1, 2, 3, 4)}
    assert by == {1: [(1, 2, 2), (2, 2, 2), (3, 1, 2)], 2: [], 3: [(2, 1, 1)], 4: []}
