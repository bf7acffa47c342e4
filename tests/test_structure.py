"""Golden cases of document, catalogue, report and job operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import documents as D
from quarry.functions import domains
from quarry.operators import catalogues as C
from quarry.operators import reports as P
from quarry.sources import jobs as J


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "q string").select(column(F.col("q")).alias("x")).first().x


def test_names(spark):
    assert one(spark, D.extension, "A.B.PDF ") == "pdf" and one(spark, D.extension, ".pdf") == ""
    assert one(spark, D.title_of_file, "pop_1.01-abordagem.pdf") == "pop 1.01-abordagem"
    assert one(spark, D.title_of_file, "_.pdf") == "Documento"


def test_answer_blocks():
    got = D.blocks_of("um\ndois [3]\n\n- **a** b\n\n* c\n1) d")
    assert [b["kind"] for b in got] == ["paragraph", "list", "numbered"]
    assert got[0]["items"] == [[{"kind": "text", "value": "um dois "}, {"kind": "citation", "value": "3"}]]
    assert [len(b["items"]) for b in got] == [1, 2, 1]
    assert D.blocks_of(None) == [] and D.pieces_of("** a") == [{"kind": "text", "value": "** a"}]


def test_stacked_sheet():
    text = (
        "Art. 181, XVII. Tipificação do Enquadramento: Estacionar Gravidade: Média Quando AUTUAR Quando NÃO Autuar "
        "Exemplos do Campo de Observações do AIT: 1. a 2. b 1. c 1. d"
    )
    got = D.sheet_of(text)
    assert (got["support"], got["to_fine"], got["not_to_fine"], got["examples"]) == ("Art. 181, XVII", "1. a\n2. b", "1. c", ["1. d"])
    assert D.sheet_of(None)["filled"] == 0


def test_passage():
    text = "abertura " * 40 + "o capacete de segurança é obrigatório " + "fecho " * 60
    got = C.best_passage(text, ["capacete"], 120)
    assert "capacete" in got and got.startswith("…") and got.endswith("…") and len(got) <= 122
    assert C.best_passage("curto", ["x"], 100) == "curto"
    assert C.best_passage("a" * 200, ["capacete"], 100) == "a" * 100 + "…"
    assert C.best_passage(None, [], 10, False) == ""


@pytest.mark.parametrize("text,limit", [("a b c d e f g h", 5), ("x" * 50, 7), ("linha um\nlinha dois\nlinha três", 12)])
def test_windows_cover(text, limit):
    spans = C.windows_of(text, limit)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans) and all(s[0] <= p[1] + 1 for p, s in zip(spans, spans[1:]))


SHEETS = [
    ("516-91", "Dirigir sob a influência de álcool", "Art. 165", "bebida"),
    ("554-12", "Estacionar em local proibido", "Art. 181, XVII", "placa"),
    ("545-21", "Estacionar no passeio", "Art. 181, VIII", "calçada"),
    ("757-90", "Recusar teste", "Art. 165-A", "bafômetro"),
]


def test_search_sheets(spark):
    sheets = spark.createDataFrame(SHEETS, "id string, label string, support string, wording string")
    asked = spark.createDataFrame(
        [(1, "multa 516-91"), (2, "art. 181"), (3, "art. 181, XVII"), (4, "estacionar no passeio"), (5, "999-99"), (6, "art. 165-A"), (7, "art. 165")],
        "qid long, text string",
    )
    got = {}
    for r in C.search_sheets(asked, sheets, spark.createDataFrame([("birita", "516-91")], "term string, id string")).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.method))
    assert [x for x, _ in got[1]] == ["516-91"] and [x for x, _ in got[2]] == ["545-21", "554-12"] and [x for x, _ in got[3]] == ["554-12"]
    assert got[4][0] == ("545-21", "label") and 5 not in got
    assert [x for x, _ in got[6]] == ["757-90"] and [x for x, _ in got[7]] == ["516-91"]


def test_sheets_asks_every_part(spark):
    from quarry.plans import structure
    from quarry.plans.base import Tables

    got = structure.k17(Tables(spark, "/root/testdata/sf0.001")).select("qid").distinct().collect()
    assert {r.qid % 50 for r in got} - {1, 2, 3}


def test_facts(spark):
    facts = spark.createDataFrame([("Suicídio", "Suicídio", "g"), ("Vias de fato", "Vias de fato", "g")], "id string, label string, body string")
    asked = spark.createDataFrame([(1, "ele quer se matar"), (2, "briga no bar"), (3, "lista")], "qid long, text string")
    none = spark.createDataFrame([], "term string, id string")
    got = [(r.qid, r.id, r.score) for r in C.search_facts(asked, facts, none).where("rank = 1").orderBy("qid").collect()]
    assert got[0] == (1, "Suicídio", 97) and got[1][:2] == (2, "Vias de fato") and len(got) == 2
    local = spark.createDataFrame([(1, "Suicídio", 1)], "qid long, id string, rank int")
    told = spark.createDataFrame([(1, "x\nNatureza: VIAS DE FATO\ny", 1), (1, "Natureza: Suicidio", 2)], "qid long, text string, rank int")
    both = C.combine_facts(local, told, facts).orderBy("rank").collect()
    assert [(r.id, r.origin) for r in both] == [("Suicídio", "local"), ("Vias de fato", "rag")]


def test_procedures_and_weights(spark):
    row = ("101", "Abordagem a pessoa", "policial", "verbalizar", "algema", "esquecer", "lanterna", "lei", "anexo")
    cols = "id title execution sequence critical mistakes material grounds annexes".split()
    procs = spark.createDataFrame([row, ("102", "Barreira policial", *row[2:])], ", ".join(f"{c} string" for c in cols))
    asked = spark.createDataFrame([(1, "POP 102"), (2, "abordagem a pessoa"), (3, "POP 777")], "qid long, text string")
    got = C.search_procedures(asked, procs, spark.createDataFrame([], "term string, id string")).where("rank = 1").orderBy("qid").collect()
    assert [(r.qid, r.id) for r in got] == [(1, "102"), (2, "101")]
    rules = spark.createDataFrame([(1, "art. 5", "res", "peso bruto do conjunto de eixos em tandem"), (2, "art. 6", "res", "altura")], "id long, reference string, document string, text string")
    w = C.weight_passages(spark.createDataFrame([(1, "eixo tandem?")], "qid long, text string"), rules).collect()
    assert [r.id for r in w] == [1]


def test_section_sources(spark):
    ranked = spark.createDataFrame([(1, "101", 1)], "qid long, id string, rank int")
    names = ["a", "b", "c", "d", "e"]
    sections = spark.createDataFrame([("101", i, n, "POP", f"texto {n} " + ("algema" if n == "e" else "nada")) for i, n in enumerate(names)], "id string, place int, section string, title string, text string")
    q = "qid long, text string"
    assert [r.section for r in C.section_sources(ranked, sections, spark.createDataFrame([(1, "algema")], q)).collect()] == ["e"]
    assert len(C.section_sources(ranked, sections, spark.createDataFrame([(1, "helicóptero")], q)).collect()) == 4
    assert len(C.section_sources(ranked, sections, spark.createDataFrame([(1, "")], q)).collect()) == 5


def test_widen(spark):
    main = spark.createDataFrame([(1, "x", 1)], "qid long, id string, rank int")
    asked = spark.createDataFrame([(1, "estacionar"), (1, "calcada"), (1, "noite")], "qid long, term string")
    words = spark.createDataFrame([("x", "outro"), ("y", "estacionar"), ("y", "calcada"), ("y", "noite"), ("z", "estacionar"), ("z", "noite"), ("w", "noite")], "id string, term string")
    assert [r.id for r in C.widen(main, asked, words).orderBy("rank").collect()] == ["x", "y", "z"]


def test_generic(spark):
    rows = spark.createDataFrame([(["sem", "12"],), (["capacete"],), ([],)], "t array<string>")
    assert [r.g for r in rows.select(domains.generic(F.col("t")).alias("g")).collect()] == [True, False, True]


def test_problems(spark):
    cases = spark.createDataFrame([("a", "frase", ["x"], 1), ("a", "frase", ["x"], 1), ("b", "nada", [], 2)], "case_id string, category string, expected array<string>, max_pos int")
    got = sorted((r.case_id, r.problem) for r in P.case_problems(cases, ["frase"]).collect())
    assert got == [("a", "duplicate"), ("b", "category"), ("b", "nothing expected"), ("b", "place")]
    m = spark.createDataFrame([("ctb", "2024-01-01", None, "vigente"), ("pop", "x", None, None)], "collection string, valid_from string, checked_on string, state string")
    got = sorted((r.collection, r.problem) for r in P.manifest_problems(m, ["ctb", "mbft"]).collect())
    assert got == [("mbft", "missing"), ("pop", "state"), ("pop", "valid_from")]


def test_audit(spark):
    yes = {t: True for t in (*P.AUDIT_TABLES, *P.AUDIT_FUNCTIONS)}
    schema = (
        "vector boolean, unaccent boolean, tables map<string,boolean>, row_security map<string,boolean>, functions map<string,boolean>, private_open boolean,"
        " privileged_open boolean, rag_schema_version int, bucket_exists boolean, bucket_public boolean, seed_examples array<string>"
    )
    good = (True, True, yes, yes, yes, False, False, 10, True, False, [])

    def status(row):
        checks = P.audit_checks(spark.createDataFrame([row], schema))
        return P.audit_status(checks).first().status

    assert status(good) == "ok" and status((*good[:-1], ["516-91"])) == "atencao"
    assert status((*good[:7], 9, *good[8:])) == "bloqueio" and status((*good[:2], {}, *good[3:])) == "bloqueio"


def test_handout(spark):
    schema = "book string, page int, ord int, section string, text string"
    rows = [("a", 2, 1, "s2", "b" * 4000), ("a", 1, 1, "s1", " " + "a " * 1500), ("a", None, 1, None, "c"), ("b", 1, 1, None, "x" * 36_001), ("a", 1, 2, "s1", " \n")]
    got = P.handout_parts(spark.createDataFrame(rows, schema), "book").orderBy("book", "part").collect()
    assert [(r.book, r.part, r.pages, r.sections, r.problem) for r in got] == [
        ("a", 0, [1], ["s1"], None), ("a", 1, [2], ["s2"], None), ("b", None, [], [], "too long"),
    ]
    assert got[1].text == "b" * 4000 + "\n\nc"
    assert all(len(p) <= 10 for p in P.cut_text("aa bb cc dd ee ff gg " * 4 + "z" * 25, 10))


def test_grounds(spark):
    sheets = spark.createDataFrame([("1", ["1. parado"], ["1. em pane"]), ("2", ["1. x"], [])], "code string, to_fine array<string>, not_to_fine array<string>")
    told = spark.createDataFrame(
        [("1", 1, "1. parado", "quando_autuar", "sim", "favoravel", "parado"), ("1", 2, "outra", "quando_autuar", "nao", "contraria", "outra")],
        "code string, place int, criterion string, source string, answer string, effect string, told string",
    )
    open_ = spark.createDataFrame([("1", 1, "Em  pane", "quando_nao_autuar")], "code string, place int, criterion string, source string")
    a, b = P.grounds(sheets, told, open_).orderBy("code").collect()
    assert (a.confirmed, a.divergent, a.ready) == (["parado"], [], False) and a.to_confirm == ["Confirme se a hipótese de não autuar ocorre: em pane"]
    assert len(b.to_confirm) == 1 and not b.ready


def test_dossier(spark):
    themes = spark.createDataFrame([("alcool", ["516"], ["álcool"])], "theme string, prefixes array<string>, keywords array<string>")
    inf = spark.createDataFrame([("516-91", "Dirigir", "art. 165", True, False, "cnh"), ("999-00", "x", "y", False, False, None)], "code string, wording string, support string, held boolean, towed boolean, document string")
    norms = spark.createDataFrame([("alcool", 1, "art. 165", "t"), ("alcool", 2, "art. 165", "t")], "theme string, place int, label string, text string")
    rulings = spark.createDataFrame([("r1", "Álcool e direção"), ("r2", "nada")], "id string, subject string")
    kinds = {}
    for r in P.dossier(themes, inf, norms, rulings).collect():
        kinds[r.kind] = kinds.get(r.kind, 0) + 1
    assert kinds == {"code": 1, "norm": 1, "ruling": 1, "check": 7, "example": 1}


def test_batches(spark):
    def send(rows):
        if any(r["id"] == 40 for r in rows):
            raise ValueError("bad")

    rows = spark.range(70).coalesce(1).select("id", F.lit("x").alias("text"))
    got = P.in_batches(rows, "text", send).collect()
    assert [r.rows for r in got] == [32, 32, 6] and [r.problem is None for r in got] == [True, False, True]
    assert P.in_batches(rows.limit(0), "text", send).count() == 0


def test_jobs(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert J.read_catalogue(spark, str(tmp_path / "c.json"), "id string").count() == 2
    assert J.read_catalogue(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "x.txt").write_text("um\ndois")
    m = spark.createDataFrame([("x", "x.txt")], "id string, file string")
    assert [(r.id, r.text) for r in J.read_manifest(spark, m, str(tmp_path)).collect()] == [("x", "um\ndois")]
    (tmp_path / "p.json").write_text(json.dumps({"dados": [{"id": 7, "siglaTipo": "PL", "numero": 12, "ano": 2024, "ementa": "Do trânsito"}, {"id": 8, "ementa": None}]}))
    spark.dataSource.register(J.BillsSource)
    bills = spark.read.format("bills").option("path", str(tmp_path / "p.json")).load()
    assert [r.number for r in J.bills_on(bills, ["TRÂNSITO"], 2025, "https://x.org/?id=").collect()] == ["PL 12/2024"]
    J.write_version(m, str(tmp_path / "v"), 3)
    assert J.read_version(spark, str(tmp_path / "v"), 3, "id string, file string").count() == 1
    assert J.read_version(spark, str(tmp_path / "v"), 4, "id string, file string").count() == 0
    J.export_json(m, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 1
    m.createOrReplaceTempView("structure_m")
    audit = json.loads(J.catalogue_audit(spark, ["structure_m", "structure_none"]).first().audit)["tables"]
    assert audit["structure_m"] == {"present": True, "columns": ["file", "id"]} and not audit["structure_none"]["present"]


def test_docx(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>um</w:t><w:tab/><w:t>dois</w:t></w:r></w:p><w:p/></w:body></w:document>")
    rows = spark.createDataFrame([(bytearray(buf.getvalue()),), (bytearray(b"x"),), (None,)], "c binary")
    assert [r.t for r in rows.select(J.docx_text(F.col("c")).alias("t")).collect()] == ["um\tdois\n", None, None]


def test_index_documents(spark):
    reg = spark.createDataFrame([("ctb", "a.txt", None, "A", 3, 1)], "collection string, name string, hash string, title string, letters int, n_chunks bigint")
    files = spark.createDataFrame([("ctb", "a.txt", " ", "novo texto"), ("ctb", "b.txt", "B", "outro"), ("ctb", "c.txt", "C", "outro")], "collection string, name string, title string, text string")
    reg2, made = J.index_documents(files, reg, lambda f: f.select("doc", F.lit(0).alias("ord"), "text"))
    rows = reg2.orderBy("name").collect()
    assert len(rows) == 2 and rows[0].title == "a" and made.count() == 2
    again, none = J.index_documents(files, reg2, lambda f: f.select("doc", F.lit(0).alias("ord"), "text"))
    assert none.count() == 0 and again.count() == 2


def test_backfill(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "c")], "id long, text string").write.parquet(str(tmp_path / "p"))
    pending = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "p"))
    for _ in range(2):
        J.backfill(pending, "text", lambda c: F.array(F.length(c).cast("float")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.id, r.embedding) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, [2.0]), (2, [1.0])]


def test_styled_lines(spark):
    got = one(spark, P.styled_lines, "## Título:\n- **a**\n1. b\n\nfim")
    assert [(r.text, r.style) for r in got] == [("Título", "subtitle"), ("• a", "item"), ("1. b", "item"), ("fim", "paragraph")]


def test_windows():
    """Windows cover the text, overlap, end at the last break that they reach, and begin behind a break where there is one."""
    import random

    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab  \nc" if rng.random() < 0.3 else "abcd") for _ in range(rng.randrange(400)))
        limit = rng.randrange(6, 60)
        spans = C.windows_of(text, limit)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), nxt in zip(spans, [*spans[1:], None]):
            assert 0 <= b - a <= limit and (b > a or not text)
            if b < len(text):
                last = max(text.rfind("\n", 0, a + limit + 1), text.rfind(" ", 0, a + limit + 1))
                assert b == (last if last > a + limit / C.BREAK_SHARE else a + limit)
                c, near = nxt[0], max(a + 1, b - limit // C.OVERLAP)
                part = text[near:b]
                at = part.find("\n") if "\n" in part else part.find(" ")
                assert a < c <= b and c == (near + at + 1 if at >= 0 else near)
