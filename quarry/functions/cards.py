"""Parts of an answer card as Column expressions over the columns of an infraction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording and patterns of a card.
CHECK_OPEN = (
    "[ ] Confirmar local, data e hora exata da abordagem",
    "[ ] Descrever a conduta na forma exata do dispositivo enquadrado",
    "[ ] Identificar condutor (CNH) e veículo (placa, chassi, marca/modelo)",
)
CHECK_HELD = "[ ] Registrar a retenção e entregar comprovante ao condutor"
CHECK_TOWED = "[ ] Conferir o chassi antes da remoção e lavrar o auto de remoção"
CHECK_PHOTO = "[ ] Fotografar a evidência e a sinalização do local"
CHECK_GENERIC = (
    CHECK_OPEN[0],
    "[ ] Identificar o dispositivo legal que se aplica ao caso concreto",
    CHECK_OPEN[2],
    CHECK_PHOTO,
    "[ ] Registrar a medida administrativa cabível (retenção, remoção, recolhimento)",
)
MISTAKES = (
    "❌ Não descrever a conduta nos termos do dispositivo enquadrado",
    "❌ Divergência entre o horário registrado e o horário da abordagem",
)
MISTAKE_TOWED = "❌ Remover o veículo sem lavrar o auto de remoção ou sem conferir o chassi"
MISTAKE_PAPER = "❌ Recolher documento sem emitir recibo ao condutor"
MISTAKE_VALUE = "⚠️ Valor de multa não cadastrado — conferir a tabela vigente antes de lavrar"
DOCUMENTS = {"cnh": "CNH", "crlv": "CRLV", "ambos": "CNH e CRLV"}
RESPONSIBLE = {"condutor": "Condutor", "proprietario": "Proprietário", "ambos": "Condutor e proprietário"}
CRIME = r"(?i)art\.?\s*(30[2-9]|31[0-2])"
TWO_WHEELS = r"motociclet|ciclomotor|motoneta|duas rodas|guidom"
HEAVY = r"ônibus|onibus|coletivo|passageiros|caminhão|caminhao|reboque|trator"
SUMMARY_NOTE = "Resumo gerado automaticamente a partir da base legal — confirme a redação vigente antes de fundamentar o AIT."
NO_MEASURE = " A infração não prevê medida administrativa além da multa."
EXAMPLE_TOWED = "O agente confere o chassi, lavra o auto de remoção e libera o guincho apenas com o comprovante assinado."
EXAMPLE_PAPER = "O agente recolhe o documento indicado, emite o recibo e orienta o condutor sobre a regularização."
EXAMPLE_PLAIN = "O agente registra os dados no AIT, entrega a via ao condutor e explica o prazo para defesa."
NO_TEXT = "Dispositivo apontado pelo enquadramento (texto não cadastrado na base)."


def _label(c: Column, names: Mapping[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in names.items()])


def paper(c: Column) -> Column:
    """Label of the document that is collected, null if none is."""
    return _label(c, DOCUMENTS)


def responsible(c: Column) -> Column:
    """Label of who answers for the infraction."""
    return F.coalesce(_label(c, RESPONSIBLE), c, F.lit("Não informado"))


def fine(cents: Column) -> Column:
    """Cents as ``R$ 293,47``, without thousands marks; null counts as 0."""
    return F.concat(F.lit("R$ "), F.translate(F.format_string("%.2f", F.coalesce(cents, F.lit(0)) / 100), ".", ","))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


def checklist(held: Column, towed: Column, document: Column, support: Column) -> Column:
    """Checks in the order in which they are made."""
    label = paper(document)
    return F.array_compact(
        F.array(
            *map(F.lit, CHECK_OPEN),
            F.when(held, CHECK_HELD),
            F.when(towed, CHECK_TOWED),
            F.when(label.isNotNull(), F.concat(F.lit("[ ] Recolher "), label, F.lit(" e emitir recibo de recolhimento"))),
            F.concat(F.lit("[ ] Citar o amparo legal no campo de enquadramento ("), support, F.lit(")")),
            F.lit(CHECK_PHOTO),
        )
    )


def mistakes(towed: Column, document: Column, cents: Column) -> Column:
    """Common mistakes."""
    given = F.coalesce(document, F.lit("")) != ""
    return F.array_compact(
        F.array(*map(F.lit, MISTAKES), F.when(towed, MISTAKE_TOWED), F.when(given, MISTAKE_PAPER), F.when(cents == 0, MISTAKE_VALUE))
    )


def is_crime(support: Column) -> Column:
    """The support names one of the articles 302 to 312."""
    return F.coalesce(support, F.lit("")).rlike(CRIME)


def licence(text: Column) -> Column:
    """Licence category that the infraction's wording asks for."""
    low = F.lower(text)
    return F.when(low.rlike(TWO_WHEELS), "A").when(low.rlike(HEAVY), "C/D/E").otherwise("qualquer")


def summary(wording: Column, support: Column, severity: Column, points: Column, cents: Column, unit: Column, held: Column, towed: Column,
            document: Column) -> Column:
    """The infraction in plain words."""
    collected = F.coalesce(document, F.lit("")) != ""
    what = F.array_compact(
        F.array(F.when(collected, "recolhimento de documento"), F.when(held, "retenção do veículo"), F.when(towed, "remoção do veículo"))
    )
    measures = F.when(F.size(what) > 0, F.concat(F.lit(" Além da multa, a infração prevê "), F.array_join(what, ", "), F.lit("."))).otherwise(NO_MEASURE)
    return F.concat(
        lower_first(wording), F.lit(", previsto em "), support, F.lit(". É infração de gravidade "), severity, F.lit(", vale "),
        points.cast("string"), F.lit(" ponto(s) na CNH e multa de "), fine(cents), F.lit(" ("), unit, F.lit(")."), measures, F.lit(" " + SUMMARY_NOTE),
    )


def example(wording: Column, support: Column, towed: Column, document: Column) -> Column:
    """An everyday scene, marked as illustrative."""
    collected = F.coalesce(document, F.lit("")) != ""
    scene = F.when(towed, EXAMPLE_TOWED).when(collected, EXAMPLE_PAPER).otherwise(EXAMPLE_PLAIN)
    return F.concat(
        F.lit("Cenário ilustrativo (não é jurisprudência): abordagem de rotina em que a conduta descrita em "), support,
        F.lit(' é flagrada — "'), lower_first(wording), F.lit('". '), scene,
    )


def norms_summary(labels: Column) -> Column:
    """Plain words for an answer that found norms only."""
    return F.concat(
        F.lit("Estes são os dispositivos da base mais próximos da sua consulta: "), F.array_join(labels, ", "),
        F.lit('. O trecho integral de cada um está em "Fontes e citações". Use o texto legal como base do enquadramento'
              " e confirme a redação vigente na fonte oficial."),
    )


def share_link(question: Column, origin: str) -> Column:
    """Address of the page that shows a card (F29). A space is ``%20``, not a plus."""
    return F.concat(F.lit(origin.rstrip("/") + "/consulta?q="), F.replace(F.url_encode(question), F.lit("+"), F.lit("%20")))


def share_text(card: Column, link: Column) -> Column:
    """A card as a message (F29): card is a struct of question, wording (null: nothing found), code, unfolding, severity,
    points, cents, support, document, held, towed, crime, summary and checklist."""
    upper = F.upper(card["severity"])
    price = F.concat(F.lit("Gravidade: "), upper, F.lit(" · "), card["points"].cast("string"), F.lit(" pontos · "), fine(card["cents"]))
    tail = [
        F.when(card["summary"] != "", F.concat(F.lit("\n"), card["summary"])),
        F.when(F.size(card["checklist"]) > 0, F.concat(F.lit("\nChecklist do AIT:\n• "), F.array_join(card["checklist"], "\n• "))),
        F.when(link != "", F.concat(F.lit("\n"), link)),
    ]
    full = F.array(
        F.concat(F.lit("🚦 "), card["wording"]), F.concat(F.lit("Código MBFT: "), card["code"]),
        F.when(card["unfolding"] > 0, F.concat(F.lit("Desdobramento: "), card["unfolding"].cast("string"))),
        price, F.concat(F.lit("Amparo legal: "), card["support"]), F.concat(F.lit("Recolhe documento: "), paper(card["document"])),
        F.when(card["held"], "⚠️ Veículo retido"), F.when(card["towed"], "🚗 Remoção do veículo"),
        F.when(card["crime"], "⚠️ Pode configurar crime de trânsito"), *tail,
    )
    none = F.array(
        F.lit("🚦 Nada encontrado na base"), F.concat(F.lit("Consulta: "), card["question"]),
        F.when(card["summary"] != "", card["summary"]), F.when(link != "", F.concat(F.lit("\n"), link)),
    )
    return F.array_join(F.array_compact(F.when(card["wording"].isNull(), none).otherwise(full)), "\n")
